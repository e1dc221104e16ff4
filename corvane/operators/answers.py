"""Analysis of model answers to word problems: features, classes, rewards, comparisons across runs."""

from __future__ import annotations

import re

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NUMBER = r"-?\d+(?:\.\d+)?"
# Words that put a question into a category (fixed values).
CATEGORY_WORDS = {
    "money": ["$", "dollar", "dollars", "cent", "cents", "price", "cost"],
    "time": ["minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years"],
    "distance": ["mile", "miles", "meter", "meters", "kilometer", "kilometers", "km", "foot", "feet", "yard", "yards"],
    "geometry": ["area", "perimeter", "radius", "diameter", "rectangle", "triangle", "circle", "square"],
    "counting": ["how many", "total number", "count", "altogether"],
    "ratio_percent": ["ratio", "percent", "%", "fraction", "half", "double", "twice", "each", "per", "every"],
}
CATEGORIES = ["multi_step", *CATEGORY_WORDS]
# Weights of reward components (fixed values).
REWARD_WEIGHTS = {
    "baseline": {"exact_match": 1.0},
    "format_aware": {"nonempty": 0.05, "has_number": 0.15, "has_final_marker": 0.20, "exact_match": 0.60},
    "accuracy_shaped": {"nonempty": 0.05, "has_number": 0.10, "has_final_marker": 0.15, "worked_solution": 0.20, "near_match": 0.20, "exact_match": 0.30},
    "combined": {"nonempty": 0.05, "has_number": 0.10, "has_final_marker": 0.15, "worked_solution": 0.15, "near_match": 0.15, "exact_match": 0.40},
}
COMPONENTS = ["nonempty", "has_number", "has_final_marker", "worked_solution", "near_match", "exact_match"]


def final_answer(text: Column) -> Column:
    """ANS-00: the number after the marker, without commas; null without one."""
    found = F.regexp_extract(text, r"####\s*(-?\d[\d,]*(?:\.\d+)?)", 1)
    return F.when(found != "", F.regexp_replace(found, ",", ""))


def number_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def has_marker(text: Column) -> Column:
    return F.contains(text, F.lit("####"))


def category_flags(question: Column) -> dict[str, Column]:
    """ANS-02."""
    lower = F.lower(question)
    flags = {"multi_step": (number_count(question) >= 3).cast("int")}
    for name, words in CATEGORY_WORDS.items():
        flags[name] = lower.rlike("|".join(map(re.escape, words))).cast("int")  # one pass over the text
    return flags


def problem_cluster() -> Column:
    """ANS-03, of the category columns, the first that applies."""
    on = lambda c: F.col(c) == 1
    return (
        F.when(on("geometry"), "geometry").when(on("money") & on("ratio_percent"), "money_rate").when(on("time") & on("ratio_percent"), "time_rate").when(on("counting"), "counting")
        .when(on("distance"), "distance").when(on("ratio_percent"), "ratio_percent").when(on("multi_step"), "multi_step_other").otherwise("other")
    )


def _number(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").try_cast("decimal(38,10)")


def error_class(is_correct: Column, predicted: Column, gold: Column) -> Column:
    """ANS-04."""
    p, g = _number(predicted), _number(gold)
    close = (g != 0) & (F.abs(p - g) * 10 <= F.abs(g))
    larger = F.greatest(F.abs(p), F.abs(g), F.lit(1).cast("decimal(38,10)"))
    smaller = F.greatest(F.least(F.abs(p), F.abs(g)), F.lit("0.000000001").cast("decimal(38,10)"))
    return (
        F.when(is_correct, "correct").when(predicted.isNull(), "no_numeric_answer").when(gold.isNull(), "bad_reference").when(p.isNull() | g.isNull(), "format_error").when(p == g, "correct")
        .when((p == g + 1) | (p == g - 1), "off_by_one").when(p == -g, "sign_error").when(close, "near_miss").when(larger >= smaller * 10, "magnitude_error").otherwise("wrong_numeric")
    )


def answer_style(completion: Column, predicted: Column) -> Column:
    """ANS-05."""
    marker, trace = has_marker(completion), F.contains(completion, F.lit("<<")) | F.contains(completion, F.lit(">>"))
    return (
        F.when(~completion.rlike(r"\S"), "empty").when(predicted.isNull() & (number_count(completion) > 0), "number_without_marker").when(predicted.isNull(), "no_numeric_answer")
        .when(trace & marker, "tool_trace_with_final").when(trace, "tool_trace_no_final").when(marker & (word_count(completion) <= 12), "concise_final").when(marker, "worked_then_final").otherwise("other_numeric")
    )


def output_format(completion: Column, is_correct: Column, marker: Column, predicted: Column, numbers: Column) -> Column:
    """ANS-06."""
    has_answer = F.trim(F.coalesce(predicted, F.lit(""))) != ""
    return (
        F.when(~F.coalesce(completion, F.lit("")).rlike(r"\S"), "empty_completion").when(is_correct & marker, "correct_with_marker").when(is_correct, "correct_without_marker")
        .when(marker & has_answer, "marker_wrong_number").when(marker, "marker_unparseable").when(numbers > 0, "number_without_marker").otherwise("text_without_number")
    )


def annotated(records: DataFrame) -> DataFrame:
    """ANS-01 to ANS-06 of records (run_id, idx, question, gold_text, completion)."""
    d = records.withColumns({"gold_answer": final_answer(F.col("gold_text")), "pred_answer": final_answer(F.col("completion"))})
    d = d.withColumn("is_correct", F.coalesce(F.col("gold_answer") == F.col("pred_answer"), F.lit(False)))
    d = d.withColumns(category_flags(F.col("question")))
    d = d.withColumns({"numbers": number_count(F.col("completion")), "question_numbers": number_count(F.col("question")), "words": word_count(F.col("completion")), "marker": has_marker(F.col("completion"))})
    return d.withColumns({
        "problem_cluster": problem_cluster(), "error_type": error_class(F.col("is_correct"), F.col("pred_answer"), F.col("gold_answer")), "answer_style": answer_style(F.col("completion"), F.col("pred_answer")),
        "format": output_format(F.col("completion"), F.col("is_correct"), F.col("marker"), F.col("pred_answer"), F.col("numbers")),
    })


def category_accuracy(rows: DataFrame, keys: list[str]) -> DataFrame:
    """ANS-07: rows and accuracy of each category; a row may be in several."""
    each = rows.select(*keys, "is_correct", F.explode(F.filter(F.array(*[F.when(F.col(c) == 1, F.lit(c)) for c in CATEGORIES]), lambda x: x.isNotNull())).alias("category"))
    return each.groupBy(*keys, "category").agg(F.count("*").alias("n"), F.avg(F.col("is_correct").cast("int")).alias("accuracy"))


def complexity(numbers: Column) -> Column:
    return F.when(numbers <= 2, "simple").when(numbers <= 4, "medium").otherwise("complex")


def run_accuracies(rows: DataFrame) -> DataFrame:
    """ANS-08: accuracy by run, by run and cluster, and by run and complexity, in one pass."""
    sets = [[], ["problem_cluster"], ["complexity"]]
    few = rows.groupBy("run_id", "problem_cluster", complexity(F.col("question_numbers")).alias("complexity")).agg(F.count("*").alias("n"), F.count_if("is_correct").alias("right"))
    return few.groupingSets([["run_id", *s] for s in sets], "run_id", "problem_cluster", "complexity").agg(F.sum("n").alias("n"), (F.sum("right") / F.sum("n")).alias("accuracy"))


def distribution(rows: DataFrame, run: str, value: str) -> DataFrame:
    """ANS-09: shares of a run's rows by value, over all values of any run, 0 where a run has none."""
    counts = rows.groupBy(run, value).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(run))
    every = rows.select(run).distinct().crossJoin(rows.select(value).distinct())  # runs and labels are few
    shares = counts.withColumn("share", F.col("n") / total)
    return every.join(shares, [run, value], "left").select(run, value, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("share", F.lit(0.0)).alias("share"))


def in_all_runs(rows: DataFrame, key: str = "idx") -> DataFrame:
    """JOI-06: how many runs have each key right, for keys that all runs have."""
    n_runs = rows.agg(F.countDistinct("run_id").alias("runs"))
    by_key = rows.groupBy(key).agg(F.countDistinct("run_id").alias("in_runs"), F.sum(F.col("is_correct").cast("int")).alias("right"))
    return by_key.crossJoin(F.broadcast(n_runs)).where("in_runs = runs").select(key, "runs", "right")  # one row of totals


def disagreements(rows: DataFrame, n: int, key: str = "idx") -> DataFrame:
    """ANS-10: keys that some runs have right and some wrong, the most one-sided first, then the larger key."""
    split = in_all_runs(rows, key).where("right > 0 and right < runs").withColumn("lean", F.abs(F.col("right") - F.col("runs") / 2))
    return split.orderBy(F.col("lean").desc(), F.col(key).desc()).limit(n)


def first_examples(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """ANS-11."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("place") <= n)


def reward_components() -> dict[str, Column]:
    """ANS-12, of columns completion, pred_answer, gold_answer, is_correct."""
    text = F.col("completion")
    p, g = _number(F.col("pred_answer")), _number(F.col("gold_answer"))
    near = F.coalesce((p == g) | (p == g + 1) | (p == g - 1) | ((g != 0) & (F.abs(p - g) * 10 <= F.abs(g))), F.lit(False))
    filled = F.size(F.filter(F.split(text, r"\r\n|[\r\n]"), lambda x: x.rlike(r"\S"))) >= 2
    worked = filled | F.contains(text, F.lit("<<")) | F.contains(text, F.lit(">>")) | F.contains(text, F.lit("="))
    flags = {"nonempty": text.rlike(r"\S"), "has_number": text.rlike(NUMBER), "has_final_marker": text.rlike(r"####\s*-?\d[\d,]*(?:\.\d+)?"), "worked_solution": worked, "near_match": near & ~F.col("is_correct"), "exact_match": F.col("is_correct")}
    return {k: v.cast("double") for k, v in flags.items()}


def reward_total(system: str) -> Column:
    """ANS-13, of the component columns."""
    if system not in REWARD_WEIGHTS:
        raise ValueError(f"unknown reward system: {system}")
    return reduce(lambda a, b: a + b, [F.lit(w) * F.col(c) for c, w in REWARD_WEIGHTS[system].items()])


def reward_by_step(rows: DataFrame) -> DataFrame:
    """ANS-14: mean reward and components of each step."""
    return rows.groupBy("step").agg(F.avg("reward").alias("reward"), *[F.avg(c).alias(c) for c in COMPONENTS])


def advantage(reward: Column, prompt: str) -> Column:
    """ANS-15."""
    return reward - F.avg(reward).over(Window.partitionBy(prompt))


def rolling_mean(value: str, order: str, width: int, keys: list[str]) -> Column:
    """ANS-16: mean of the last `width` points, of fewer at the start."""
    if width <= 1:
        return F.col(value)
    return F.avg(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - width, 0))


def metric_table(rows: DataFrame, metrics: list[str], baselines: dict[str, float]) -> DataFrame:
    """ANS-17: a run's metrics side by side and their mean after centring (x - base) / (1 - base). rows: run_id, metric, value. A run that lacks a metric is an error."""
    wide = rows.groupBy("run_id").pivot("metric", metrics).agg(F.avg("value"))
    checked = [F.coalesce(F.col(m), F.raise_error(F.concat(F.lit(f"no {m} in "), F.col("run_id"))).cast("double")).alias(m) for m in metrics]
    centred = [(F.col(m) - baselines.get(m, 0.0)) / (1 - baselines.get(m, 0.0)) for m in metrics]
    return wide.select("run_id", *checked).withColumn("centred_mean", reduce(lambda a, b: a + b, centred) / len(metrics))


def finite_points(rows: DataFrame, x: str, y: str) -> DataFrame:
    """SRC-14: rows with x and a finite y."""
    return rows.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(y) & (F.abs(F.col(y)) < float("inf")))
