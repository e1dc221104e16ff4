"""Evaluation analytics: task status, runs compared, pass@k, cost, experiment grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.text import provider_and_model

STATUS_RANK = {"error": 0, "missing_patch": 1, "patch_failed": 2, "unresolved": 3, "resolved": 4}
COUNTS = ["total", "submitted", "completed", "resolved", "unresolved", "empty_patch", "error"]
LABEL_ORDER = ("baseline",)
CELL = ["family", "context_source", "chunking_strategy", "codegen_model", "embedding_model"]


def task_status() -> Column:
    """EVA-01, of columns resolved, prediction_present, patch_exists, patch_applied."""
    return F.when(F.col("resolved"), "resolved").when(~F.col("prediction_present"), "error").when(~F.col("patch_exists"), "missing_patch").when(~F.col("patch_applied"), "patch_failed").otherwise("unresolved")


def harness_status() -> Column:
    """EVA-01 without predictions that are missing."""
    return F.when(F.col("resolved"), "resolved").when(~F.col("patch_exists"), "missing_patch").when(~F.col("patch_applied"), "patch_failed").otherwise("unresolved")


def status_rank(status: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in STATUS_RANK.items() for x in p]), status), F.lit(-1))


def run_summary(results: DataFrame) -> DataFrame:
    """EVA-02: counts and id lists of each run."""
    failed = ~F.col("prediction_present") | (F.col("patch_exists") & ~F.col("patch_applied"))
    flags = {"submitted": F.col("prediction_present"), "completed": F.col("prediction_present"), "resolved": F.col("resolved"), "unresolved": ~F.col("resolved"), "empty_patch": F.col("prediction_present") & ~F.col("patch_exists"), "error": failed}
    ids = [F.array_sort(F.collect_list(F.when(c, F.col("task_id")))).alias(f"{n}_ids") for n, c in flags.items()]
    return results.groupBy("run_id").agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in flags.items()], *ids)


def fail_to_pass(results: DataFrame) -> DataFrame:
    """EVA-03."""
    return results.withColumns({"fail_to_pass_successes": F.array_except("pytest_targets", "failing_tests"), "fail_to_pass_failures": F.array_intersect("pytest_targets", "failing_tests")})


def aligned(base: DataFrame, other: DataFrame, key: str = "task_id") -> DataFrame:
    """JOI-05: tasks of two runs side by side, with the side that lacks one."""
    a = base.select(F.col(key), F.struct(*[c for c in base.columns if c != key]).alias("base"))
    b = other.select(F.col(key), F.struct(*[c for c in other.columns if c != key]).alias("other"))
    missing = F.when(F.col("base").isNull(), "base").when(F.col("other").isNull(), "other")
    return a.join(b, key, "full_outer").withColumn("missing_in", missing)


def task_deltas(base: DataFrame, other: DataFrame) -> DataFrame:
    """EVA-04: improved, regressed or unchanged: by resolution, then fewer failing tests, then status."""
    both = aligned(base.withColumn("status", task_status()), other.withColumn("status", task_status()))
    b, o = (lambda c: F.col(f"base.{c}")), (lambda c: F.col(f"other.{c}"))
    failing = lambda x: F.coalesce(F.size(x("failing_tests")), F.lit(0))
    delta = (
        F.when(F.col("missing_in").isNotNull(), F.raise_error(F.concat(F.lit("task sets differ: "), "task_id")).cast("string"))
        .when(o("resolved") & ~b("resolved"), "improved").when(b("resolved") & ~o("resolved"), "regressed")
        .when(failing(o) < failing(b), "improved").when(failing(o) > failing(b), "regressed")
        .when(status_rank(o("status")) > status_rank(b("status")), "improved").when(status_rank(o("status")) < status_rank(b("status")), "regressed")
        .otherwise("unchanged")
    )
    return both.select("task_id", b("status").alias("base_status"), o("status").alias("other_status"), delta.alias("delta"))


def signed(value: Column) -> Column:
    return F.when(value > 0, F.concat(F.lit("+"), value.cast("string"))).otherwise(value.cast("string"))


def overall_table(summary: DataFrame, base: str, other: str) -> DataFrame:
    """EVA-05: each count of two runs and the signed difference."""
    rows = summary.where(F.col("run_id").isin(base, other)).select("run_id", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("n")) for c in COUNTS])).alias("m"))
    return rows.groupBy("m.metric").pivot("run_id", [base, other]).agg(F.first("m.n")).withColumnsRenamed({base: "base", other: "other"}).withColumn("difference", signed(F.col("other") - F.col("base")))


def score_rows(summary: DataFrame, label: Column, first: tuple[str, ...] = LABEL_ORDER) -> DataFrame:
    """EVA-06: share of resolved tasks in percent; labels in a fixed order, then by name."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, first)), F.col("label")), F.lit(0))
    rows = summary.withColumn("label", label).withColumn("score_pct", F.when(F.col("total") == 0, 0.0).otherwise(F.col("resolved") / F.col("total") * 100.0))
    return rows.withColumn("position", F.row_number().over(Window.orderBy(F.when(place == 0, len(first) + 1).otherwise(place), "label"))).select("label", "run_id", "total", "resolved", "unresolved", "score_pct", "position")


def pass_at_k(n: Column, c: Column, k: Column) -> Column:
    """EVA-07: unbiased estimate 1 - C(n-c, k) / C(n, k), as a product."""
    product = F.aggregate(F.sequence(F.lit(0), k.cast("int") - 1), F.lit(1.0), lambda a, i: a * (n - c - i) / (n - i))
    return F.when((n <= 0) | (c <= 0), 0.0).when((k >= n) | (n - c < k), 1.0).otherwise(1.0 - product)


def pass_at_k_by_task(runs: DataFrame, k_values: list[int], group: list[str] | None = None) -> DataFrame:
    """EVA-08, a row a task and k. runs: (group,) run_id, task_id, resolved."""
    g = group or []
    counts = runs.groupBy(*g, "task_id").agg(F.countDistinct("run_id").alias("n"), F.count_if("resolved").alias("c"))
    return counts.withColumn("k", F.explode(F.array(*map(F.lit, k_values)))).withColumn("pass_at_k", pass_at_k(F.col("n"), F.col("c"), F.col("k")))


def macro_pass_at_k(runs: DataFrame, k_values: list[int], group: list[str] | None = None) -> DataFrame:
    """EVA-08: the mean over tasks. Runs without groups must be `comparable`."""
    return pass_at_k_by_task(runs if group else comparable(runs), k_values, group).groupBy(*(group or []), "k").agg(F.avg("pass_at_k").alias("pass_at_k"))


def common_tasks(runs: DataFrame) -> DataFrame:
    """EVA-08: the runs over the tasks that all of them have."""
    n_runs = runs.agg(F.countDistinct("run_id")).first()[0]
    shared = runs.groupBy("task_id").agg(F.countDistinct("run_id").alias("n")).where(F.col("n") == n_runs).select("task_id")
    return runs.join(shared, "task_id", "left_semi")


def comparable(runs: DataFrame, same: tuple[str, ...] = ("family", "version")) -> DataFrame:
    """EVA-08, JOI-05: the runs, or an error if they differ in family, version (those of these columns that there are) or tasks."""
    given = [c for c in same if c in runs.columns]
    if given and runs.select(*given).distinct().limit(2).count() > 1:
        raise ValueError(f"runs differ in {' or '.join(given)}")
    if not same_tasks(runs).isEmpty():
        raise ValueError("runs have different tasks")
    return runs


def same_tasks(runs: DataFrame) -> DataFrame:
    """EVA-08, SET-03: run and task of every task that some other run has and this one lacks; empty if runs agree."""
    n_runs = runs.agg(F.countDistinct("run_id")).first()[0]
    short = runs.groupBy("task_id").agg(F.collect_set("run_id").alias("in_runs")).where(F.size("in_runs") < n_runs)
    every = runs.agg(F.collect_set("run_id").alias("every"))  # runs are few
    return short.crossJoin(F.broadcast(every)).select("task_id", F.explode(F.array_except("every", "in_runs")).alias("run_id"))


def prefix_pass_at_k(samples: DataFrame) -> DataFrame:
    """EVA-09: share of records with a right answer among their first k samples. samples: record_id, sample (from 1), correct."""
    upto = Window.partitionBy("record_id").orderBy("sample").rowsBetween(Window.unboundedPreceding, 0)
    return samples.withColumn("any", F.max(F.col("correct").cast("int")).over(upto)).groupBy(F.col("sample").alias("k")).agg(F.avg("any").alias("pass_at_k"))


def generation_totals(calls: DataFrame, keys: list[str]) -> DataFrame:
    """EVA-10: totals of calls with all four measures; the mean latency is 0 without any."""
    measures = ["input_tokens", "output_tokens", "total_tokens", "latency_ms"]
    good = reduce(lambda a, b: a & b, [F.col(m).isNotNull() for m in measures])
    sums = [F.coalesce(F.sum(F.when(good, F.col(m))), F.lit(0)).alias(m) for m in measures]
    return calls.groupBy(*keys).agg(F.count_if(good).alias("calls"), *sums, F.coalesce(F.avg(F.when(good, F.col("latency_ms"))), F.lit(0.0)).alias("mean_latency_ms"))


def with_rates(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """JOI-07: the rate of a model's region, else of region *, else null. rates: model, region, input_rate, output_rate."""
    exact = rates.select("model", "region", F.col("input_rate").alias("i1"), F.col("output_rate").alias("o1"), F.lit(True).alias("hit"))
    general = rates.where("region = '*'").select("model", F.col("input_rate").alias("i2"), F.col("output_rate").alias("o2"))
    joined = rows.join(exact, ["model", "region"], "left").join(general, "model", "left")
    pick = lambda a, b: F.when(F.col("hit"), F.col(a)).otherwise(F.col(b))
    return joined.select(*rows.columns, pick("i1", "i2").alias("input_rate"), pick("o1", "o2").alias("output_rate"))


def generation_cost(input_tokens: Column, output_tokens: Column, input_rate: Column, output_rate: Column) -> Column:
    """EVA-11: null for negative counts or an unknown rate."""
    return F.when((input_tokens >= 0) & (output_tokens >= 0), input_tokens / 1e6 * input_rate + output_tokens / 1e6 * output_rate)


def embedding_cost(tokens: Column, rate: Column) -> Column:
    return F.when(tokens >= 0, tokens / 1e6 * rate)


def stage_durations(stages: DataFrame, names: list[str]) -> DataFrame:
    """EVA-12: seconds of each stage, their total, and the number of retrieval requests. stages: run_id, stage, seconds, requests."""
    wide = stages.groupBy("run_id").pivot("stage", names).agg(F.sum("seconds"))
    wide = wide.select("run_id", *[F.coalesce(F.col(n), F.lit(0.0)).alias(f"{n}_seconds") for n in names])
    requests = stages.groupBy("run_id").agg(F.coalesce(F.sum(F.when(F.col("stage") == "retrieval", F.col("requests"))), F.lit(0)).alias("retrieval_requests"))
    return wide.withColumn("total_seconds", reduce(lambda a, b: a + b, [F.col(f"{n}_seconds") for n in names])).join(requests, "run_id")


def matrix_cells(repeats: DataFrame, keys: list[str] = CELL) -> DataFrame:
    """EVA-13: a cell's mean and population deviation of scores, mean duration and tokens, mean of known costs, and the scores."""
    return repeats.groupBy(*keys).agg(
        F.avg("score_pct").alias("mean_score_pct"), F.stddev_pop("score_pct").alias("stddev_score_pct"), F.avg("total_seconds").alias("mean_seconds"),
        F.avg("total_tokens").alias("mean_tokens"), F.avg("cost_usd").alias("mean_cost_usd"), F.transform(F.array_sort(F.collect_list(F.struct("repeat", "score_pct"))), lambda x: x["score_pct"]).alias("repeat_scores"),
    )


def metric_grid(cells: DataFrame, models: list[str], metric: str = "mean_score_pct") -> DataFrame:
    """EVA-14: rows of context sources, a column for each model; cells without a value stay blank."""
    return cells.groupBy("family", "chunking_strategy", "embedding_model", "context_source").pivot("codegen_model", models).agg(F.first(metric))


def experiment_grid(spark: SparkSession, lists: dict[str, list[str]], families: list[str]) -> DataFrame:
    """JOI-08: every combination of five lists; family `all` stands for all families. A structural index with a wiki-only context is an error."""
    if any(not v for v in lists.values()):
        raise ValueError("a dimension is empty")
    names = families if "all" in lists["family"] else lists["family"]
    if unknown := [n for n in names if n not in families]:
        raise ValueError(f"unknown families: {unknown}")
    if "ast" in lists["chunking_strategy"] and lists["context_source"] == ["wiki"]:
        raise ValueError("the structural index needs a code context")
    out = spark.range(1).select()
    for column in CELL:
        values = names if column == "family" else lists[column]
        out = out.withColumn(column, F.explode(F.array(*map(F.lit, dict.fromkeys(values)))))
    return out


def planned_cells(grid: DataFrame, measured: DataFrame) -> DataFrame:
    """EVA-15: all cells of the grid, those not measured with null measures."""
    return grid.join(measured, CELL, "left").withColumn("is_measured", F.col("mean_score_pct").isNotNull())


def seeded_subset(tasks: DataFrame, n: int, seed: int) -> DataFrame:
    """EVA-16: n tasks drawn by a seeded hash, in their own order; an error where there are not so many. tasks: task_id, position."""
    if not 0 < n <= tasks.count():
        raise ValueError(f"no subset of {n} tasks")
    drawn = tasks.withColumn("draw", F.md5(F.concat(F.lit(str(seed)), F.col("task_id").cast("string")).cast("binary"))).orderBy("draw", "task_id").limit(n)
    return drawn.drop("draw").withColumn("position", F.row_number().over(Window.orderBy("position")))


def priced(calls: DataFrame, rates: DataFrame) -> DataFrame:
    """EVA-11 over JOI-07, by the model's name without its provider (FLT-15)."""
    provider, model = provider_and_model(F.col("model_name"))
    rated = with_rates(calls.withColumns({"provider": provider, "model": model}), rates)
    return rated.withColumn("cost_usd", generation_cost(F.col("input_tokens"), F.col("output_tokens"), F.col("input_rate"), F.col("output_rate")))


def set_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """SET-03: values that only one side has."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
