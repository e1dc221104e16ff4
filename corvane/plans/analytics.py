"""Queries on evaluation results, model answers, chat data and text utilities."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.operators import answers as A
from corvane.operators import chat
from corvane.operators import evaluation as E
from corvane.operators import prompts as prompting
from corvane.plans import tables as T

QUERIES, SQL = {}, {}


def query(key: str, sql: str | None = None):
    def added(f):
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return added


# Evaluation


@query("EVA-01", f"WITH {T.RESULTS} SELECT run_id, task_id, status, CAST(list_position(['error', 'missing_patch', 'patch_failed', 'unresolved', 'resolved'], status) - 1 AS INTEGER) AS rank FROM status")
def eva_01(spark, d):
    return T.results(spark, d).select("run_id", "task_id", E.task_status().alias("status")).withColumn("rank", E.status_rank(F.col("status")))


@query("EVA-02", f"""WITH {T.RESULTS} SELECT run_id, count(*) AS total, CAST(count_if(prediction_present) AS BIGINT) AS submitted, CAST(count_if(prediction_present) AS BIGINT) AS completed, CAST(count_if(resolved) AS BIGINT) AS resolved, CAST(count_if(NOT resolved) AS BIGINT) AS unresolved, CAST(count_if(prediction_present AND NOT patch_exists) AS BIGINT) AS empty_patch, CAST(count_if(NOT prediction_present OR (patch_exists AND NOT patch_applied)) AS BIGINT) AS error,
list(task_id ORDER BY task_id) FILTER (resolved) AS resolved_ids FROM results GROUP BY 1""")
def eva_02(spark, d):
    return E.run_summary(T.results(spark, d)).select("run_id", *E.COUNTS, "resolved_ids")


@query("EVA-03", f"WITH {T.RESULTS} SELECT run_id, task_id, list_filter(pytest_targets, lambda t: NOT list_contains(failing_tests, t)) AS fail_to_pass_successes, list_filter(pytest_targets, lambda t: list_contains(failing_tests, t)) AS fail_to_pass_failures FROM results")
def eva_03(spark, d):
    return E.fail_to_pass(T.results(spark, d)).select("run_id", "task_id", "fail_to_pass_successes", "fail_to_pass_failures")


DELTAS = f"""{T.RESULTS}, ranked AS (SELECT *, list_position(['error', 'missing_patch', 'patch_failed', 'unresolved', 'resolved'], status) AS r, len(failing_tests) AS f FROM status),
deltas AS (SELECT task_id, b.status AS base_status, o.status AS other_status, CASE WHEN o.resolved AND NOT b.resolved THEN 'improved' WHEN b.resolved AND NOT o.resolved THEN 'regressed' WHEN o.f < b.f THEN 'improved' WHEN o.f > b.f THEN 'regressed' WHEN o.r > b.r THEN 'improved' WHEN o.r < b.r THEN 'regressed' ELSE 'unchanged' END AS delta FROM ranked b JOIN ranked o USING (task_id) WHERE b.run_id = 'base' AND o.run_id = 'other')"""


def two_runs(spark, d):
    r = T.results(spark, d)
    return r.where("run_id = 'base'").drop("run_id"), r.where("run_id = 'other'").drop("run_id")


@query("EVA-04", f"WITH {DELTAS} SELECT * FROM deltas")
def eva_04(spark, d):
    return E.task_deltas(*two_runs(spark, d))


@query("EVA-04-counts", f"WITH {DELTAS} SELECT delta, count(*) AS n FROM deltas GROUP BY 1")
def eva_04_counts(spark, d):
    return E.task_deltas(*two_runs(spark, d)).groupBy("delta").agg(F.count("*").alias("n"))


SUMMARY = f"{T.RESULTS}, s AS (SELECT run_id, count(*) AS total, CAST(count_if(prediction_present) AS BIGINT) AS submitted, CAST(count_if(prediction_present) AS BIGINT) AS completed, CAST(count_if(resolved) AS BIGINT) AS resolved, CAST(count_if(NOT resolved) AS BIGINT) AS unresolved, CAST(count_if(prediction_present AND NOT patch_exists) AS BIGINT) AS empty_patch, CAST(count_if(NOT prediction_present OR (patch_exists AND NOT patch_applied)) AS BIGINT) AS error FROM results GROUP BY 1)"


@query("EVA-05", f"WITH {SUMMARY}, l AS (UNPIVOT s ON total, submitted, completed, resolved, unresolved, empty_patch, error INTO NAME metric VALUE n) SELECT b.metric, b.n AS base, o.n AS other, CASE WHEN o.n - b.n > 0 THEN '+' ELSE '' END || (o.n - b.n) AS difference FROM l b JOIN l o USING (metric) WHERE b.run_id = 'base' AND o.run_id = 'other'")
def eva_05(spark, d):
    return E.overall_table(E.run_summary(T.results(spark, d)), "base", "other")


@query("EVA-06", f"WITH {SUMMARY} SELECT CASE run_id WHEN 'base' THEN 'baseline' ELSE 'code' END AS label, run_id, total, resolved, unresolved, resolved * 100.0::DOUBLE / total AS score_pct, CASE run_id WHEN 'base' THEN 1 ELSE 2 END AS position FROM s")
def eva_06(spark, d):
    return E.score_rows(E.run_summary(T.results(spark, d)), F.when(F.col("run_id") == "base", "baseline").otherwise("code"))


PASS = "CASE WHEN n <= 0 OR c <= 0 THEN 0.0::DOUBLE WHEN k >= n OR n - c < k THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - list_product(list_transform(range(0, k), lambda i: (n - c - i) / CAST(n - i AS DOUBLE))) END"


@query("EVA-07", f"SELECT o_orderkey, {PASS} AS pass_at_k FROM (SELECT o_orderkey, CAST(o_custkey % 9 AS BIGINT) AS n, CAST(least(o_custkey % 9, o_orderkey % 5) AS BIGINT) AS c, CAST(o_orderkey % 4 + 1 AS BIGINT) AS k FROM orders)")
def eva_07(spark, d):
    n = F.col("o_custkey") % 9
    return T.read(spark, d, "orders").select("o_orderkey", E.pass_at_k(n, F.least(n, F.col("o_orderkey") % 5), F.col("o_orderkey") % 4 + 1).alias("pass_at_k"))


TASKS = f"{T.RUNS}, t AS (SELECT task_id, count(DISTINCT run_id) AS n, CAST(count_if(resolved) AS BIGINT) AS c FROM runs GROUP BY 1), tk AS (SELECT task_id, n, c, k, {PASS} AS pass_at_k FROM t, (SELECT unnest([1, 2, 3, 5]) AS k))"


@query("EVA-08", f"WITH {TASKS.replace('doc_id % 5', '(doc_id // 20) % 5')} SELECT k, avg(pass_at_k) AS pass_at_k FROM tk WHERE n = (SELECT count(DISTINCT run_id) FROM runs) GROUP BY 1")
def eva_08(spark, d):
    """Over the tasks that all runs have; runs over others are no runs to compare."""
    return E.macro_pass_at_k(E.common_tasks(T.runs(spark, d, 20)), [1, 2, 3, 5])


@query("EVA-08-tasks", f"WITH {TASKS} SELECT task_id, n, c, k, pass_at_k FROM tk")
def eva_08_tasks(spark, d):
    return E.pass_at_k_by_task(T.runs(spark, d), [1, 2, 3, 5])


@query("EVA-09", "SELECT sample AS k, avg(hit) AS pass_at_k FROM (SELECT l_linenumber AS sample, max(max(CAST(l_quantity > 40 AS INTEGER))) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS hit FROM lineitem GROUP BY l_orderkey, l_linenumber) GROUP BY 1")
def eva_09(spark, d):
    return E.prefix_pass_at_k(T.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").alias("sample")).agg(F.max(F.col("l_quantity") > 40).alias("correct")))


@query("EVA-10", f"WITH {T.CALLS}, g AS (SELECT *, output_tokens IS NOT NULL AS good FROM calls) SELECT model_name, region, CAST(count_if(good) AS BIGINT) AS calls, CAST(sum(input_tokens) FILTER (good) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) FILTER (good) AS BIGINT) AS output_tokens, CAST(sum(total_tokens) FILTER (good) AS BIGINT) AS total_tokens, round(sum(latency_ms) FILTER (good), 2) AS latency_ms, round(avg(latency_ms) FILTER (good), 4) AS mean_latency_ms FROM g GROUP BY 1, 2")
def eva_10(spark, d):
    return E.generation_totals(T.calls(spark, d), ["model_name", "region"]).withColumns({"latency_ms": F.round("latency_ms", 2), "mean_latency_ms": F.round("mean_latency_ms", 4)})


RATED = f"{T.CALLS}, {T.RATES}, rated AS (SELECT c.*, CASE WHEN e.model IS NOT NULL THEN e.input_rate ELSE s.input_rate END AS input_rate, CASE WHEN e.model IS NOT NULL THEN e.output_rate ELSE s.output_rate END AS output_rate FROM calls c LEFT JOIN rates e ON e.model = c.model AND e.region = c.region LEFT JOIN rates s ON s.model = c.model AND s.region = '*')"


@query("EVA-11", f"WITH {RATED} SELECT model_name, region, count(*) AS n, round(sum(input_tokens / 1e6::DOUBLE * input_rate + output_tokens / 1e6::DOUBLE * output_rate), 6) AS cost_usd FROM rated GROUP BY 1, 2")
def eva_11(spark, d):
    return E.priced(T.calls(spark, d), T.rates(spark)).groupBy("model_name", "region").agg(F.count("*").alias("n"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


@query("JOI-07", f"WITH {RATED} SELECT DISTINCT model, region, input_rate, output_rate FROM rated")
def joi_07(spark, d):
    _, model = text.provider_and_model(F.col("model_name"))
    return E.with_rates(T.calls(spark, d).select(model.alias("model"), "region").distinct(), T.rates(spark))


@query("EVA-12", "SELECT run_id, coalesce(sum(s) FILTER (st = 0), 0) AS indexing_seconds, coalesce(sum(s) FILTER (st = 1), 0) AS retrieval_seconds, coalesce(sum(s) FILTER (st = 2), 0) AS generation_seconds, sum(s) AS total_seconds, CAST(count(*) FILTER (st = 1) AS BIGINT) AS retrieval_requests FROM (SELECT user_id AS run_id, event_id % 3 AS st, CAST(user_id + event_id % 10 AS DOUBLE) AS s FROM events) GROUP BY 1")
def eva_12(spark, d):
    m = F.col("event_id") % 3
    s = T.read(spark, d, "events").select(F.col("user_id").alias("run_id"), F.when(m == 0, "indexing").when(m == 1, "retrieval").otherwise("generation").alias("stage"), (F.col("user_id") + F.col("event_id") % 10).cast("double").alias("seconds"), F.lit(1).alias("requests"))
    return E.stage_durations(s, ["indexing", "retrieval", "generation"])


def repeats(spark, d):
    """Repeated measures of cells from orders: customer's segment, priority and status as dimensions."""
    o = T.read(spark, d, "orders").join(T.read(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    return o.select(F.col("c_mktsegment").alias("family"), F.col("o_orderpriority").alias("context_source"), F.lit("sliding").alias("chunking_strategy"), F.col("o_orderstatus").alias("codegen_model"), F.lit("e").alias("embedding_model"), F.col("o_orderkey").alias("repeat"), (F.col("o_orderkey") % 101).cast("double").alias("score_pct"), (F.col("o_custkey") % 60).cast("double").alias("total_seconds"), (F.col("o_orderkey") % 1000).alias("total_tokens"), F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_orderkey") % 7).cast("double")).alias("cost_usd"))


REPEATS = "repeats AS (SELECT c_mktsegment AS family, o_orderpriority AS context_source, 'sliding' AS chunking_strategy, o_orderstatus AS codegen_model, 'e' AS embedding_model, o_orderkey AS repeat, CAST(o_orderkey % 101 AS DOUBLE) AS score_pct, CAST(o_custkey % 60 AS DOUBLE) AS total_seconds, o_orderkey % 1000 AS total_tokens, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 7 AS DOUBLE) END AS cost_usd FROM orders JOIN customer ON c_custkey = o_custkey), cells AS (SELECT family, context_source, chunking_strategy, codegen_model, embedding_model, avg(score_pct) AS mean_score_pct, stddev_pop(score_pct) AS stddev_score_pct, avg(total_seconds) AS mean_seconds, avg(total_tokens) AS mean_tokens, avg(cost_usd) AS mean_cost_usd FROM repeats GROUP BY ALL)"
ROUNDED = ["mean_score_pct", "stddev_score_pct", "mean_seconds", "mean_tokens", "mean_cost_usd"]


@query("EVA-13", f"WITH {REPEATS} SELECT family, context_source, chunking_strategy, codegen_model, embedding_model, {', '.join(f'round({c}, 6) AS {c}' for c in ROUNDED)} FROM cells")
def eva_13(spark, d):
    return E.matrix_cells(repeats(spark, d)).drop("repeat_scores").withColumns({c: F.round(c, 6) for c in ROUNDED})


@query("EVA-14", f"WITH {REPEATS} SELECT family, chunking_strategy, embedding_model, context_source, {', '.join(f'''round(max(mean_score_pct) FILTER (codegen_model = '{m}'), 6) AS {m}''' for m in 'FOP')} FROM cells GROUP BY ALL")
def eva_14(spark, d):
    return E.metric_grid(E.matrix_cells(repeats(spark, d)), ["F", "O", "P"]).withColumns({m: F.round(m, 6) for m in "FOP"})


DIMENSIONS = {"family": ["all"], "context_source": ["1-URGENT", "none"], "chunking_strategy": ["sliding"], "codegen_model": ["F", "O", "X"], "embedding_model": ["e"]}


def grid(spark, d):
    """All market segments of the customers by fixed lists; segments are few."""
    families = sorted(r[0] for r in T.read(spark, d, "customer").select("c_mktsegment").distinct().collect())
    return E.experiment_grid(spark, DIMENSIONS, families)


GRID = "grid AS (SELECT * FROM (SELECT DISTINCT c_mktsegment AS family FROM customer), (SELECT unnest(['1-URGENT', 'none']) AS context_source), (SELECT 'sliding' AS chunking_strategy), (SELECT unnest(['F', 'O', 'X']) AS codegen_model), (SELECT 'e' AS embedding_model))"


@query("JOI-08", f"WITH {GRID} SELECT * FROM grid")
def joi_08(spark, d):
    return grid(spark, d)


@query("EVA-15", f"WITH {REPEATS}, {GRID} SELECT family, context_source, codegen_model, round(mean_score_pct, 6) AS mean_score_pct, mean_score_pct IS NOT NULL AS is_measured FROM grid LEFT JOIN cells USING (family, context_source, chunking_strategy, codegen_model, embedding_model)")
def eva_15(spark, d):
    return E.planned_cells(grid(spark, d), E.matrix_cells(repeats(spark, d))).select("family", "context_source", "codegen_model", F.round("mean_score_pct", 6).alias("mean_score_pct"), "is_measured")


@query("EVA-16", "SELECT task_id, CAST(row_number() OVER (ORDER BY task_id) AS INTEGER) AS position FROM (SELECT doc_id AS task_id FROM labels ORDER BY md5('7' || doc_id), doc_id LIMIT 25)")
def eva_16(spark, d):
    return E.seeded_subset(T.read(spark, d, "labels").select(F.col("doc_id").alias("task_id"), F.col("doc_id").alias("position")), 25, 7)


@query("JOI-05", "SELECT coalesce(a.doc_id, b.doc_id) AS task_id, CASE WHEN a.doc_id IS NULL THEN 'base' WHEN b.doc_id IS NULL THEN 'other' END AS missing_in FROM (SELECT * FROM labels WHERE doc_id % 5 <> 0) a FULL JOIN (SELECT * FROM labels WHERE doc_id % 3 <> 0) b USING (doc_id)")
def joi_05(spark, d):
    base, other = two_runs(spark, d)
    return E.aligned(base.where("task_id % 5 <> 0"), other.where("task_id % 3 <> 0")).select("task_id", "missing_in")


# Answers


def answers(spark, d):
    return A.annotated(T.answers(spark, d))


def ans(columns: str) -> str:
    return f"WITH {T.ANSWERS} SELECT run_id, idx, {columns} FROM classed"


@query("ANS-00", ans("gold_answer, pred_answer"))
def ans_00(spark, d):
    return answers(spark, d).select("run_id", "idx", "gold_answer", "pred_answer")


@query("ANS-01", ans("CAST(numbers AS INTEGER) AS numbers, CAST(question_numbers AS INTEGER) AS question_numbers, CAST(words AS INTEGER) AS words, marker"))
def ans_01(spark, d):
    return answers(spark, d).select("run_id", "idx", "numbers", "question_numbers", "words", "marker")


@query("ANS-02", ans("multi_step, money, \"time\", distance, geometry, counting, ratio_percent"))
def ans_02(spark, d):
    return answers(spark, d).select("run_id", "idx", *A.CATEGORIES)


for _key, _column in (("ANS-03", "problem_cluster"), ("ANS-04", "error_type"), ("ANS-05", "answer_style"), ("ANS-06", "format")):
    query(_key, ans(_column))(lambda spark, d, c=_column: answers(spark, d).select("run_id", "idx", c))


@query("ANS-07", f"WITH {T.ANSWERS}, u AS (UNPIVOT (SELECT is_correct, multi_step, money, \"time\", distance, geometry, counting, ratio_percent FROM classed) ON multi_step, money, \"time\", distance, geometry, counting, ratio_percent INTO NAME category VALUE flag) SELECT category, count(*) AS n, avg(CAST(is_correct AS INTEGER)) AS accuracy FROM u WHERE flag = 1 GROUP BY 1")
def ans_07(spark, d):
    return A.category_accuracy(answers(spark, d), [])


@query("ANS-08", f"WITH {T.ANSWERS}, c AS (SELECT *, CASE WHEN question_numbers <= 2 THEN 'simple' WHEN question_numbers <= 4 THEN 'medium' ELSE 'complex' END AS complexity FROM classed) SELECT run_id, problem_cluster, complexity, count(*) AS n, avg(CAST(is_correct AS INTEGER)) AS accuracy FROM c GROUP BY GROUPING SETS ((run_id), (run_id, problem_cluster), (run_id, complexity))")
def ans_08(spark, d):
    return A.run_accuracies(answers(spark, d))


@query("ANS-09", f"WITH {T.ANSWERS}, n AS (SELECT run_id, error_type, count(*) AS n FROM classed GROUP BY ALL) SELECT r.run_id, e.error_type, coalesce(n, 0) AS n, coalesce(n / sum(n) OVER (PARTITION BY r.run_id), 0) AS share FROM (SELECT DISTINCT run_id FROM classed) r CROSS JOIN (SELECT DISTINCT error_type FROM classed) e LEFT JOIN n USING (run_id, error_type)")
def ans_09(spark, d):
    return A.distribution(answers(spark, d), "run_id", "error_type")


ALL_RUNS = f"{T.ANSWERS}, j AS (SELECT idx, 2::BIGINT AS runs, CAST(CAST(count_if(is_correct) AS BIGINT) AS BIGINT) AS \"right\" FROM classed GROUP BY 1 HAVING count(DISTINCT run_id) = 2)"


@query("JOI-06", f"WITH {ALL_RUNS} SELECT * FROM j")
def joi_06(spark, d):
    return A.in_all_runs(answers(spark, d))


@query("ANS-10", f"WITH {ALL_RUNS} SELECT idx, runs, \"right\", abs(\"right\" - runs / 2) AS lean FROM j WHERE \"right\" > 0 AND \"right\" < runs ORDER BY lean DESC, idx DESC LIMIT 50")
def ans_10(spark, d):
    return A.disagreements(answers(spark, d), 50)


@query("ANS-11", f"WITH {T.ANSWERS} SELECT run_id, format, idx, CAST(n AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY run_id, format ORDER BY idx) AS n FROM classed) WHERE n <= 3")
def ans_11(spark, d):
    return A.first_examples(answers(spark, d), ["run_id", "format"], "idx", 3).select("run_id", "format", "idx", "place")


REWARDS = rf"""{T.ANSWERS}, rewards AS (SELECT run_id, idx, l_dummy.* FROM (SELECT *, CAST(regexp_matches(completion, '\S') AS DOUBLE) AS nonempty, CAST(regexp_matches(completion, '-?\d+(?:\.\d+)?') AS DOUBLE) AS has_number, CAST(regexp_matches(completion, '####\s*-?\d') AS DOUBLE) AS has_final_marker,
CAST(len(list_filter(string_split(completion, E'\n'), lambda x: regexp_matches(x, '\S'))) >= 2 OR regexp_matches(completion, '<<|>>|=') AS DOUBLE) AS worked_solution, CAST(NOT is_correct AND coalesce(p = g OR p = g + 1 OR p = g - 1 OR (g <> 0 AND abs(p - g) * 10 <= abs(g)), false) AS DOUBLE) AS near_match, CAST(is_correct AS DOUBLE) AS exact_match FROM classed) l_dummy)""".replace("SELECT run_id, idx, l_dummy.* FROM", "SELECT * FROM")


def rewards(spark, d):
    return answers(spark, d).withColumns(A.reward_components())


@query("ANS-12", f"WITH {REWARDS} SELECT run_id, idx, {', '.join(A.COMPONENTS)} FROM rewards")
def ans_12(spark, d):
    return rewards(spark, d).select("run_id", "idx", *A.COMPONENTS)


TOTALS = ", ".join(f"round({' + '.join(f'{w}::DOUBLE * {c}' for c, w in ws.items())}, 6) AS {name}" for name, ws in A.REWARD_WEIGHTS.items())


@query("ANS-13", f"WITH {REWARDS} SELECT run_id, idx, {TOTALS} FROM rewards")
def ans_13(spark, d):
    return rewards(spark, d).select("run_id", "idx", *[F.round(A.reward_total(s), 6).alias(s) for s in A.REWARD_WEIGHTS])


COMBINED = " + ".join(f"{w}::DOUBLE * {c}" for c, w in A.REWARD_WEIGHTS["combined"].items())


@query("ANS-14", f"WITH {REWARDS} SELECT idx % 10 AS step, round(avg({COMBINED}), 6) AS reward, {', '.join(f'round(avg({c}), 6) AS {c}' for c in A.COMPONENTS)} FROM rewards GROUP BY 1")
def ans_14(spark, d):
    r = rewards(spark, d).withColumns({"step": F.col("idx") % 10, "reward": A.reward_total("combined")})
    return A.reward_by_step(r).select("step", F.round("reward", 6).alias("reward"), *[F.round(c, 6).alias(c) for c in A.COMPONENTS])


@query("ANS-15", f"WITH {REWARDS} SELECT run_id, idx, round(({COMBINED}) - avg({COMBINED}) OVER (PARTITION BY idx), 6) + 0.0 AS advantage FROM rewards")
def ans_15(spark, d):
    r = rewards(spark, d).withColumn("reward", A.reward_total("combined"))
    return r.select("run_id", "idx", (F.round(A.advantage(F.col("reward"), "idx"), 6) + 0.0).alias("advantage"))


@query("ANS-16", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean FROM events")
def ans_16(spark, d):
    return T.read(spark, d, "events").select("event_id", F.round(A.rolling_mean("value", "event_id", 5, ["user_id"]), 6).alias("mean"))


METRICS = ["click", "view", "purchase", "signup", "logout"]


@query("ANS-17", "WITH m AS (SELECT event_type AS metric, CAST(user_id % 4 AS VARCHAR) AS run_id, avg(value / 1000) AS v FROM events GROUP BY ALL) SELECT run_id, round(sum(CASE WHEN metric = (SELECT min(event_type) FROM events) THEN (v - 0.25) / 0.75 ELSE v END) / count(*), 6) AS centred_mean FROM m GROUP BY 1")
def ans_17(spark, d):
    e = T.read(spark, d, "events")
    metrics = sorted(r[0] for r in e.select("event_type").distinct().collect())  # a metric for each of a few event types
    rows = e.select((F.col("user_id") % 4).cast("string").alias("run_id"), F.col("event_type").alias("metric"), (F.col("value") / 1000).alias("value"))
    return A.metric_table(rows, metrics, {metrics[0]: 0.25}).select("run_id", F.round("centred_mean", 6).alias("centred_mean"))


# Chat


@query("CHT-01", "SELECT conv_id, turn, CASE WHEN lower(role) IN ('user', 'human') THEN 'user' WHEN lower(role) IN ('assistant', 'gpt', 'model') THEN 'assistant' WHEN lower(role) = 'system' THEN 'system' END AS role FROM conversations")
def cht_01(spark, d):
    return T.read(spark, d, "conversations").select("conv_id", "turn", chat.role_of(F.col("role")).alias("role"))


@query("CHT-02", "SELECT conv_id, turn, md5(trim(text)) AS content FROM conversations")
def cht_02(spark, d):
    c = T.read(spark, d, "conversations")
    kind = F.col("turn") % 3
    wrapped = F.when(kind == 0, F.to_json(F.struct("text"))).when(kind == 1, F.to_json(F.array(F.struct(F.col("text").alias("content"))))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", F.md5(chat.flat_content(wrapped).cast("binary")).alias("content"))


@query("CHT-03", """WITH m AS (SELECT conv_id, turn, role, trim(text) AS text FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> ''),
i AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS isle FROM (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS DISTINCT FROM role THEN 1 ELSE 0 END AS new FROM m)),
g AS (SELECT conv_id, CAST(isle - 1 AS INTEGER) AS place, role, string_agg(text, E'\\n\\n' ORDER BY turn) AS content FROM i GROUP BY ALL),
e AS (SELECT *, max(CASE WHEN place = 0 THEN role END) OVER (PARTITION BY conv_id) AS f, max(place) OVER (PARTITION BY conv_id) AS l FROM g)
SELECT conv_id, place, role, content FROM e WHERE f = 'user' AND l - CASE WHEN l % 2 = 0 THEN 1 ELSE 0 END >= 1 AND place <= l - CASE WHEN l % 2 = 0 THEN 1 ELSE 0 END""")
def cht_03(spark, d):
    return chat.clean_messages(T.read(spark, d, "conversations"))


@query("CHT-04", "SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations) ORDER BY md5('3' || conv_id), conv_id LIMIT 40")
def cht_04(spark, d):
    return chat.seeded_sample(T.read(spark, d, "conversations").select("conv_id").distinct(), "conv_id", 40, 3).select("conv_id")


# Text functions


@query("FLT-03", "SELECT user_id, list_distinct_ordered AS sources FROM (SELECT user_id, list_transform(list_sort(list(DISTINCT event_id)), lambda x: 'k' || (x % 3)) AS l FROM events GROUP BY 1) t, LATERAL (SELECT list_filter(t.l, lambda x, i: list_position(t.l, x) = i) AS list_distinct_ordered)")
def flt_03(spark, d):
    e = T.read(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_set("event_id")), lambda x: F.concat(F.lit("k"), x % 3)).alias("l"), F.lit(5).alias("k"))
    return e.where(text.bounded_top_k(F.col("k"), 1, 100) > 0).select("user_id", text.requested_sources(F.col("l")).alias("sources"))


@query("FLT-04", "SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS snippet FROM documents")
def flt_04(spark, d):
    return T.read(spark, d, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


REFERENCES = "refs AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'https://github.com/Own/C' || c_custkey || '.git' WHEN 1 THEN 'GitHub.com/Own/' || c_custkey WHEN 2 THEN ' Own/Rep' || c_custkey || '/tree ' WHEN 3 THEN 'https://example.org/a/b' WHEN 4 THEN 'alone' ELSE 'http://www.github.com/Own/x' || c_custkey || '?q=1' END AS ref FROM customer)"


@query("FLT-05", f"WITH {REFERENCES} SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'own/' || lower(replace(ref, 'https://github.com/Own/', '')[:-5]) WHEN 1 THEN 'own/' || c_custkey WHEN 2 THEN 'own/rep' || c_custkey WHEN 5 THEN 'own/x' || c_custkey END AS full_name FROM refs")
def flt_05(spark, d):
    c, m = T.read(spark, d, "customer"), F.col("c_custkey") % 6
    ref = F.when(m == 0, F.concat(F.lit("https://github.com/Own/C"), "c_custkey", F.lit(".git"))).when(m == 1, F.concat(F.lit("GitHub.com/Own/"), "c_custkey")).when(m == 2, F.concat(F.lit(" Own/Rep"), "c_custkey", F.lit("/tree "))).when(m == 3, "https://example.org/a/b").when(m == 4, "alone").otherwise(F.concat(F.lit("http://www.github.com/Own/x"), "c_custkey", F.lit("?q=1")))
    return c.select("c_custkey", text.repository_name(ref).alias("full_name"))


@query("FLT-06", "SELECT o_custkey, list_concat(['main'], list_filter(l, lambda x, i: list_position(l, x) = i AND x <> 'main')) AS branches FROM (SELECT o_custkey, list_filter(list_transform(list(CASE WHEN o_orderkey % 5 = 0 THEN ' main ' ELSE ' ' || o_orderpriority END ORDER BY o_orderkey), lambda x: trim(x)), lambda x: x <> '') AS l FROM orders GROUP BY 1)")
def flt_06(spark, d):
    o = T.read(spark, d, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, " main ").otherwise(F.concat(F.lit(" "), "o_orderpriority")).alias("b")))), lambda x: x["b"]).alias("l"))
    return o.select("o_custkey", text.default_first(F.lit("main"), text.branch_names(F.col("l"))).alias("branches"))


@query("FLT-07", "SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'x') AS slug FROM part")
def flt_07(spark, d):
    return T.read(spark, d, "part").select("p_partkey", text.slug(F.concat_ws(" ", "p_name", "p_type")).alias("slug"))


@query("FLT-08", r"WITH RECURSIVE s AS (SELECT doc_id, text AS t, 0 AS i FROM documents UNION ALL SELECT doc_id, CASE WHEN length(t) > 1000 THEN substr(t, 1, (greatest(CAST(floor(length(t) * 0.75) AS BIGINT), 256) - 5) // 2) || E'\n...\n' || right(t, greatest(CAST(floor(length(t) * 0.75) AS BIGINT), 256) - 5 - (greatest(CAST(floor(length(t) * 0.75) AS BIGINT), 256) - 5) // 2) ELSE t END, i + 1 FROM s WHERE i < 8) SELECT doc_id, md5(t) AS shortened FROM s WHERE i = 8")
def flt_08(spark, d):
    return T.read(spark, d, "documents").select("doc_id", F.md5(text.shorten(F.col("text"), 1000).cast("binary")).alias("shortened"))


@query("FLT-09", r"SELECT item_id, trim('T' || item_id || E'\n' || text || CASE WHEN item_id % 2 = 0 THEN E'\nRelevant APIs: a, b' ELSE '' END || CASE WHEN item_id % 3 = 0 THEN E'\nFailing test context: ctx' ELSE '' END || E'\nLikely relevant symbols: s') AS query FROM benchmark")
def flt_09(spark, d):
    apis = F.when(F.col("item_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    context = F.when(F.col("item_id") % 3 == 0, "ctx").otherwise("")
    return T.read(spark, d, "benchmark").select("item_id", text.search_query(F.concat(F.lit("T"), "item_id"), F.col("text"), apis, context, F.array(F.lit("s"))).alias("query"))


BLOCKS = {
    "code": "'[' || n || '] doc/' || doc_id || '.txt lines ' || n || '-' || (n + 1) || CASE WHEN doc_id % 3 = 0 THEN E'\\nreason: seen' ELSE '' END || E'\\n' || regexp_replace(text, '\\s+$', '')",
    "wiki": "'[' || n || '] t' || doc_id || CASE WHEN doc_id % 2 = 0 THEN ' in s' ELSE '' END || E'\\n' || regexp_replace(text, '\\s+$', '')",
}
BLOCKS["fused"] = f"CASE WHEN doc_id % 2 = 1 THEN {BLOCKS['wiki']} ELSE {BLOCKS['code']} END"


def _prompt_sql(kind: str) -> str:
    above, none = prompting.KINDS[kind]
    return f"""WITH r AS (SELECT doc_id, text, doc_id % 97 AS query_id, row_number() OVER (PARTITION BY doc_id % 97 ORDER BY doc_id) AS n FROM documents WHERE doc_id % 97 < 40), b AS (SELECT query_id, string_agg({BLOCKS[kind]}, E'\\n\\n' ORDER BY n) AS body FROM r WHERE n <= 5 GROUP BY 1)
SELECT item_id AS query_id, md5('Task ' || item_id || E'\\n\\n' || '{above}' || E'\\n' || coalesce(body, '{none}') || CASE WHEN item_id % 2 = 0 THEN E'\\n\\nAnswer with a patch.' ELSE '' END) AS prompt FROM benchmark LEFT JOIN b ON query_id = item_id"""


def ranked_snippets(spark, d):
    """Five documents for each of some tasks, as code or as pages."""
    n = F.col("doc_id")
    rows = T.read(spark, d, "documents").where(n % 97 < 40).withColumn("rank", F.row_number().over(Window.partitionBy(n % 97).orderBy("doc_id"))).where("rank <= 5")
    return rows.select((n % 97).alias("query_id"), "rank", F.when(n % 2 == 1, "wiki").otherwise("code").alias("corpus"), F.concat(F.lit("doc/"), n, F.lit(".txt")).alias("file_path"), F.col("rank").alias("start_line"), (F.col("rank") + 1).alias("end_line"), F.concat(F.lit("t"), n).alias("title"), F.when(n % 2 == 0, "s").otherwise("").alias("section_path"), F.col("text").alias("content"), F.when(n % 3 == 0, " seen ").otherwise(" ").alias("reason"))


def prompt_query(kind: str):
    def run(spark, d):
        tasks = T.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("Task "), "item_id").alias("head"), F.when(F.col("item_id") % 2 == 0, "Answer with a patch.").alias("tail"))
        return prompting.prompts(tasks, ranked_snippets(spark, d), kind).select("query_id", F.md5(F.col("prompt").cast("binary")).alias("prompt"))

    return run


for _kind in prompting.KINDS:
    query("FLT-10" if _kind == "code" else f"FLT-10-{_kind}", _prompt_sql(_kind))(prompt_query(_kind))


@query("FLT-10-turns", r"SELECT conv_id, 'Task ' || conv_id || E'\n' || string_agg('[' || turn || '] ' || text, E'\n' ORDER BY turn) AS prompt FROM conversations GROUP BY 1")
def flt_10_turns(spark, d):
    c = T.read(spark, d, "conversations")
    return listed(c.select(F.col("conv_id").alias("query_id")).distinct().withColumn("head", F.concat(F.lit("Task "), "query_id")), c.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.concat(F.lit("["), "turn", F.lit("] "), "text").alias("block"))).select(F.col("query_id").alias("conv_id"), "prompt")


def listed(tasks, snippets, none: str = "(no context retrieved)"):
    """A head and the blocks under it in order. A conversation makes one prompt."""
    blocks = snippets.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n").alias("body"))
    return tasks.join(blocks, "query_id", "left").withColumn("prompt", F.concat_ws("\n", "head", F.coalesce("body", F.lit(none))))


def model_outputs(spark, d):
    """Model answers that hold a patch of all lines of a document, as a tag, a fence or bare."""
    lines = F.split("text", "\n")
    body = F.concat(F.lit("--- a/f.txt\n+++ b/f"), F.col("doc_id"), F.lit(".txt\n@@ -1,9 +1,9 @@\n"), F.array_join(F.transform(lines, lambda x, i: F.concat(F.when(i == 1, "-").when(i == 2, "+").otherwise(""), x)), "\n"))
    m = F.col("doc_id") % 3
    return T.read(spark, d, "documents").select("doc_id", F.when(m == 0, F.concat(F.lit("Here:\n<diff>"), body, F.lit("</diff> done"))).when(m == 1, F.concat(F.lit("```text\nno\n```\n```diff\n"), body, F.lit("\n```"))).otherwise(F.concat(body, F.lit("</s> trailing"))).alias("response"))


@query("FLT-11")
def flt_11(spark, d):
    return model_outputs(spark, d).select("doc_id", text.model_patch(F.col("response")).alias("patch"))


@query("FLT-12")
def flt_12(spark, d):
    from corvane.operators.patches import recounted

    return recounted(flt_11(spark, d), "doc_id")


@query("FLT-13", "SELECT doc_id, ['f' || doc_id || '.txt'] AS paths FROM documents")
def flt_13(spark, d):
    return flt_11(spark, d).select("doc_id", text.touched_paths(F.col("patch")).alias("paths"))


@query("FLT-14", "SELECT conv_id, CASE WHEN max(turn) % 2 = 0 THEN list('t' || turn ORDER BY turn) WHEN conv_id % 2 = 1 THEN ['all'] ELSE [] END AS failing FROM conversations GROUP BY conv_id")
def flt_14(spark, d):
    c = T.read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"), F.max("turn").alias("m"))
    out = F.array_join(F.transform("turns", lambda t: F.concat(F.when(F.col("m") % 2 == 0, F.when(t % 2 == 0, "  FAILED t").otherwise("ERROR t")).otherwise("PASSED t"), t.cast("string"), F.lit(" - reason"))), "\n")
    return c.select("conv_id", text.failing_tests(out, F.array(F.lit("all")), F.col("conv_id") % 2).alias("failing"))


@query("FLT-15", "SELECT l_returnflag, l_linestatus, 'openai' AS provider, 'm-' || lower(l_returnflag) || '/x' AS model FROM lineitem GROUP BY ALL")
def flt_15(spark, d):
    provider, model = text.provider_and_model(F.concat(F.lit(" OpenAI/m-"), F.lower("l_returnflag"), F.lit("/x ")))
    return T.read(spark, d, "lineitem").select("l_returnflag", "l_linestatus", provider.alias("provider"), model.alias("model")).distinct()


@query("FLT-16", r"SELECT doc_id, CASE WHEN length(t) <= 120 THEN t ELSE substr(t, 1, 117) || '...' END AS preview FROM (SELECT doc_id, trim(replace(text, E'\n', ' ')) AS t FROM documents)")
def flt_16(spark, d):
    return T.read(spark, d, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"))
