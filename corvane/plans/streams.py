"""Queries on push events and on file formats, which Spark writes from the given tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import evaluation as E
from corvane.operators.versioning import branch_states
from corvane.plans import tables as T
from corvane.plans.indexing import STATES_SQL, status_events, written_out
from corvane.sources import files as S
from corvane.sources.scratch import scratch
from corvane.streaming import push

QUERIES, SQL = {}, {}


def query(key: str, sql: str | None = None):
    def added(f):
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return added


def payloads(spark, d):
    m = F.col("event_id") % 6
    repo = F.struct(F.col("user_id").alias("id"), F.concat(F.lit("own/r"), "user_id").alias("full_name"), F.lit("u").alias("clone_url"))
    body = F.struct(F.when(m == 0, F.concat(F.lit("refs/tags/"), "event_type")).otherwise(F.concat(F.lit("refs/heads/"), "event_type")).alias("ref"), F.concat(F.lit("b"), "event_id").alias("before"), F.when(m != 1, F.concat(F.lit("c"), "event_id")).alias("after"), repo.alias("repository"))
    return T.read(spark, d, "events").select("event_id", "ts", F.when(m == 2, "ping").otherwise("push").alias("kind"), F.to_json(body).alias("payload"))


@query("STR-01", "SELECT event_id, user_id AS repository_id, CASE WHEN event_id % 6 = 0 THEN '' ELSE event_type END AS branch, CASE WHEN event_id % 6 <> 1 THEN 'c' || event_id END AS after_commit, CASE event_id % 6 WHEN 2 THEN 'not a push' WHEN 0 THEN 'not a branch' WHEN 1 THEN 'fields are missing' END AS rejected FROM events")
def str_01(spark, d):
    return push.parsed(payloads(spark, d), F.col("kind"), F.col("payload")).select("event_id", "repository_id", "branch", "after_commit", "rejected")


def pushes(spark, d):
    e = T.read(spark, d, "events")
    return e.select(F.col("user_id").alias("repository_id"), F.col("event_type").alias("branch"), F.concat(F.lit("b"), "event_id").alias("before_commit"), F.concat(F.lit("c"), "event_id").alias("after_commit"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("push_id"))


@query("STR-02", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS session FROM g)
SELECT user_id AS repository_id, event_type AS branch, 'c' || arg_max(event_id, {'a': ts, 'b': event_id}) AS after_commit, 'b' || arg_min(event_id, {'a': ts, 'b': event_id}) AS before_commit, count(*) AS pushes FROM s GROUP BY user_id, event_type, session""")
def str_02(spark, d):
    return push.coalesced(pushes(spark, d), "1 hour").select("repository_id", "branch", "after_commit", "before_commit", "pushes")


@query("STR-03")
def str_03(spark, d):
    """A file-source stream of pushes by source and language, each batch indexed; the pointers that result."""
    files = T.files(spark, d).select("repository_id", "branch", "file_path", "content")
    work = scratch(spark, "str03")
    files.select("repository_id", "branch").distinct().write.parquet(f"{work}/pushes")
    stream = spark.readStream.schema("repository_id string, branch string").parquet(f"{work}/pushes")
    q = stream.writeStream.foreachBatch(push.incremental_index(files, f"{work}/store")).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return push.pointer_log(spark, f"{work}/store").drop("batch")


@query("STR-03-pushes", r"SELECT source AS repository_id, lang AS branch, 'doc/' || doc_id || '.txt' AS file_path, coalesce(regexp_matches(text, '\S'), false) AS active FROM documents")
def str_03_pushes(spark, d):
    """A stream of pushes that each name a document, coalesced by branch and indexed; a last push closes the sessions before it."""
    files = T.files(spark, d)
    work = scratch(spark, "str03")
    n = F.col("doc_id")
    one = files.select("repository_id", "branch", F.lit("b").alias("before_commit"), F.concat(F.lit("c"), n).alias("after_commit"), F.timestamp_seconds(1_000_000 + n * 600).alias("ts"), n.alias("push_id"), F.array("file_path").alias("changed_files"))
    end = files.agg((F.max("doc_id") + 10_000).alias("n")).select(F.lit("end").alias("repository_id"), F.lit("end").alias("branch"), F.lit("b").alias("before_commit"), F.lit("c").alias("after_commit"), F.timestamp_seconds(1_000_000 + F.col("n") * 600).alias("ts"), F.col("n").alias("push_id"), F.array().cast("array<string>").alias("changed_files"))
    one.write.parquet(f"{work}/pushes")
    end.write.mode("append").parquet(f"{work}/pushes")
    stream = spark.readStream.schema(one.schema).parquet(f"{work}/pushes")
    push.index_pushes(stream, files.select("repository_id", "branch", "file_path", "content"), f"{work}/store", f"{work}/checkpoint", "1 hour").awaitTermination()
    return push.pointer_log(spark, f"{work}/store").select("repository_id", "branch", "file_path", F.col("active_publish_id").isNotNull().alias("active"))


@query("STR-04", STATES_SQL)
def str_04(spark, d):
    """The states that a stream of status events ends in."""
    work = scratch(spark, "str04")
    status_events(spark, d).write.parquet(f"{work}/events")
    events = spark.readStream.schema("repository_id string, branch string, status string, latest_commit string, target_commit string, ts timestamp").parquet(f"{work}/events")
    name = "str04_" + work.rsplit("-", 1)[-1].replace("/", "_")

    def keep(batch, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{work}/out/batch={batch_id}")

    q = push.branch_state_stream(events).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{work}/checkpoint").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{work}/out")
    return written_out(push.latest_states(out))


@query("STR-04-batch", STATES_SQL)
def str_04_batch(spark, d):
    return written_out(branch_states(status_events(spark, d)))


@query("SRC-06", "SELECT 't' || (doc_id % 100) AS task_id, 'p' || max(doc_id) AS model_patch, CASE WHEN max(doc_id) % 2 = 0 THEN max(doc_id) END AS input_tokens FROM documents GROUP BY 1")
def src_06(spark, d):
    work = scratch(spark, "src06")
    n = F.col("doc_id").cast("string")
    rows = T.read(spark, d, "documents").select("doc_id", F.to_json(F.struct(F.concat(F.lit(" t"), F.col("doc_id") % 100).alias("task_id"), F.concat(F.lit("p"), n).alias("model_patch"), F.when(F.col("doc_id") % 2 == 0, n).otherwise("none").alias("input_tokens"))).alias("value"))
    rows.repartitionByRange(1, "doc_id").sortWithinPartitions("doc_id").select(F.concat("value", F.lit("\n")).alias("value")).write.text(f"{work}/p.jsonl")
    return S.predictions(spark, f"{work}/p.jsonl").select("task_id", "model_patch", "input_tokens")


@query("SRC-07", f"WITH {T.RESULTS} SELECT run_id, count(*) AS total, CAST(count_if(resolved) AS BIGINT) AS resolved FROM results GROUP BY 1")
def src_07(spark, d):
    work = scratch(spark, "src07")
    # a folder for each run and slice of tasks; the reader takes the run from the path
    rows = T.results(spark, d).withColumns({"run": F.col("run_id"), "task_id": F.col("task_id").cast("string")})
    for run in ("base", "other"):
        rows.where(F.col("run_id") == run).drop("run_id", "run").write.json(f"{work}/{run}/tasks/all")
    found = S.task_results(spark, f"{work}/*/tasks/*", multi_line=False)
    return E.run_summary(found).select("run_id", "total", "resolved")


@query("SRC-08", f"WITH {T.RESULTS} SELECT CAST(task_id AS VARCHAR) AS task_id, patch_exists, patch_applied, resolved, list_filter(pytest_targets, lambda t: list_contains(failing_tests, t)) AS fail_to_pass_failures FROM results WHERE run_id = 'base'")
def src_08(spark, d):
    r = E.fail_to_pass(T.results(spark, d).where("run_id = 'base'"))
    one = F.struct("patch_exists", F.col("patch_applied").alias("patch_successfully_applied"), "resolved", F.struct(F.struct(F.col("fail_to_pass_successes").alias("success"), F.col("fail_to_pass_failures").alias("failure")).alias("FAIL_TO_PASS")).alias("tests_status"))
    reports = r.select(F.to_json(F.map_from_arrays(F.array(F.col("task_id").cast("string")), F.array(one))).alias("value"))
    return S.report(reports).select("task_id", "patch_exists", "patch_applied", "resolved", "fail_to_pass_failures")


@query("SRC-09", "SELECT 't' || item_id AS task_id, 'repo_a_id must be positive' AS rule FROM benchmark WHERE item_id % 5 = 0 UNION ALL SELECT 't' || item_id, 'title is required' FROM benchmark WHERE item_id % 7 = 0")
def src_09(spark, d):
    work = scratch(spark, "src09")
    b = T.read(spark, d, "benchmark")
    task = F.struct(F.concat(F.lit("t"), "item_id").alias("task_id"), F.lit("x").alias("task_type"), F.when(F.col("item_id") % 7 != 0, "title").alias("title"), F.col("text").alias("problem_statement"), (F.col("item_id") % 5).alias("repo_a_id"), F.lit(1).alias("repo_b_id"), F.array(F.lit("t::a")).alias("pytest_targets"))
    b.groupBy((F.col("item_id") % 10).alias("family")).agg(F.lit("1").alias("version"), F.collect_list(task).alias("tasks")).write.json(f"{work}/m")
    return S.manifest_errors(spark.read.schema(S.MANIFEST).json(f"{work}/m").select(F.explode("tasks").alias("t")).select("t.*"))


@query("SRC-09-config", "SELECT CAST(item_id % 10 AS BIGINT) AS family, rule FROM (SELECT item_id, unnest(['task_count differs from the config', 'seed differs from the config', 'python_version_target differs from the config']) AS rule FROM benchmark WHERE item_id % 10 = item_id) WHERE rule[1:1] = 't' OR (rule[1:1] = 's' AND item_id % 2 = 1) OR (rule[1:1] = 'p' AND item_id % 3 = 0)")
def src_09_config(spark, d):
    """Manifests that differ from their config: all in the number of tasks, some in the seed or the version."""
    work = scratch(spark, "src09")
    n = F.col("item_id")
    own = F.struct(F.lit("fix").alias("task_type"), (F.lit(100) + n).alias("task_count"), F.lit(1).alias("shared_library_repo_count"), F.lit("one").alias("consumer_repo_mode"), F.when(n % 3 != 0, "3.13").alias("python_version_target"), F.array(F.lit("none"), F.lit("code")).alias("context_modes"), (n % 2).alias("seed"))
    T.read(spark, d, "benchmark").where("item_id % 10 = item_id").select(n.cast("string").alias("family"), own.alias("generation_config")).write.json(f"{work}/m")
    config = {"task_type": "fix", "task_count": 10, "shared_library_repo_count": 1, "consumer_repo_mode": "one", "python_version_target": "3.13", "context_modes": ["none", "code"], "seed": 0}
    return S.config_errors(spark.read.schema(S.MANIFEST).json(f"{work}/m"), config).withColumn("family", F.col("family").cast("long"))


@query("SRC-11", f"WITH {T.ANSWERS} SELECT run_id, idx, completion, multi_step, money FROM classed")
def src_11(spark, d):
    from corvane.operators.answers import annotated

    work = scratch(spark, "src11")
    annotated(T.answers(spark, d)).select("run_id", "idx", F.concat(F.lit("|"), "completion").alias("completion"), "multi_step", "money").write.option("header", "true").option("escape", '"').option("quoteAll", "true").csv(f"{work}/a")
    return S.answer_records(spark, f"{work}/a", ["multi_step", "money"]).select("run_id", F.col("idx").cast("long").alias("idx"), F.substring("completion", 2, 1 << 30).alias("completion"), "multi_step", "money")


@query("SRC-12", "SELECT 'p' AS provider, 'm' || p_partkey AS model, CASE WHEN p_partkey % 3 = 0 THEN '*' ELSE 'r' || (p_partkey % 3) END AS region, CAST(p_size AS DOUBLE) AS input_rate FROM part")
def src_12(spark, d):
    rate = F.struct(F.col("p_size").cast("double").alias("generation_input_per_million_usd"))
    m = F.col("p_partkey") % 3
    model = F.struct(F.when(m == 0, F.col("p_size").cast("double")).alias("generation_input_per_million_usd"), F.when(m != 0, F.map_from_arrays(F.array(F.concat(F.lit("r"), m)), F.array(rate))).alias("regions"))
    rows = T.read(spark, d, "part").select(F.lit("p").alias("provider"), F.to_json(F.struct(F.map_from_arrays(F.array(F.concat(F.lit("m"), "p_partkey")), F.array(model)).alias("models"))).alias("value"))
    return S.pricing(rows).select("provider", "model", "region", "input_rate")


@query("SRC-13-table", """WITH c AS (SELECT source, count(*)::VARCHAR AS documents, coalesce(CAST(CAST(sum(n_chars) AS BIGINT) AS VARCHAR), '-') AS characters FROM documents GROUP BY 1), w AS (SELECT greatest(6, max(length(source))) AS a, greatest(9, max(length(documents))) AS b, greatest(10, max(length(characters))) AS c FROM c),
t AS (SELECT 0 AS line_no, 'source' AS x, 'documents' AS y, 'characters' AS z UNION ALL SELECT 1, repeat('-', a), repeat('-', b), repeat('-', w.c) FROM w UNION ALL SELECT 1 + row_number() OVER (ORDER BY source), source, documents, characters FROM c)
SELECT CAST(line_no AS BIGINT) AS line_no, rtrim(rpad(x, CAST(a AS INTEGER), ' ') || '  ' || rpad(y, CAST(b AS INTEGER), ' ') || '  ' || rpad(z, CAST(w.c AS INTEGER), ' ')) AS line FROM t, w""")
def src_13_table(spark, d):
    """Sources with their documents as lines of text."""
    rows = T.read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("characters"))
    return S.text_table(rows, ["source"])


@query("SRC-13", "SELECT item_id, text FROM benchmark")
def src_13(spark, d):
    """A round trip."""
    work = scratch(spark, "src13")
    S.write_json(T.read(spark, d, "benchmark"), f"{work}/out")
    return spark.read.schema("item_id long, text string").json(f"{work}/out")
