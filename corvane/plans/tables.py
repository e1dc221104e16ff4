"""The logical tables that queries run on, made from the given ones; each as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.chunking import sliding_windows, structural_blocks

MAX_LINES, OVERLAP = 20, 5


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("repository_id"), F.col("lang").alias("branch"), F.concat(F.lit("doc/"), "doc_id", F.lit(".txt")).alias("file_path"), F.col("text").alias("content"), "doc_id")


def structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural chunks of all files, which are prose."""
    f = files(spark, sf_dir).drop("doc_id").withColumn("language", F.lit("prose"))
    return structural_blocks(f, BUDGET).drop("language")


def _versions() -> F.Column:
    """Rule of the test tables: by doc_id % 4 legacy; v1 and v2; v2; v1."""
    m = F.col("doc_id") % 4
    return F.when(m == 0, F.array(F.lit("legacy"))).when(m == 1, F.array(F.lit("v1"), F.lit("v2"))).when(m == 2, F.array(F.lit("v2"))).otherwise(F.array(F.lit("v1")))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(sliding_windows(files(spark, sf_dir), MAX_LINES, OVERLAP).withColumn("publish_id", F.explode(_versions())))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with the versions that have them, uncut."""
    return files(spark, sf_dir).withColumn("versions", _versions())


def keyed(d: DataFrame) -> DataFrame:
    """Chunks with their ids."""
    key = F.concat_ws("|", "repository_id", "branch", "file_path", F.col("start_line").cast("string"), "publish_id")
    return d.withColumn("chunk_id", F.md5(key.cast("binary")))


def pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("doc_id") % 4
    return files(spark, sf_dir).where(m != 0).select("repository_id", "branch", "file_path", F.when(m != 3, "v2").alias("active_publish_id"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", F.col("label").alias("repository_id"))


def wiki_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "pages")
    return d.select("page_id", F.col("url").alias("slug"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("section_path"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.col("html").alias("content"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the labelled documents: quality is the base's resolution, toxic the other's."""
    d = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("task_id"), F.explode(F.array(F.struct(F.lit("base").alias("run_id"), (F.col("quality") == 1).alias("resolved")), F.struct(F.lit("other").alias("run_id"), (F.col("toxic") == 1).alias("resolved")))).alias("r"))
    m = F.col("task_id") % 7
    d = d.select("task_id", "r.run_id", "r.resolved", (m != 0).alias("prediction_present"), (m > 1).alias("patch_exists"), (m > 2).alias("patch_applied"))
    tests = lambda n: F.transform(F.sequence(F.lit(0), n), lambda i: F.concat(F.lit("t"), i.cast("string")))
    return d.withColumns({"pytest_targets": tests(F.lit(3)), "failing_tests": F.when(F.col("resolved"), F.array().cast("array<string>")).otherwise(tests(((F.col("task_id") + F.length("run_id")) % 3).cast("int")))})


def runs(spark: SparkSession, sf_dir: str, every: int = 1) -> DataFrame:
    """Five repeats over sources, which change with every so many documents: a task is a source, resolved where most of its documents of the repeat are good."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    return d.groupBy(F.col("source").alias("task_id"), (F.floor(F.col("doc_id") / every) % 5).alias("run_id")).agg((F.avg("quality") >= 0.85).alias("resolved"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation calls from order lines."""
    d = read(spark, sf_dir, "lineitem")
    m = F.col("l_partkey") % 11
    return d.select(F.concat(F.lit("openai/m-"), F.lower("l_returnflag")).alias("model_name"), F.concat(F.lit("r-"), F.lower("l_linestatus")).alias("region"), (F.col("l_quantity").cast("long") * 10).alias("input_tokens"), F.when(m != 0, F.col("l_quantity").cast("long")).alias("output_tokens"), (F.col("l_quantity").cast("long") * 11).alias("total_tokens"), (F.col("l_quantity") * 0.5).alias("latency_ms"))


def rates(spark: SparkSession) -> DataFrame:
    """A pricing table of three models."""
    return spark.createDataFrame([("m-a", "r-f", 2.0, 8.0), ("m-a", "*", 1.0, 4.0), ("m-n", "*", 0.5, 1.5), ("m-r", "r-o", 3.0, 9.0)], "model string, region string, input_rate double, output_rate double")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer records from order lines, with right, near and missing answers; two runs."""
    d = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_size"), "l_partkey")
    q, line = F.col("l_quantity").cast("long"), F.col("l_linenumber")
    s = lambda c: c.cast("string")
    m = (F.col("l_orderkey") + line) % 9
    words = F.element_at(F.array(*map(F.lit, ["how many dollars per day", "the area of a square", "cost in percent", "altogether", "miles each hour", "what is it"])), (F.col("l_orderkey") % 6 + 1).cast("int"))
    question = F.concat(F.lit("Take "), s(q), F.lit(" of "), "p_name", F.lit(" and "), s(F.col("p_size")), F.lit(": "), words, F.lit("?"))
    guess = F.when(m == 0, q + 1).when(m == 1, -q).when(m == 2, q * 20).when(m == 3, q + 2).otherwise(q)
    completion = F.when(m == 4, "").when(m == 5, F.concat(F.lit("It is "), s(q))).when(m == 6, F.lit("no idea")).when(m == 7, F.concat(F.lit("<<"), s(q), F.lit(">>\n#### "), s(q))).otherwise(F.concat(F.lit("So we get\n#### "), s(guess)))
    return d.select(F.when(line % 2 == 0, "a").otherwise("b").alias("run_id"), (F.col("l_orderkey") * 4 + F.floor((line - 1) / 2)).cast("long").alias("idx"), question.alias("question"), F.concat(F.lit("#### "), s(q)).alias("gold_text"), completion.alias("completion"))


FILES = "files AS (SELECT source AS repository_id, lang AS branch, 'doc/' || doc_id || '.txt' AS file_path, text AS content, doc_id FROM documents)"
WINDOWS = rf"""{FILES},
file_lines AS (SELECT *, regexp_extract_all(content, '[^\n]*\n|[^\n]+$') AS ls FROM files WHERE regexp_matches(content, '\S')),
starts AS (SELECT *, unnest(range(0, CAST(greatest(0, ceil((len(ls) - {MAX_LINES}) / {float(MAX_LINES - OVERLAP)})) AS BIGINT) * {MAX_LINES - OVERLAP} + 1, {MAX_LINES - OVERLAP})) AS s FROM file_lines),
windows AS (SELECT repository_id, branch, file_path, doc_id, CAST(s + 1 AS INTEGER) AS start_line, CAST(least(s + {MAX_LINES}, len(ls)) AS INTEGER) AS end_line, array_to_string(ls[s + 1:s + {MAX_LINES}], '') AS content FROM starts)"""
BUDGET = 500
#: Blocks of prose: lines joined while they fit the budget.
BLOCKS = rf"""block_lines AS (SELECT source AS repository_id, lang AS branch, 'doc/' || doc_id || '.txt' AS file_path, regexp_extract_all(text, '[^\n]*\n|[^\n]+$') AS ls FROM documents WHERE regexp_matches(text, '\S')),
folded AS (SELECT *, list_reduce(list_transform(ls, lambda l, i: {{'starts': [CAST(i AS BIGINT)], 'size': CAST(length(regexp_replace(l, '[ \t\n\r\x0b\x0c]', '', 'g')) AS BIGINT)}}), lambda a, x: {{'starts': CASE WHEN a.size + x.size > {BUDGET} THEN list_concat(a.starts, x.starts) ELSE a.starts END, 'size': CASE WHEN a.size + x.size > {BUDGET} THEN x.size ELSE a.size + x.size END}}).starts AS ss FROM block_lines),
cut AS (SELECT repository_id, branch, file_path, ls, unnest(ss) AS s, unnest(list_append(list_transform(ss[2:], lambda s: s - 1), CAST(len(ls) AS BIGINT))) AS e FROM folded),
blocks AS (SELECT repository_id, branch, file_path, CAST(s AS INTEGER) AS start_line, CAST(e AS INTEGER) AS end_line, array_to_string(ls[s:e], '') AS content FROM cut)"""
CHUNKS = f"""{WINDOWS},
versioned AS (SELECT *, md5(content) AS chunk_hash, unnest(CASE doc_id % 4 WHEN 0 THEN ['legacy'] WHEN 1 THEN ['v1', 'v2'] WHEN 2 THEN ['v2'] ELSE ['v1'] END) AS publish_id FROM windows),
chunks AS (SELECT *, md5(concat_ws('|', repository_id, branch, file_path, start_line, publish_id)) AS chunk_id FROM versioned)"""
POINTERS = "pointers AS (SELECT source AS repository_id, lang AS branch, 'doc/' || doc_id || '.txt' AS file_path, CASE WHEN doc_id % 4 <> 3 THEN 'v2' END AS active_publish_id FROM documents WHERE doc_id % 4 <> 0)"
ACTIVE = "active AS (SELECT c.* FROM chunks c LEFT JOIN (SELECT *, true AS has_pointer FROM pointers) p USING (repository_id, branch, file_path) WHERE p.active_publish_id = c.publish_id OR (p.has_pointer IS NULL AND c.publish_id = 'legacy'))"
QUERIES = "queries AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
WIKI = "wiki AS (SELECT page_id, url AS slug, regexp_extract(url, '^https?://([^/]+)', 1) AS section_path, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, html AS content FROM pages)"
RESULTS = """results AS (SELECT task_id, run_id, resolved, task_id % 7 <> 0 AS prediction_present, task_id % 7 > 1 AS patch_exists, task_id % 7 > 2 AS patch_applied, ['t0', 't1', 't2', 't3'] AS pytest_targets,
  CASE WHEN resolved THEN [] ELSE list_transform(range(0, (task_id + length(run_id)) % 3 + 1), lambda i: 't' || i) END AS failing_tests
  FROM (SELECT doc_id AS task_id, 'base' AS run_id, quality = 1 AS resolved FROM labels UNION ALL SELECT doc_id, 'other', toxic = 1 FROM labels)),
status AS (SELECT *, CASE WHEN resolved THEN 'resolved' WHEN NOT prediction_present THEN 'error' WHEN NOT patch_exists THEN 'missing_patch' WHEN NOT patch_applied THEN 'patch_failed' ELSE 'unresolved' END AS status FROM results)"""
RUNS = "runs AS (SELECT source AS task_id, doc_id % 5 AS run_id, avg(quality) >= 0.85 AS resolved FROM documents JOIN labels USING (doc_id) GROUP BY ALL)"
CALLS = "calls AS (SELECT 'openai/m-' || lower(l_returnflag) AS model_name, 'm-' || lower(l_returnflag) AS model, 'r-' || lower(l_linestatus) AS region, CAST(l_quantity AS BIGINT) * 10 AS input_tokens, CASE WHEN l_partkey % 11 <> 0 THEN CAST(l_quantity AS BIGINT) END AS output_tokens, CAST(l_quantity AS BIGINT) * 11 AS total_tokens, CAST(l_quantity * 0.5 AS DOUBLE) AS latency_ms FROM lineitem)"
RATES = "rates(model, region, input_rate, output_rate) AS (VALUES ('m-a', 'r-f', 2.0::DOUBLE, 8.0::DOUBLE), ('m-a', '*', 1.0, 4.0), ('m-n', '*', 0.5, 1.5), ('m-r', 'r-o', 3.0, 9.0))"
ANSWERS = r"""raw AS (SELECT *, CAST(l_quantity AS BIGINT) AS q, (l_orderkey + l_linenumber) % 9 AS m FROM lineitem JOIN part ON p_partkey = l_partkey),
answers AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'a' ELSE 'b' END AS run_id, CAST(l_orderkey * 4 + floor((l_linenumber - 1) / 2) AS BIGINT) AS idx,
  'Take ' || q || ' of ' || p_name || ' and ' || p_size || ': ' || ['how many dollars per day', 'the area of a square', 'cost in percent', 'altogether', 'miles each hour', 'what is it'][l_orderkey % 6 + 1] || '?' AS question, '#### ' || q AS gold_text,
  CASE m WHEN 4 THEN '' WHEN 5 THEN 'It is ' || q WHEN 6 THEN 'no idea' WHEN 7 THEN '<<' || q || E'>>\n#### ' || q ELSE E'So we get\n#### ' || (CASE m WHEN 0 THEN q + 1 WHEN 1 THEN -q WHEN 2 THEN q * 20 WHEN 3 THEN q + 2 ELSE q END) END AS completion FROM raw),
parsed AS (SELECT *, nullif(replace(regexp_extract(gold_text, '####\s*(-?\d[\d,]*(?:\.\d+)?)', 1), ',', ''), '') AS gold_answer, nullif(replace(regexp_extract(completion, '####\s*(-?\d[\d,]*(?:\.\d+)?)', 1), ',', ''), '') AS pred_answer FROM answers),
marked AS (SELECT *, coalesce(gold_answer = pred_answer, false) AS is_correct, len(regexp_extract_all(completion, '-?\d+(?:\.\d+)?')) AS numbers, len(regexp_extract_all(question, '-?\d+(?:\.\d+)?')) AS question_numbers, len(list_filter(string_split_regex(completion, '\s+'), lambda w: w <> '')) AS words, contains(completion, '####') AS marker, lower(question) AS lq FROM parsed),
flagged AS (SELECT *, CAST(question_numbers >= 3 AS INTEGER) AS multi_step,
  CAST(regexp_matches(lq, '\$|dollar|cent|price|cost') AS INTEGER) AS money, CAST(regexp_matches(lq, 'minute|hour|day|week|month|year') AS INTEGER) AS "time", CAST(regexp_matches(lq, 'mile|meter|km|foot|feet|yard') AS INTEGER) AS distance,
  CAST(regexp_matches(lq, 'area|perimeter|radius|diameter|rectangle|triangle|circle|square') AS INTEGER) AS geometry, CAST(regexp_matches(lq, 'how many|total number|count|altogether') AS INTEGER) AS counting,
  CAST(regexp_matches(lq, 'ratio|percent|%|fraction|half|double|twice|each|per|every') AS INTEGER) AS ratio_percent, TRY_CAST(pred_answer AS DECIMAL(28,10)) AS p, TRY_CAST(gold_answer AS DECIMAL(28,10)) AS g FROM marked),
classed AS (SELECT *, CASE WHEN geometry = 1 THEN 'geometry' WHEN money = 1 AND ratio_percent = 1 THEN 'money_rate' WHEN "time" = 1 AND ratio_percent = 1 THEN 'time_rate' WHEN counting = 1 THEN 'counting' WHEN distance = 1 THEN 'distance' WHEN ratio_percent = 1 THEN 'ratio_percent' WHEN multi_step = 1 THEN 'multi_step_other' ELSE 'other' END AS problem_cluster,
  CASE WHEN is_correct THEN 'correct' WHEN pred_answer IS NULL THEN 'no_numeric_answer' WHEN gold_answer IS NULL THEN 'bad_reference' WHEN p IS NULL OR g IS NULL THEN 'format_error' WHEN p = g THEN 'correct' WHEN p = g + 1 OR p = g - 1 THEN 'off_by_one' WHEN p = -g THEN 'sign_error' WHEN g <> 0 AND abs(p - g) * 10 <= abs(g) THEN 'near_miss' WHEN greatest(abs(p), abs(g), 1) >= 10 * greatest(least(abs(p), abs(g)), 0.000000001) THEN 'magnitude_error' ELSE 'wrong_numeric' END AS error_type,
  CASE WHEN NOT regexp_matches(completion, '\S') THEN 'empty' WHEN pred_answer IS NULL AND numbers > 0 THEN 'number_without_marker' WHEN pred_answer IS NULL THEN 'no_numeric_answer' WHEN regexp_matches(completion, '<<|>>') AND marker THEN 'tool_trace_with_final' WHEN regexp_matches(completion, '<<|>>') THEN 'tool_trace_no_final' WHEN marker AND words <= 12 THEN 'concise_final' WHEN marker THEN 'worked_then_final' ELSE 'other_numeric' END AS answer_style,
  CASE WHEN NOT regexp_matches(completion, '\S') THEN 'empty_completion' WHEN is_correct AND marker THEN 'correct_with_marker' WHEN is_correct THEN 'correct_without_marker' WHEN marker AND pred_answer IS NOT NULL THEN 'marker_wrong_number' WHEN marker THEN 'marker_unparseable' WHEN numbers > 0 THEN 'number_without_marker' ELSE 'text_without_number' END AS format FROM flagged)"""
