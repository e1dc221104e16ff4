"""Queries on files, chunks and published versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text
from corvane.operators import chunking, registry, versioning
from corvane.operators.evaluation import set_differences
from corvane.plans import tables as T

QUERIES, SQL = {}, {}
#: Batches of staged rows.
BATCHES = 3


def query(key: str, sql: str | None = None):
    def added(f):
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return added


LANGUAGES = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in text.LANGUAGE_BY_SUFFIX.items()) + "}"
#: Page urls with a file's suffix, so that all rules occur.
SUFFIXES = ["py", "rs", "txt", "md", "lock", "json"]
PATHS = "paths AS (SELECT page_id, length(html) AS size, CASE page_id % 9 WHEN 7 THEN 'a/Dockerfile' WHEN 8 THEN 'b/yarn.lock' ELSE 'src/' || page_id || '.' || ['py', 'rs', 'txt', 'md', 'lock', 'json'][page_id % 6 + 1] END AS path FROM pages)"
LANGUAGE_SQL = f"CASE WHEN lower(regexp_extract(path, '[^/]*$')) IN ('dockerfile', 'makefile') THEN lower(regexp_extract(path, '[^/]*$')) ELSE {LANGUAGES}[nullif(lower(regexp_extract(path, '[^./]\\.([^./]+)$', 1)), '')] END"


def paths(spark, d):
    p = T.read(spark, d, "pages")
    m = F.col("page_id") % 9
    name = F.when(m == 7, "a/Dockerfile").when(m == 8, "b/yarn.lock").otherwise(F.concat(F.lit("src/"), "page_id", F.lit("."), F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("page_id") % 6 + 1).cast("int"))))
    return p.select("page_id", F.length("html").alias("size"), name.alias("path"))


@query("SRC-01", f"WITH {PATHS} SELECT page_id, path FROM paths WHERE {LANGUAGE_SQL} IS NOT NULL AND regexp_extract(path, '[^/]*$') NOT IN ({', '.join(repr(x) for x in text.LOCK_FILES)}) AND size <= 1000000")
def src_01(spark, d):
    return paths(spark, d).where(text.is_indexable(F.col("path"), F.col("size"))).select("page_id", "path")


@query("FLT-02", f"WITH {PATHS} SELECT page_id, {LANGUAGE_SQL} AS language FROM paths")
def flt_02(spark, d):
    return paths(spark, d).select("page_id", text.language_of(F.col("path")).alias("language"))


@query("SRC-02", None)
def src_02(spark, d):
    """Files as bytes, decoded with bad ones replaced, blank ones dropped."""
    raw = T.files(spark, d).select("file_path", F.concat(F.col("content").cast("binary"), F.when(F.col("doc_id") % 10 == 0, F.unhex(F.lit("FF"))).otherwise(F.lit(b""))).alias("content"))
    return raw.select("file_path", F.make_valid_utf8(F.col("content").cast("string")).alias("content")).where(F.col("content").rlike(r"\S"))


@query("SRC-03", f"""WITH {T.FILES}, old AS (SELECT *, md5(content) AS h FROM files WHERE doc_id % 5 <> 0), new AS (SELECT repository_id, branch, file_path, md5(CASE WHEN doc_id % 3 = 0 THEN content || 'x' ELSE content END) AS h FROM files WHERE doc_id % 7 <> 0)
SELECT coalesce(o.repository_id, n.repository_id) AS repository_id, coalesce(o.branch, n.branch) AS branch, coalesce(o.file_path, n.file_path) AS file_path, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'deleted' ELSE 'modified' END AS change
FROM old o FULL JOIN new n ON o.repository_id = n.repository_id AND o.branch = n.branch AND o.file_path = n.file_path WHERE o.h IS DISTINCT FROM n.h""")
def src_03(spark, d):
    f = T.files(spark, d)
    new = f.where("doc_id % 7 <> 0").withColumn("content", F.when(F.col("doc_id") % 3 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content")))
    return versioning.snapshot_diff(f.where("doc_id % 5 <> 0"), new)


@query("SRC-04", f"WITH {T.WINDOWS} SELECT 'b' || (doc_id % {BATCHES}) AS batch_id, repository_id, branch, file_path, start_line, CAST(row_number() OVER (PARTITION BY doc_id % {BATCHES} ORDER BY repository_id, branch, file_path, start_line) - 1 AS INTEGER) AS seq_index FROM windows")
def src_04(spark, d):
    c = chunking.sliding_windows(T.files(spark, d), T.MAX_LINES, T.OVERLAP)
    return chunking.staged(c, F.concat(F.lit("b"), F.col("doc_id") % BATCHES)).select("batch_id", "repository_id", "branch", "file_path", "start_line", "seq_index")


@query("SRC-05", f"""WITH {T.WINDOWS}, s AS (SELECT 'b' || (doc_id % {BATCHES}) AS batch_id, file_path, start_line, CAST(row_number() OVER (PARTITION BY doc_id % {BATCHES} ORDER BY repository_id, branch, file_path, start_line) - 1 AS INTEGER) AS seq_index FROM windows)
SELECT batch_id, seq_index, file_path, start_line, e.embedding FROM s LEFT JOIN (SELECT 'b' || (vec_id % {BATCHES}) AS batch_id, CAST(vec_id // {BATCHES} AS INTEGER) AS seq_index, embedding FROM embeddings) e USING (batch_id, seq_index)""")
def src_05(spark, d):
    s = src_04(spark, d)
    e = T.read(spark, d, "embeddings").select(F.concat(F.lit("b"), F.col("vec_id") % BATCHES).alias("batch_id"), F.floor(F.col("vec_id") / BATCHES).cast("int").alias("seq_index"), "embedding")
    return s.join(e, ["batch_id", "seq_index"], "left").select("batch_id", "seq_index", "file_path", "start_line", "embedding")


@query("SRC-10", "SELECT item_id, text, CAST(list_position([17, 3, 29], item_id) - 1 AS BIGINT) AS position FROM benchmark WHERE item_id IN (17, 3, 29)")
def src_10(spark, d):
    return registry.slice_by_ids(T.read(spark, d, "benchmark"), [17, 3, 29], "item_id")


@query("SRC-10-first", "SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 7")
def src_10_first(spark, d):
    return registry.first_rows(T.read(spark, d, "benchmark"), "item_id", 7)


@query("SRC-14", "SELECT event_id, value FROM events WHERE ts IS NOT NULL AND value IS NOT NULL AND isfinite(value)")
def src_14(spark, d):
    from corvane.operators.answers import finite_points

    return finite_points(T.read(spark, d, "events"), "ts", "value").select("event_id", "value")


@query("SRC-15", "SELECT user_id, event_id, split_part(event_type || '/' || user_id, '/', 1) AS owner FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def src_15(spark, d):
    e = T.read(spark, d, "events").withColumn("order_key", F.struct("ts", "event_id"))
    return versioning.latest_by(e, ["user_id"], F.col("order_key").desc()).select("user_id", "event_id", F.split_part(F.concat("event_type", F.lit("/"), "user_id"), F.lit("/"), F.lit(1)).alias("owner"))


@query("CHK-01", f"WITH {T.WINDOWS} SELECT repository_id, branch, file_path, start_line, end_line, content FROM windows")
def chk_01(spark, d):
    return chunking.sliding_windows(T.files(spark, d), T.MAX_LINES, T.OVERLAP).select("repository_id", "branch", "file_path", "start_line", "end_line", "content")


@query("CHK-02", f"WITH {T.BLOCKS} SELECT *, md5(content) AS chunk_hash FROM blocks")
def chk_02(spark, d):
    return T.structural(spark, d)


@query("CHK-02-windows", f"WITH {T.WINDOWS}, {T.BLOCKS} SELECT file_path, b.start_line AS block, w.start_line AS win, least(b.end_line, w.end_line) - greatest(b.start_line, w.start_line) + 1 AS shared FROM blocks b JOIN windows w USING (repository_id, branch, file_path) WHERE b.start_line <= w.end_line AND w.start_line <= b.end_line")
def chk_02_windows(spark, d):
    """Which windows of a file the structural chunks share lines with."""
    named = lambda x: x.withColumn("chunk_id", F.col("start_line"))
    met = chunking.overlapping(named(T.structural(spark, d)), named(chunking.sliding_windows(T.files(spark, d), T.MAX_LINES, T.OVERLAP)), ["repository_id", "branch", "file_path"], 16)
    return met.select("file_path", F.col("chunk_id").alias("block"), F.col("window_id").alias("win"), "shared")


@query("CHK-03")
def chk_03(spark, d):
    f = T.files(spark, d)
    return chunking.chunk_files(f.withColumn("file_path", F.when(F.col("doc_id") % 2 == 0, F.regexp_replace("file_path", "txt$", "md")).otherwise(F.col("file_path"))))


@query("CHK-04", f"WITH {T.WINDOWS} SELECT file_path, start_line, md5(content) AS chunk_hash FROM windows")
def chk_04(spark, d):
    return chunking.sliding_windows(T.files(spark, d), T.MAX_LINES, T.OVERLAP).select("file_path", "start_line", "chunk_hash")


@query("CHK-05", f"WITH {T.CHUNKS} SELECT chunk_hash, count(*) AS copies, min(chunk_id) AS first_id FROM chunks GROUP BY 1 HAVING count(*) > 1")
def chk_05(spark, d):
    return chunking.duplicate_report(T.chunks(spark, d))


def staged_batch(spark, d):
    """New windows of two thirds of the files, as version v3; every fifth without an embedding."""
    c = chunking.sliding_windows(T.files(spark, d), T.MAX_LINES, T.OVERLAP).where("doc_id % 3 <> 0")
    key = F.concat_ws("|", "repository_id", "branch", "file_path", F.col("start_line").cast("string"), F.lit("v3"))
    return c.select(F.md5(key.cast("binary")).alias("chunk_id"), "repository_id", "branch", "file_path", "doc_id", "start_line", "end_line", "content", "chunk_hash", F.when(F.col("doc_id") % 5 != 0, F.array(F.col("start_line").cast("float"))).alias("embedding"))


STAGED = f"{T.CHUNKS}, {T.POINTERS}, staged AS (SELECT md5(concat_ws('|', repository_id, branch, file_path, start_line, 'v3')) AS chunk_id, repository_id, branch, file_path, doc_id, start_line, CASE WHEN doc_id % 5 <> 0 THEN start_line END AS e FROM windows WHERE doc_id % 3 <> 0), present AS (SELECT DISTINCT repository_id, branch, file_path, true AS is_staged FROM staged)"
FULL = f"{STAGED}, after AS (SELECT repository_id, branch, file_path, active_publish_id AS previous, CASE WHEN is_staged THEN 'v3' END AS active_publish_id FROM pointers FULL JOIN present USING (repository_id, branch, file_path))"


def full(spark, d):
    return versioning.publish_full(staged_batch(spark, d), T.chunks(spark, d), T.pointers(spark, d), "v3")


@query("PUB-01", f"WITH {FULL} SELECT repository_id, branch, file_path, active_publish_id FROM after")
def pub_01(spark, d):
    return full(spark, d).pointers


@query("PUB-01-chunks", f"WITH {FULL} SELECT publish_id, count(*) AS n, count(DISTINCT file_path) AS files FROM (SELECT publish_id, file_path FROM chunks UNION ALL SELECT 'v3', file_path FROM staged) GROUP BY 1")
def pub_01_chunks(spark, d):
    return full(spark, d).chunks.groupBy("publish_id").agg(F.count("*").alias("n"), F.countDistinct("file_path").alias("files"))


@query("PUB-01-vectors", f"WITH {FULL} SELECT chunk_id, file_path, 'v3' AS publish_id FROM staged WHERE e IS NOT NULL")
def pub_01_vectors(spark, d):
    return full(spark, d).vectors.select("chunk_id", "file_path", "publish_id")


@query("PUB-01-cleanup", f"WITH {FULL} SELECT repository_id, branch, file_path, previous AS previous_publish_id FROM after WHERE previous <> 'v3'")
def pub_01_cleanup(spark, d):
    return full(spark, d).cleanup


@query("PUB-02", f"""WITH {STAGED}, changed AS (SELECT repository_id, branch, file_path FROM files WHERE doc_id % 2 = 0)
SELECT c.repository_id, c.branch, c.file_path, CASE WHEN p.is_staged THEN 'v3' END AS active_publish_id FROM changed c LEFT JOIN present p USING (repository_id, branch, file_path)
UNION ALL SELECT repository_id, branch, file_path, active_publish_id FROM pointers ANTI JOIN changed USING (repository_id, branch, file_path)""")
def pub_02(spark, d):
    changed = T.files(spark, d).where("doc_id % 2 = 0")
    return versioning.publish_incremental(staged_batch(spark, d), changed, T.chunks(spark, d), T.pointers(spark, d), "v3").pointers


@query("PUB-03", f"WITH {T.WINDOWS} SELECT repository_id, branch, file_path, start_line FROM windows WHERE doc_id % 4 = 1 AND branch = 'en' OR doc_id % 4 = 0 AND branch <> 'en'")
def pub_03(spark, d):
    staged = chunking.sliding_windows(T.files(spark, d), T.MAX_LINES, T.OVERLAP).withColumn("target_commit", F.concat(F.lit("c"), F.col("doc_id") % 4))
    branches = T.files(spark, d).select("repository_id", "branch").distinct().withColumn("target_commit", F.when(F.col("branch") == "en", "c1").otherwise("c0"))
    return versioning.drop_stale(staged, branches).select("repository_id", "branch", "file_path", "start_line")


@query("PUB-04", f"WITH {FULL} SELECT chunk_id, publish_id FROM chunks ANTI JOIN (SELECT repository_id, branch, file_path, previous AS publish_id FROM after WHERE previous <> 'v3') USING (repository_id, branch, file_path, publish_id)")
def pub_04(spark, d):
    return versioning.delete_versions(T.chunks(spark, d), full(spark, d).cleanup).select("chunk_id", "publish_id")


@query("PUB-05", f"WITH {T.WINDOWS} SELECT 'b' || (doc_id % {BATCHES}) AS batch_id, count(*) AS n FROM windows WHERE doc_id % {BATCHES} <> 1 GROUP BY 1")
def pub_05(spark, d):
    return versioning.drop_batch(src_04(spark, d), "b1").groupBy("batch_id").agg(F.count("*").alias("n"))


#: Events of branches in order, the target each meets, and the state each branch ends in.
BRANCH_STATES = """ev AS (SELECT CAST(user_id AS VARCHAR) AS repository_id, event_type AS branch, ['pending', 'indexing', 'indexed', 'failed'][event_id % 4 + 1] AS status, CASE WHEN event_id % 4 >= 2 THEN 'c' || (event_id // 8) END AS latest, CASE WHEN event_id % 4 = 0 THEN 'c' || (event_id // 8) END AS target, ts FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY repository_id, branch ORDER BY ts, status, latest NULLS FIRST, target NULLS FIRST) AS n FROM ev),
s AS (SELECT *, last_value(CASE WHEN target IS NOT NULL THEN {'n': n, 't': target} END IGNORE NULLS) OVER (PARTITION BY repository_id, branch ORDER BY n) AS held FROM o),
e AS (SELECT *, held.n AS stretch, coalesce(bool_or(status = 'indexed' AND latest = held.t) OVER (PARTITION BY repository_id, branch, held.n ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended FROM s),
m AS (SELECT *, CASE WHEN NOT ended THEN held.t END AS met FROM e), l AS (SELECT *, coalesce(latest <> met AND status IN ('indexed', 'failed'), false) AS late FROM m),
states AS (SELECT repository_id, branch, arg_max(status, n) FILTER (NOT late) AS status, arg_max({'t': CASE WHEN status = 'indexed' AND latest = met THEN NULL ELSE met END}, n) FILTER (NOT late) AS left_, arg_max(latest, n) FILTER (NOT late AND latest IS NOT NULL AND (status <> 'indexed' OR met IS NULL OR latest = met)) AS last_commit,
strftime(max(ts) FILTER (NOT late AND status = 'indexed'), '%Y-%m-%d %H:%M:%S.%f') AS indexed_at, CAST(count_if(late) AS INTEGER) AS ignored FROM l GROUP BY ALL)"""
STATES_SQL = f"WITH {BRANCH_STATES} SELECT repository_id, branch, status, left_.t AS target_commit, last_commit, indexed_at, ignored FROM states"


def written_out(states):
    """The time of indexing as text, the same in every time zone."""
    return states.withColumn("indexed_at", F.date_format("indexed_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("PUB-06", STATES_SQL)
def pub_06(spark, d):
    return written_out(versioning.branch_states(status_events(spark, d)))


def status_events(spark, d):
    e = T.read(spark, d, "events")
    kind = F.element_at(F.array(*map(F.lit, ["pending", "indexing", "indexed", "failed"])), (F.col("event_id") % 4 + 1).cast("int"))
    commit = F.concat(F.lit("c"), F.floor(F.col("event_id") / 8))
    return e.select(F.col("user_id").cast("string").alias("repository_id"), F.col("event_type").alias("branch"), kind.alias("status"), F.when(kind.isin("indexed", "failed"), commit).alias("latest_commit"), F.when(kind == "pending", commit).alias("target_commit"), F.col("ts").cast("timestamp").alias("ts"))


@query("PUB-07", "SELECT coalesce(n.c_custkey, c.c_custkey) AS c_custkey, coalesce(n.name, c.name) AS name, coalesce(n.segment, c.segment) AS segment FROM (SELECT c_custkey, c_name AS name, c_mktsegment AS segment FROM customer WHERE c_custkey % 3 <> 0) c FULL JOIN (SELECT c_custkey, 'new/' || c_name AS name, CASE WHEN c_custkey % 4 <> 0 THEN 'X' END AS segment FROM customer WHERE c_custkey % 2 = 0) n ON c.c_custkey = n.c_custkey")
def pub_07(spark, d):
    c = T.read(spark, d, "customer")
    old = c.where("c_custkey % 3 <> 0").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    new = c.where("c_custkey % 2 = 0").select("c_custkey", F.concat(F.lit("new/"), "c_name").alias("name"), F.when(F.col("c_custkey") % 4 != 0, "X").alias("segment"))
    return versioning.upsert(old, new, ["c_custkey"])


@query("PUB-08", "SELECT user_id, event_type AS repository_id FROM events WHERE event_id % 2 = 0 GROUP BY ALL UNION SELECT user_id, event_type FROM events WHERE event_id % 3 = 0")
def pub_08(spark, d):
    e = T.read(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("repository_id"))
    hidden = e.where("event_id % 2 = 0").select("user_id", "repository_id").distinct()
    return versioning.add_missing(hidden, e.where("event_id % 3 = 0").select("user_id", "repository_id").distinct(), ["user_id", "repository_id"])


@query("PUB-09", f"WITH {T.WIKI} SELECT page_id, slug AS file_path, 'legacy' AS publish_id FROM wiki WHERE page_id % 2 = 0 UNION ALL SELECT page_id, slug, 'new' FROM wiki WHERE page_id % 2 = 1 AND page_id % 3 = 0")
def pub_09(spark, d):
    w = T.wiki_pages(spark, d).select("page_id", F.col("slug").alias("file_path"))
    return versioning.add_missing(w.where("page_id % 2 = 0").withColumn("publish_id", F.lit("legacy")), w.where("page_id % 3 = 0").withColumn("publish_id", F.lit("new")), ["page_id"])


@query("VER-01", f"WITH {T.CHUNKS}, {T.POINTERS}, {T.ACTIVE} SELECT chunk_id, file_path, publish_id FROM active")
def ver_01(spark, d):
    return versioning.active_only(T.chunks(spark, d), T.pointers(spark, d)).select("chunk_id", "file_path", "publish_id")


@query("VER-02", f"WITH {T.CHUNKS}, {T.POINTERS}, {T.ACTIVE} SELECT chunk_id, CAST(1.0 / start_line AS DOUBLE) AS score FROM active")
def ver_02(spark, d):
    hits = T.chunks(spark, d).select("chunk_id", (F.lit(1.0) / F.col("start_line")).alias("score"), "repository_id", "branch", "file_path", F.when(F.col("publish_id") != "legacy", F.col("publish_id")).alias("publish_id"))
    return versioning.active_only(hits, T.pointers(spark, d)).select("chunk_id", "score")


@query("SET-01", f"WITH {STAGED} SELECT repository_id, branch, file_path FROM pointers UNION SELECT repository_id, branch, file_path FROM staged")
def set_01(spark, d):
    return T.pointers(spark, d).select(*versioning.FILE).union(staged_batch(spark, d).select(*versioning.FILE)).distinct()


@query("SET-02", "SELECT source AS repository_id, lang AS branch, min(doc_id) AS position FROM documents GROUP BY ALL EXCEPT SELECT source, lang, min(doc_id) OVER (PARTITION BY source, lang) FROM documents WHERE (source, lang) IN (SELECT source, lang FROM documents WHERE doc_id % 9 = 0)")
def set_02(spark, d):
    f = T.files(spark, d)
    return registry.requested_minus_indexed(f.groupBy("repository_id", "branch").agg(F.min("doc_id").alias("position")), f.where("doc_id % 9 = 0").select("repository_id", "branch").distinct())


@query("SET-03", "SELECT doc_id AS task_id, 'left' AS side FROM labels WHERE doc_id % 5 <> 0 AND doc_id % 3 = 0 UNION ALL SELECT doc_id, 'right' FROM labels WHERE doc_id % 5 = 0 AND doc_id % 3 <> 0")
def set_03(spark, d):
    t = T.read(spark, d, "labels").select(F.col("doc_id").alias("task_id"))
    return set_differences(t.where("task_id % 5 <> 0"), t.where("task_id % 3 <> 0"))


@query("STR-05", f"WITH {FULL} SELECT a.repository_id, a.branch, count(*) AS files, count(active_publish_id) AS active FROM after a GROUP BY ALL")
def str_05(spark, d):
    """Full index of all branches at once: chunk, stage, publish."""
    return full(spark, d).pointers.groupBy("repository_id", "branch").agg(F.count("*").alias("files"), F.count("active_publish_id").alias("active"))


