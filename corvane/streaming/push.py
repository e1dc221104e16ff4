"""Push events: parsing, coalescing, incremental indexing, branch states."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from corvane.operators.chunking import sliding_windows
from corvane.operators.retrieval import hashed_vector
from corvane.operators.versioning import EVENT, FILE, publish_incremental

PAYLOAD = "struct<ref:string,before:string,after:string,repository:struct<id:long,full_name:string,clone_url:string>>"


def parsed(events: DataFrame, kind: Column, payload: Column) -> DataFrame:
    """STR-01: fields of a push with why it is rejected, null if it isn't: only pushes on branches with all fields count."""
    p = F.from_json(payload, PAYLOAD)
    d = events.withColumn("p__", p)
    branch = F.regexp_extract("p__.ref", "^refs/heads/(.+)$", 1)
    gap = F.col("p__.repository.id").isNull() | F.col("p__.repository.full_name").isNull() | F.col("p__.after").isNull()
    reason = F.when(kind != "push", "not a push").when(F.coalesce(branch, F.lit("")) == "", "not a branch").when(gap, "fields are missing")
    return d.select(*events.columns, F.col("p__.repository.id").alias("repository_id"), F.col("p__.repository.full_name").alias("full_name"), branch.alias("branch"), F.col("p__.before").alias("before_commit"), F.col("p__.after").alias("after_commit"), reason.alias("rejected"))


def coalesced(pushes: DataFrame, gap: str = "15 seconds", late: str | None = None) -> DataFrame:
    """STR-02: pushes of a branch less than `gap` apart become one: the newest commit, the earliest before, and all changed files where pushes name them. pushes: repository_id, branch, before_commit, after_commit, ts (timestamp), push_id, and changed_files (array of paths) if known. `late`: watermark delay for streams."""
    rows = pushes.withWatermark("ts", late) if late else pushes
    order = F.struct("ts", "push_id")
    grouped = rows.groupBy("repository_id", "branch", F.session_window("ts", gap).alias("session"))
    figures = [F.max_by("after_commit", order).alias("after_commit"), F.min_by("before_commit", order).alias("before_commit"), F.count("*").alias("pushes"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")]
    if "changed_files" in pushes.columns:  # of all of them; null, the whole branch, where one doesn't say
        every = F.array_sort(F.array_distinct(F.flatten(F.collect_list("changed_files"))))
        figures.append(F.when(F.count("changed_files") == F.count("*"), every).alias("changed_files"))
    return grouped.agg(*figures).drop("session")


def index_batch(changed: DataFrame, chunks: DataFrame, pointers: DataFrame, batch: str, max_lines: int = 50, overlap: int = 10):
    """STR-03: chunk, embed and publish changed files (FILE, content; null content for deleted ones) as version `batch`."""
    c = sliding_windows(changed.where("content is not null").select(*FILE, "content"), max_lines, overlap)
    key = F.concat_ws("|", *FILE, F.col("start_line").cast("string"), F.lit(batch))
    staged = c.select(F.md5(key.cast("binary")).alias("chunk_id"), *FILE, "start_line", "end_line", "content", "chunk_hash", hashed_vector(F.col("content")).alias("embedding"))
    return publish_incremental(staged, changed, chunks, pointers, batch)


POINTERS = ", ".join(f"{c} string" for c in [*FILE, "active_publish_id"])


def _folders(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the folders name=number under a path whose writing has ended."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return []
    found = [f.getPath() for f in fs.listStatus(place) if f.isDirectory() and "=" in f.getPath().getName()]
    return sorted(int(f.getName().split("=")[1]) for f in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS")))


def pointer_log(spark: SparkSession, store: str, before: int | None = None) -> DataFrame:
    """Each file's pointer by the store's batches (those under `before`): FILE, active_publish_id, batch.

    What `compact` has written stands for all batches up to its number, so only later ones are read besides.
    """
    within = lambda n: before is None or n < before
    bases = [n for n in _folders(spark, f"{store}/base") if within(n)]
    batches = [n for n in _folders(spark, f"{store}/pointers") if within(n) and (not bases or n > bases[-1])]
    out = spark.createDataFrame([], f"{POINTERS}, batch long")
    if bases:
        out = out.unionByName(spark.read.schema(f"{POINTERS}, batch long").parquet(f"{store}/base/upto={bases[-1]}"))
    if batches:
        log = spark.read.schema(f"{POINTERS}, batch long").option("basePath", f"{store}/pointers").parquet(*[f"{store}/pointers/batch={n}" for n in batches])
        out = out.unionByName(log)
    return out.groupBy(*FILE).agg(F.max_by("active_publish_id", "batch").alias("active_publish_id"), F.max("batch").alias("batch"))


def current_pointers(pointers: DataFrame) -> DataFrame:
    """The pointer of each file's greatest batch."""
    return pointers.groupBy(*FILE).agg(F.max_by("active_publish_id", "batch").alias("active_publish_id"))


def compact(spark: SparkSession, store: str) -> int | None:
    """Merge the pointers of all batches so far into one folder, newest first; the number of the last, or None without any. Batches that run again replace their own output only, so they must not be under it: compact between batches."""
    batches = _folders(spark, f"{store}/pointers")
    if not batches:
        return None
    pointer_log(spark, store, batches[-1] + 1).write.mode("overwrite").parquet(f"{store}/base/upto={batches[-1]}")
    return batches[-1]


def first_batch(spark: SparkSession, store: str, stream: str) -> int:
    """The store's number for the first batch of a stream, named by its checkpoint folder, the same whenever it starts again; a new stream begins behind all batches there are."""
    kept = f"{store}/streams/{hashlib.md5(stream.encode()).hexdigest()}"
    place = spark._jvm.org.apache.hadoop.fs.Path(kept, "_SUCCESS")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        last = _folders(spark, f"{store}/pointers")
        spark.createDataFrame([(last[-1] + 1 if last else 0,)], "first long").write.mode("overwrite").parquet(kept)
    return spark.read.parquet(kept).first()["first"]


def incremental_index(files: DataFrame, store: str, first: int = 0, compact_every: int = 20):
    """STR-03: a foreachBatch function that indexes the files (FILE, content) that a batch of coalesced pushes changes.

    pushes: repository_id, branch and, where known, changed_files (array of paths); without it, or where it is null, the
    whole branch counts as changed, files that only the store knows included. A changed file without content is withdrawn.
    Each batch writes its chunks, vectors, pointers and cleanup (files with the version it replaces) to folders named by
    the stream's batch id, counted from `first` (see first_batch), so a batch that runs again replaces its own output.
    Readers take pointer_log, which is compacted after every so many batches.
    """

    def run(pushes: DataFrame, batch_id: int) -> None:
        spark, batch = pushes.sparkSession, first + batch_id
        named = F.col("changed_files") if "changed_files" in pushes.columns else F.lit(None).cast("array<string>")
        pushed = pushes.select(F.col("repository_id").cast("string").alias("repository_id"), "branch", named.alias("changed_files"))
        if batch_id and batch_id % compact_every == 0 and batch - 1 not in _folders(spark, f"{store}/base"):
            compact(spark, store)
        pointers = pointer_log(spark, store, batch).drop("batch")
        whole = pushed.where("changed_files is null").select("repository_id", "branch").distinct()
        known = files.select(*FILE).unionByName(pointers.where("active_publish_id is not null").select(*FILE))
        paths = pushed.select("repository_id", "branch", F.explode("changed_files").alias("file_path")).unionByName(known.join(whole, ["repository_id", "branch"], "left_semi")).distinct()
        changed = paths.join(files.select(*FILE, "content"), FILE, "left")
        none = changed.select(F.lit("").alias("chunk_id"), *FILE, F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), "content", F.lit("").alias("chunk_hash"), F.lit("").alias("publish_id")).where("false")
        published = index_batch(changed, none, pointers.join(paths, FILE, "left_semi"), f"b{batch}")
        for part in ("chunks", "vectors", "cleanup", "pointers"):
            getattr(published, part).write.mode("overwrite").parquet(f"{store}/{part}/batch={batch}")

    return run


def index_pushes(pushes: DataFrame, files: DataFrame, store: str, checkpoint: str, gap: str = "15 seconds", late: str = "1 minute") -> StreamingQuery:
    """STR-02 and STR-03 as one stream: pushes coalesced by idle gaps behind a watermark, each batch of them indexed into the store. Pushes later than the watermark are left out; files they name come with the branch's next push that names them, or none."""
    first = first_batch(pushes.sparkSession, store, checkpoint)
    runs = coalesced(pushes, gap, late)
    return runs.writeStream.outputMode("append").foreachBatch(incremental_index(files, store, first)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


STATE = "status string, target_commit string, last_commit string, indexed_at timestamp, ignored int"


class BranchStates(StatefulProcessor):
    """Keeps a branch's state between batches; with `idle` it forgets branches without events for so long."""

    def __init__(self, idle: timedelta | None = None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)

    def _row(self, key: tuple, state: tuple, expired: bool) -> Row:
        status, target, last, at, ignored = state
        return Row(repository_id=key[0], branch=key[1], status=status, target_commit=target, last_commit=last, indexed_at=at, ignored=ignored, expired=expired)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        """A batch's events of a branch one by one, as in versioning.branch_states: the target that each meets, then what it leaves if it counts."""
        status, target, last, at, ignored = self.state.get() or ("pending", None, None, None, 0)
        held, ended, newest = target, False, None
        for ts, kind, latest, own in sorted((tuple(r[c] for c in EVENT) for r in rows), key=lambda e: [(x is not None, x) for x in e]):
            newest = ts if ts is not None else newest

            def late(t: str | None) -> bool:
                return t is not None and latest is not None and latest != t and (kind == "indexed" or (kind == "failed" and t != ""))

            own_late = late(own)
            if own is not None and not own_late:
                held, ended = own, False
            met = own if own is not None else None if ended else held
            ends = kind == "indexed" and latest is not None and not own_late and latest == (own if own is not None else held)
            if late(met):
                ignored += 1
            else:
                matched = kind == "indexed" and latest is not None and latest == met
                status, target = kind, None if matched else met
                if latest is not None and (kind != "indexed" or met is None or matched):
                    last = latest
                if kind == "indexed":
                    at = ts
            ended = ended or ends
        self.state.update((status, target, last, at, ignored))
        if self.idle is not None and newest is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(int((newest + self.idle).timestamp() * 1000))
        yield self._row(key, (status, target, last, at, ignored), False)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        state = self.state.get()
        self.state.clear()
        yield self._row(key, state, True)

    def close(self) -> None:
        pass


def branch_state_stream(events: DataFrame, idle: str | None = None, late: str = "1 hour") -> DataFrame:
    """STR-04: the state of each branch after each batch of its status events, as PUB-06 gives it for all of them; late ends are ignored. events as for branch_states.

    With `idle` (a time such as "30 days") a branch without events for so long, in event time with a watermark of `late`
    behind, is forgotten; its last state comes once more, marked expired. Batches come in order of ts; within one, the
    order is branch_states'. Sets the state store that the operator needs.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = events.select("repository_id", "branch", *EVENT)
    rows = rows.withWatermark("ts", late) if idle else rows
    processor = BranchStates(pd.Timedelta(idle).to_pytimedelta() if idle else None)
    return rows.groupBy("repository_id", "branch").transformWithState(processor, f"repository_id string, branch string, {STATE}, expired boolean", "Update", "EventTime" if idle else "None")


def latest_states(states: DataFrame) -> DataFrame:
    """The last state of each branch among those that batches (column batch) gave."""
    return states.groupBy("repository_id", "branch").agg(F.max_by(F.struct("status", "target_commit", "last_commit", "indexed_at", "ignored"), "batch").alias("s")).select("repository_id", "branch", "s.*")
