"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(key.cast("string").cast("binary")) % n


def unlike(columns: list[str], *names: str) -> list[str]:
    """The columns whose names are none of these in any case: Spark doesn't tell names apart by case."""
    taken = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in taken]


def hash_below(col: Column, share: float) -> Column:
    """True for about this share of the values, always the same ones."""
    if share >= 1:
        return F.lit(True)
    return F.pmod(F.xxhash64(F.lit("sample"), col), F.lit(1 << 30)) < int(share * (1 << 30))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a local session (tests) gets a temporary folder; a cluster has no folder that all its machines see, so that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a copy in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def as_bytes(column: pa.Array) -> list[bytes]:
    """Values of a binary column; null counts as empty."""
    return [x or b"" for x in column.to_pylist()]


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows whose sizes sum to about `most`; a larger row stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... of each range, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(first - starts, lengths)


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values, sorted, the place of one of each, and the number of each value among them."""
    order = np.argsort(h)
    new = np.ones(len(h), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    place = np.empty(len(h), np.int64)
    place[order] = np.cumsum(new) - 1
    some = order[new]
    return h[some], some, place


def parts_for(df: DataFrame, mb: int = 24) -> int:
    """How many groups to deal the documents into, so that a group holds about `mb` MB of what the files take."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 50:  # unknown, or a product of guesses
        texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
        size = df.agg(F.coalesce(F.sum(sum(texts, F.lit(8).cast("long"))), F.lit(0))).first()[0]
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // (mb << 20) + 1)


def packed(columns: dict[str, pa.Array]) -> bytes:
    """Many rows as one compressed value, to shuffle them together."""
    batch = pa.RecordBatch.from_pydict(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(value: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(value.as_buffer()).read_all()
