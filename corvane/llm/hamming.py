"""Exact nearest binary codes by incremental multi-index hashing.

A vector's code has a bit for each component over 0. Codes are cut into segments of 16 bits, and every task indexes its
codes by each segment's value. A query looks up its own segments' values, then those one bit away, two bits, and so on.
After radius r in all s segments every code not yet met differs in s * (r + 1) bits or more, so a query is done in a
task once its kth verified distance there is less; the tasks' k best then meet. Equal codes are indexed once, with
their k smallest ids, so no bucket grows with copies. Queries are dealt into blocks of about QUERY_BLOCK by Spark, and
codes are sent as bits, once for each block.

Null vectors have no code and are in no result; null and missing components count as 0, those beyond `dims` are
ignored. Ties go to the smaller id. A query finds itself too. With fewer than k vectors all are returned; an empty
table gives no rows. Repeated ids are rows of their own.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import ragged

SEGMENT = 16
#: Queries of a block, codes that a task indexes together, and tasks at least where codes are not few, about.
QUERY_BLOCK, CHUNK, LEAST_PARTS = 1 << 17, 200_000, 32


@functools.cache
def flips() -> list[np.ndarray]:
    """Masks of a segment by how many bits they flip."""
    masks = np.arange(1 << SEGMENT, dtype=np.uint16)
    weight = np.bitwise_count(masks)
    return [masks[weight == r] for r in range(SEGMENT + 1)]


def codes_of(vectors: pa.Array, dims: int) -> np.ndarray:
    """Codes of a list column without nulls, as segments."""
    n = vectors.value_lengths().to_numpy().astype(np.int64)
    flat = np.nan_to_num(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), nan=0.0) > 0
    bits = np.zeros((len(n), -(-dims // SEGMENT) * SEGMENT), bool)
    place = ragged(np.zeros(len(n), np.int64), n)
    kept = place < dims
    bits[np.repeat(np.arange(len(n)), n)[kept], place[kept]] = flat[kept]
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint16)


class Index:
    """Distinct codes by the value of each segment, and the k smallest ids of each code."""

    def __init__(self, codes: np.ndarray, ids: np.ndarray, k: int):
        order = np.lexsort((ids, *codes.T[::-1]))
        codes, ids = codes[order], ids[order]
        new = np.ones(len(codes), bool)
        new[1:] = (codes[1:] != codes[:-1]).any(1)
        first = np.flatnonzero(new)
        self.codes, self.ids, self.first, self.k = codes[first], ids, first, k
        self.copies = np.minimum(np.diff(np.append(first, len(ids))), k)
        self.order = [np.argsort(c, kind="stable") for c in self.codes.T]
        self.starts = [np.searchsorted(c[o], np.arange((1 << SEGMENT) + 1)) for c, o in zip(self.codes.T, self.order, strict=True)]

    def search(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest."""
        seen = np.zeros(len(self.codes), bool)
        met, distance = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for radius in range(SEGMENT + 1):
            for s, (order, starts) in enumerate(zip(self.order, self.starts, strict=True)):
                values = (flips()[radius] ^ query[s]).astype(np.int64)
                low = starts[values]
                found = order[ragged(low, starts[values + 1] - low)]  # a code has one value, so none comes twice
                found = found[~seen[found]]
                seen[found] = True
                met = np.concatenate([met, found])
                distance = np.concatenate([distance, np.bitwise_count(self.codes[found] ^ query).sum(1, dtype=np.int64)])
            if self.copies[met[distance < len(query) * (radius + 1)]].sum() >= self.k or seen.all():
                break
        ids = self.ids[ragged(self.first[met], self.copies[met])]
        distance = np.repeat(distance, self.copies[met])
        best = np.lexsort((ids, distance))[: self.k]
        return ids[best], distance[best]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, dims: int = 64) -> DataFrame:
    """vectors, queries: vec_id, embedding. query_id, rank, vec_id, distance of the k nearest of each query."""
    usable = "vec_id is not null and embedding is not null"

    def coded(rows: DataFrame) -> DataFrame:
        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                codes = codes_of(b.column("embedding"), dims)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([c.tobytes() for c in codes], pa.binary())], names=["vec_id", "code"])

        return rows.where(usable).select("vec_id", F.col("embedding").cast("array<float>").alias("embedding")).mapInArrow(made, "vec_id long, code binary")

    def table(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint16).reshape(t.num_rows, -1)
        return t.column("vec_id").to_numpy(), codes

    def nearest(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        (ids, codes), (names, asked) = table(left), table(right)
        index = Index(codes, ids, k) if left.num_rows and right.num_rows else None
        found = [index.search(q) for q in asked] if index else []
        names = names if index else names[:0]
        flat = lambda i, kind: np.concatenate([x[i] for x in found] or [np.zeros(0)]).astype(kind)
        return pa.table([pa.array(np.repeat(names, [len(x) for x, _ in found]).astype(np.int64)), pa.array(flat(0, np.int64)), pa.array(flat(1, np.int32))], names=["query_id", "vec_id", "distance"])

    # Each part of the codes meets each block of the queries in a task of its own, where the part is indexed once for
    # the block; neither goes through the driver.
    n = vectors.where(usable).count()
    parts = max(-(-n // CHUNK), min(LEAST_PARTS, n // 8192 + 1))
    blocks = max(1, -(-queries.where(usable).count() // QUERY_BLOCK))
    deal = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = coded(vectors).withColumn("part", deal(parts, "part")).withColumn("block", every(blocks))
    asked = coded(queries).withColumn("block", deal(blocks, "block")).withColumn("part", every(parts))
    found = held.groupBy("part", "block").cogroup(asked.groupBy("part", "block")).applyInArrow(nearest, "query_id long, vec_id long, distance int")
    best = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def op6(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


ORACLE_SQL = """
WITH coded AS (SELECT vec_id, list_transform(embedding, lambda x: coalesce(x, 0) > 0) AS bits FROM embeddings WHERE embedding IS NOT NULL),
pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.bits, v.bits), lambda p: CAST(p[1] <> p[2] AS INTEGER))) AS INTEGER) AS distance
  FROM coded q, coded v WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
"""
