"""Mixing sources to target weights by capped water-filling.

A source's target is min(cap, level * weight), cap being `max_epochs` times its size, where the level makes the targets
sum to the budget; that is what clamping at the cap and dealing out the excess by weight comes to. Each document is
then taken floor(target / size) times, and once more where a seeded threshold and the words still owed to the target
say so. Sources sort by code point, null last; a null or empty text has size 0 and is taken 0 words. An empty table
gives no rows. Columns of the input called size, source_size, target or reps are replaced. Repeated rows count as documents of their
own; those that differ in other columns only are told apart by a hash of them, so reruns take the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import WORD, unlike

WEIGHTS = (5.0, 2.0, 1.0)
#: Documents of a source that are dealt out together.
SHARD = 4096


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """sizes: source, source_size, one row each. Adds weight and target."""
    ordered = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    place = F.row_number().over(ordered) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    d = sizes.withColumn("weight", weight)
    d = d.withColumn("cap", max_epochs * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight")).withColumn("budget", share * F.sum("source_size").over(everything))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    d = d.withColumn("level", level)
    # the first source, by ratio, that the level of those from it on doesn't fill sets the level for all
    d = d.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    return d.select("source", "source_size", "weight", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"))


def _dealt(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_batches(batches)
    size, threshold, rate, tie = (t.column(c).to_numpy() for c in ("size", "threshold", "rate", "tie"))
    # large documents first, so that the small ones settle what is still owed
    order = np.lexsort((tie, threshold, -np.floor(np.log2(np.maximum(size, 1)))))
    reps, owed = np.zeros(len(size), np.int64), 0.0
    for i, n, u, r in zip(order.tolist(), size[order].tolist(), threshold[order].tolist(), rate[order].tolist(), strict=True):
        owed += (r % 1) * n
        reps[i] = int(r)
        if n and r % 1 and owed > 0 and owed >= u * n:
            reps[i] += 1
            owed -= n
    yield pa.RecordBatch.from_arrays([t.column(c).combine_chunks() for c in ("row", "source", "size", "source_size", "target")] + [pa.array(reps)], names=["row", "source", "size", "source_size", "target", "reps"])


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, max_epochs: float = 2.0, seed: int = 11, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (doc_id, source by default) with size, source_size, target and reps. Sources are few (a row each is sorted in one task); documents of a source are dealt out in shards of about SHARD rows."""
    keep = unlike(["doc_id", "source"] if keep is None else keep, "size", "source_size", "target", "reps")
    row = F.struct(*keep)
    sized = docs.select(row.alias("row"), F.col("source").alias("source"), words(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", F.col("text")).alias("h"), F.xxhash64(row).alias("tie"))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goal = targets(totals.select("source", "source_size"), weights, share, max_epochs).join(totals.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), "source_size", "target", "n")
    ready = (
        sized.join(goal, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "h"), F.ceil(F.col("n") / SHARD)))
        .withColumn("threshold", F.pmod("h", F.lit(1 << 30)).cast("double") / (1 << 30))
        .withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_epochs)))).otherwise(0.0))
        .select("row", "source", "size", "source_size", "target", "shard", "threshold", "rate", "tie")
    )
    dealt = ready.groupBy("source", "shard").applyInArrow(_dealt, ready.select("row", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("reps")).schema)
    return dealt.select("row.*", "size", "source_size", "target", "reps")


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs, keep=["doc_id"]).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("reps")).alias("taken"), "reps")
