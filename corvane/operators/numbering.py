"""Numbers and running values in an order, without a task that sorts a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.sources.scratch import scratch


def ranged(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with the number (range__) of the range of keys and order that they are in, written to the shared folder, so that it stays."""
    work = scratch(rows.sparkSession, "ranges")
    rows.repartitionByRange(*keys, *order).withColumn("range__", F.spark_partition_id()).write.parquet(work)
    return rows.sparkSession.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, range__ int").parquet(work)


def last_known(ranges: DataFrame, keys: list[str], order: list[str], value: Column, output: str, own: bool = True) -> DataFrame:
    """Rows of `ranged` with the last value that is not null among those of the same keys so far, the row itself included if `own`.

    Each range finds its own; what it has none of comes from the ranges before, a row for each range and key.
    """
    rows = ranges.withColumn("value__", value)
    within = F.last("value__", ignorenulls=True).over(Window.partitionBy(*keys, "range__").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1))
    last = rows.groupBy(*keys, "range__").agg(F.max_by("value__", F.when(F.col("value__").isNotNull(), F.struct(*order))).alias("last__"))
    before = F.last("last__", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("range__").rowsBetween(Window.unboundedPreceding, -1))
    carried = last.select(*keys, "range__", before.alias("before__")).alias("b")
    placed = rows.withColumn("within__", within).alias("r").join(carried, [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*keys, "range__")])
    return placed.select(*[f"r.{c}" for c in ranges.columns], F.coalesce("within__", "before__").alias(output))


def numbered(rows: DataFrame, keys: list[str], order: list[str], output: str) -> DataFrame:
    """Rows with a number (int) from 0 in each group of `keys` by `order`.

    Ranges of the order are sorted apart from each other; counts of the ranges (a row for each range and group in it)
    say where each one's numbers begin. The ranges are written to the shared folder first, so that they are the same
    where they are counted and where they are numbered. Rows that tie in keys and order fall in one range, in any order.
    """
    ranges = ranged(rows, keys, order)
    counts = ranges.groupBy(*keys, "range__").agg(F.count("*").alias("n__"))
    before = counts.withColumn("before__", F.sum("n__").over(Window.partitionBy(*keys).orderBy("range__")) - F.col("n__")).drop("n__")
    within = F.row_number().over(Window.partitionBy(*keys, "range__").orderBy(*order)) - 1
    placed = ranges.withColumn("within__", within).alias("r").join(before.alias("b"), [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*keys, "range__")])
    return placed.select(*[f"r.{c}" for c in rows.columns], (F.col("within__") + F.col("before__")).cast("int").alias(output))
