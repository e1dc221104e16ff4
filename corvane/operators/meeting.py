"""Two sides of rows that meet by a key, one side kept in memory and the other streamed past it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Fold(Protocol):
    """What a key's asked rows do with the held ones."""

    def add(self, held: pa.RecordBatch) -> None: ...

    def result(self) -> pa.Table | None: ...


def meet(asked: DataFrame, held: DataFrame, fold: Callable[[pa.Table], Fold], schema: str) -> DataFrame:
    """For each value of `meet` (long) that both have: a fold of the asked rows, to which the held rows are added in batches, and its result.

    Both sides are dealt by `meet` in one shuffle and sorted, asked rows first, so a task keeps one key's asked rows and
    one batch of held rows. Column names of the sides differ but for `meet`.
    """
    columns = [c for c in asked.columns if c != "meet"], [c for c in held.columns if c != "meet"]
    blank = lambda d, names: [F.lit(None).cast(d.schema[c].dataType).alias(c) for c in names]
    left = asked.select("meet", F.lit(0).alias("kind"), *columns[0], *blank(held, columns[1]))
    right = held.select("meet", F.lit(1).alias("kind"), *blank(asked, columns[0]), *columns[1])
    dealt = left.unionByName(right).repartition("meet").sortWithinPartitions("meet", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting, going = None, [], None
        for batch in batches:
            both = batch.column("meet").to_numpy(), batch.column("kind").to_numpy()
            new = np.flatnonzero((np.diff(both[0]) != 0) | (np.diff(both[1]) != 0)) + 1
            ends = [0, *new.tolist(), batch.num_rows] if batch.num_rows else [0]
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                if both[0][a] != key:
                    if going is not None and (out := going.result()) is not None:
                        yield from out.to_batches()
                    key, waiting, going = both[0][a], [], None
                part = batch.slice(a, b - a)
                if both[1][a] == 0:
                    waiting.append(part.select(columns[0]))
                    continue
                if going is None and waiting:
                    going = fold(pa.Table.from_batches(waiting))
                if going is not None:
                    going.add(part.select(columns[1]))
        if going is not None and (out := going.result()) is not None:
            yield from out.to_batches()

    return dealt.mapInArrow(run, schema)


def best_rows(table: pa.Table, k: int, order: list[tuple[str, str]]) -> pa.Table:
    """The first k rows of each value of the first column of the order."""
    table = table.sort_by(order)
    key = table.column(order[0][0]).to_numpy()
    first = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
    begin = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
    return table.filter(pa.array(np.arange(len(key)) - begin < k))
