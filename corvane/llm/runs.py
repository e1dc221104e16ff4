"""Periodic runs of words: stretches in which a piece of text repeats itself end to end.

A run is a stretch of consecutive words with smallest period q and length >= max(least, times * q) that no neighbouring
word extends with that period. Two copies of a run, q words apart, agree in max(least, times * q) - q words at least. So
each band of lags has an n-gram that every one of its runs holds twice: for lags from a to k, the k-gram, k being the
smallest such overlap of the band. k-grams are told apart exactly, by ranks of their halves, within a document. As k is
not below the lag, a k-gram inside a run occurs next q words on and nowhere between, so pairs of neighbouring occurrences
are all the seeds there are, and a seed's lag is the smallest period. Seeds of a lag are extended in order, both ways, and
those under the furthest word covered so far at that lag are passed over.

One scan, whole texts, no shuffle. A null or empty text has no words, no runs and an empty collapsed text. Words are
separated by ASCII white space. Rows are independent, so repeated rows give repeated results and an empty table none.
Columns of the input called runs or collapsed, in any case, are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import WORD, as_bytes, slices, unlike

#: Bytes of text looked at together.
SLICE = 4 << 20
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def bands(longest: int, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(first lag, last lag, k): runs of these lags hold two equal k-grams a lag apart, and k is not below the lag."""
    overlap = lambda q: max(least, times * q) - q
    first, k = 1, min(overlap(q) for q in range(1, least // times + 2))
    while max(least, times * first) <= longest:
        yield first, k, k
        first = k + 1
        k = overlap(first)


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading values agree."""
    n, step, most = 0, 64, min(len(a), len(b))
    while n < most:
        same = a[n : n + step][: most - n] == b[n : n + step][: most - n]
        if not same.all():
            return n + int(same.argmin())
        n, step = n + len(same), 2 * step
    return most


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts the keys and keeps places ascending, and where in it a key equals the one before."""
    order = np.argsort(key, kind="stable")
    return order, key[order[1:]] == key[order[:-1]]


def _repeated(at: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """Ranks of keys by place; -1 where a key occurs once or isn't given."""
    rank = np.full(n, -1, np.int64)
    if len(key):
        order, same = _groups(key)
        shared = np.zeros(len(key), bool)
        shared[1:] |= same
        shared[:-1] |= same
        number = np.concatenate([[0], np.cumsum(~same)])
        rank[at[order[shared]]] = number[shared]
    return rank


def find(words: np.ndarray, longest: int, least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs. Words of different documents are different numbers."""
    n, found, size = len(words), [], 1
    rank = _repeated(np.arange(n), words, n)
    for first, last, k in bands(longest, least, times):
        while 2 * size <= k:  # ranks of k-grams from those of half their length
            at = np.flatnonzero(rank[: n - size] >= 0) if n > size else np.zeros(0, np.int64)
            at = at[rank[at + size] >= 0]
            rank, size = _repeated(at, rank[at] * n + rank[at + size], n), 2 * size
        at = np.flatnonzero(rank[: max(n - (k - size), 0)] >= 0)
        at = at[rank[at + k - size] >= 0]
        if not len(at):
            break  # longer n-grams occur once too
        order, same = _groups(rank[at] * n + rank[at + k - size])
        seed, lag = at[order[:-1][same]], (at[order[1:]] - at[order[:-1]])[same]
        inside = (lag >= first) & (lag <= last)
        seed, lag = seed[inside], lag[inside]
        order = np.lexsort((seed, lag))
        seed, lag = seed[order], lag[order]
        cuts = np.flatnonzero(np.diff(lag)) + 1
        for own, q in zip(np.split(seed, cuts), lag[np.concatenate([[0], cuts])] if len(lag) else (), strict=False):
            i, q = 0, int(q)
            while i < len(own):
                s = int(own[i])
                end = s + k + _agreeing(words[s + k :], words[s + k + q :])
                start = s - _agreeing(words[:s][::-1], words[: s + q][::-1])
                if end + q - start >= max(least, times * q):
                    found.append((start, end + q - start, q))
                i = int(np.searchsorted(own, end - k, side="right"))  # seeds up to the furthest word covered
    return found


def _looked_at(raws: list[bytes], least: int, times: int) -> tuple[pa.Array, list[bytes]]:
    """Runs and collapsed text of each document."""
    split = [r.split() for r in raws]
    counts = np.array([len(w) for w in split], np.int64)
    flat = pa.array([w for ws in split for w in ws], pa.binary()).dictionary_encode()
    document = np.repeat(np.arange(len(raws)), counts)
    words = flat.indices.to_numpy().astype(np.int64) + document * (len(flat.dictionary) + 1)
    found = np.array(find(words, int(counts.max(initial=0)), least, times), np.int64).reshape(-1, 3)
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    begin = np.cumsum(counts) - counts
    of = document[found[:, 0]]
    dropped = np.zeros(len(words) + 1, np.int64)
    np.add.at(dropped, found[:, 0] + found[:, 2], 1)
    np.add.at(dropped, found[:, 0] + found[:, 1], -1)
    kept = np.cumsum(dropped)[:-1] == 0
    collapsed = [b" ".join(w) for w in split]
    for d in np.unique(of).tolist():
        collapsed[d] = b" ".join([w for w, k in zip(split[d], kept[begin[d] : begin[d] + counts[d]].tolist(), strict=True) if k])
    runs = pa.StructArray.from_arrays([pa.array(found[:, 0] - begin[of]), pa.array(found[:, 1]), pa.array(found[:, 2])], fields=list(RUN))
    offsets = np.searchsorted(of, np.arange(len(raws) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), runs), collapsed


def periodic_runs(docs: DataFrame, keep: list[str], text: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """The columns `keep` with runs array<struct<start, length, period>> by start, then period, in words from 0, and collapsed, the text less the words that a run holds after its first period, words joined by a space."""
    if times < 3 or least < times:
        raise ValueError("runs need three periods and as many words at least")
    keep = unlike(keep, "runs", "collapsed")
    rows = docs.select(*keep, F.col(text).cast("binary").alias("~raw"))

    def looked_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = as_bytes(batch.column(len(keep)))
            for a, b in slices([len(r) + 1 for r in raws], SLICE):
                runs, collapsed = _looked_at(raws[a:b], least, times)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(keep))), runs, pa.array(collapsed, pa.binary())], names=[*keep, "runs", "~collapsed"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    out = rows.mapInArrow(looked_at, f"{fields}runs array<struct<start: long, length: long, period: long>>, `~collapsed` binary")
    return out.select(*keep, "runs", F.col("~collapsed").cast("string").alias("collapsed"))


def _once(value: Column, use) -> Column:
    """use(value), with the value evaluated once however often it is used."""
    return F.transform(F.array(value), use)[0]


def looped(doc_id: Column, text: Column) -> Column:
    """The text with the words from a on repeated with period p, for a tenth of the documents, by crc32 of the id."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def changed(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return _once(F.struct(a.alias("a"), p.alias("p")), lambda x: F.array_join(F.transform(words, lambda w, i: F.when(i < x["a"], w).otherwise(F.get(words, x["a"] + (i - x["a"]) % x["p"]))), " "))

    words = _once(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.when(F.size(w) > 0, changed(w)))
    return F.when(h % 10 == 0, F.coalesce(words, text)).otherwise(text)


def op13(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text"))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    found = periodic_runs(docs, ["doc_id"]).select("doc_id", "runs", "collapsed", best.alias("best"))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.l")).alias("length"), F.col("best.period").alias("period"),
        F.floor(-1000 * F.col("best.l") / F.col("best.period")).alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
