"""Benchmark decontamination: BM25 over an inverted index of test items, searched by block-max WAND.

A document's query is all its words that stand in runs of words which the index holds, wherever in the document; all
items with a score over their threshold are retrieved, and an item is reported for a document if enough of its question
and of its answer (its last sentences) stand in the document as runs of words. An item's threshold is the least score
that such an overlap can have, so every item that would be reported is retrieved, however long it is, however far apart
its parts stand and whatever block of the benchmark it is indexed with.

The index goes to the executors in blocks of at most BLOCK_BYTES of item text, one pass over the documents for each
block, so no broadcast grows with the benchmark. Null and empty texts and items give no match; an item shorter than a
run of words must occur whole. Repeated item ids are items of their own; repeated document rows are reported once.
Document frequencies, the number of items and their mean length are those of the whole benchmark for every block. Rows
of documents without an id are not reported, yet `clean` drops them if they hold an item. An empty table of documents
gives no rows, an empty benchmark no matches; extra columns stay in `clean` and are left out of `leaks`.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import as_bytes, checkpointed

K1, B = 1.2, 0.75
#: A score of 1, less what rounding may take.
LEAST = 1 - 1e-5
#: Words of a run; shares of the question's and the answer's words that must be covered by runs.
RUN, QUESTION, ANSWER = 5, 0.6, 0.5
#: The answer is as many last sentences as have this many words, or the last quarter where they are over half.
LEAST_ANSWER = 8
#: Items of a block of the index, at least, and blocks at most.
RANGE, RANGES = 2, 128
BLOCK_BYTES = 1 << 20
_SENTENCE = re.compile(rb"(?<=[.!?])\s+")


@dataclass
class Index:
    """Postings of items by term. A weight is the item's BM25 weight over its threshold, so a score of 1 retrieves it.

    runs: sorted hashes of the items' runs by their length; it is less than RUN for items that are shorter.
    Items are numbered; `range` of them in a row make a block, and block_max holds a term's greatest weight in each.
    """

    ids: list
    words: list[list[bytes]]
    answer_from: list[int]  # the place of the answer's first word
    range: int = RANGE
    term: dict[bytes, int] = field(default_factory=dict)
    postings: list[list[tuple[int, float]]] = field(default_factory=list)
    block_max: np.ndarray = field(default_factory=lambda: np.zeros((1, 1), np.float32))
    most: np.ndarray = field(default_factory=lambda: np.zeros(1, np.float32))
    runs: dict[int, np.ndarray] = field(default_factory=dict)

    def search(self, query: list[int]) -> list[int]:
        """Items with a score of 1 or more over these distinct terms, by block-max WAND."""
        cursors = [[self.postings[t], 0, float(self.most[t]), self.block_max[t]] for t in query]
        found = []
        while True:
            cursors = [c for c in cursors if c[1] < len(c[0])]
            cursors.sort(key=lambda c: c[0][c[1]][0])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[2]
                if bound >= LEAST:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0][cursors[pivot][1]][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0][cursors[pivot + 1][1]][0] == item:
                pivot += 1
            block = item // self.range
            if sum(float(c[3][block]) for c in cursors[: pivot + 1]) < LEAST:
                # no item before the next block, or before the next term's item, can reach the score
                target = (block + 1) * self.range
                if pivot + 1 < len(cursors):
                    target = min(target, cursors[pivot + 1][0][cursors[pivot + 1][1]][0])
                for c in cursors[: pivot + 1]:
                    self._advance(c, target)
            elif cursors[0][0][cursors[0][1]][0] == item:
                if sum(c[0][c[1]][1] for c in cursors[: pivot + 1]) >= LEAST:
                    found.append(item)
                for c in cursors[: pivot + 1]:
                    c[1] += 1
            else:
                for c in cursors[:pivot]:
                    self._advance(c, item)

    @staticmethod
    def _advance(c: list, item: int) -> None:
        while c[1] < len(c[0]) and c[0][c[1]][0] < item:
            c[1] += 1

    def query(self, terms: np.ndarray) -> list[int]:
        """Distinct terms of a document that stand in runs of the index. terms: of each word, -1 for none."""
        covered = np.zeros(len(terms) + 1, np.int64)
        for n, known in self.runs.items():
            starts = _whole(terms, n)
            hashes = _hashes(terms, starts, n)
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            starts = starts[known[at] == hashes]
            covered[starts] += 1
            np.subtract.at(covered, starts + n, 1)
        return np.unique(terms[np.cumsum(covered[:-1]) > 0]).tolist()


def _whole(terms: np.ndarray, n: int) -> np.ndarray:
    """Starts of the runs of n words that all have a term."""
    if len(terms) < n:
        return np.zeros(0, np.int64)
    lacking = np.concatenate([[0], np.cumsum(terms < 0)])
    return np.flatnonzero(lacking[n:] == lacking[:-n])


def _hashes(terms: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(starts), np.uint64)
    for k in range(n):
        out = (out ^ (terms[starts + k].astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _threshold(words: list[bytes], cut: int, weights: dict[bytes, float]) -> float:
    """The least score of the item's words in a document that holds enough of its question and answer; an item shorter than a run needs all.

    A word's weight is dealt out evenly over its places, so covered places never sum to more than their words score.
    """
    tf = Counter(words)
    if len(words) < RUN:
        return sum(weights.values())
    places = [weights[w] / tf[w] for w in words]
    parts = ((places[:cut], QUESTION), (places[cut:], ANSWER))
    return sum(sum(sorted(p)[: math.ceil(share * len(p) - 1e-9)]) for p, share in parts)


@dataclass
class Corpus:
    """Of a whole benchmark: items, their mean length in words, and in how many of them words occur."""

    n: int
    mean: float
    df: dict[bytes, int]

    @classmethod
    def of(cls, texts: list[bytes]) -> Corpus:
        words = [w for w in (t.lower().split() for t in texts) if w]
        return cls(len(words), sum(map(len, words)) / max(1, len(words)), Counter(w for x in words for w in set(x)))


def build(items: list[tuple], corpus: Corpus | None = None) -> Index:
    """items: (id, text as bytes); corpus: of the benchmark that they are a block of, or all of where it is left out."""
    index, corpus = Index([], [], []), corpus or Corpus.of([text for _, text in items])
    for i, text in items:
        words = text.lower().split()
        if words:
            index.ids.append(i)
            index.words.append(words)
            last = 0
            for sentence in reversed(_SENTENCE.split(text.strip())):
                if last >= LEAST_ANSWER:
                    break
                last += len(sentence.split())
            index.answer_from.append(len(words) - (last if last <= len(words) // 2 else -(-len(words) // 4)))
    n = len(index.words)
    df, terms = corpus.df, {w for words in index.words for w in words}
    index.term = {w: k for k, w in enumerate(sorted(terms))}
    index.postings = [[] for _ in terms]
    index.range = max(RANGE, -(-n // RANGES))
    for item, words in enumerate(index.words):
        weights = {w: math.log(1 + (corpus.n - df[w] + 0.5) / (df[w] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / corpus.mean)) for w, tf in Counter(words).items()}
        threshold = _threshold(words, index.answer_from[item], weights)
        for w in sorted(weights):
            index.postings[index.term[w]].append((item, weights[w] / threshold))
    index.block_max = np.zeros((max(1, len(terms)), max(1, -(-n // index.range))), np.float32)
    for t, postings in enumerate(index.postings):
        for item, weight in postings:
            index.block_max[t, item // index.range] = max(index.block_max[t, item // index.range], weight)
    index.most = index.block_max.max(1)
    runs: dict[int, list[np.ndarray]] = {}
    for words in index.words:
        terms, size = np.array([index.term[w] for w in words], np.int64), min(RUN, len(words))
        runs.setdefault(size, []).append(_hashes(terms, _whole(terms, size), size))
    index.runs = {size: np.unique(np.concatenate(x)) for size, x in sorted(runs.items())}
    return index


def _runs(words: list[bytes]) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + RUN]) for i in range(len(words) - RUN + 1)}


def overlap(index: Index, item: int, runs: set[tuple[bytes, ...]], words: list[bytes]) -> tuple[float, float]:
    """Shares of the item's question and answer that stand in the document in runs of RUN words."""
    own, cut = index.words[item], index.answer_from[item]
    covered = np.zeros(len(own), bool)
    if len(own) < RUN:
        n = len(own)
        covered[:] = any(words[i : i + n] == own for i in range(len(words) - n + 1))
    else:
        for i in range(len(own) - RUN + 1):
            if tuple(own[i : i + RUN]) in runs:
                covered[i : i + RUN] = True
    return float(covered[:cut].mean()) if cut else 1.0, float(covered[cut:].mean()) if cut < len(own) else 1.0


def matches(index: Index, raw: bytes) -> list[tuple]:
    """(item id, share of question, share of answer) of the items that the document holds."""
    words = raw.lower().split()
    if not words or not index.ids:
        return []
    terms = np.array([index.term.get(w, -1) for w in words], np.int64)
    found = index.search(index.query(terms))
    if not found:
        return []
    runs, out = _runs(words), []
    for item in sorted(found):
        question, answer = overlap(index, item, runs, words)
        if question >= QUESTION and answer >= ANSWER:
            out.append((index.ids[item], question, answer))
    return out


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list[tuple], Corpus]]:
    """Items in blocks of at most about BLOCK_BYTES of text, read one block at a time, with the benchmark's figures for their words."""
    items = benchmark.where("text is not null and item_id is not null").select("item_id", F.col("text").cast("binary").alias("raw"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each word of an item once, with the item's block; and each item's length, without a word."""
        for batch in batches:
            out: list[tuple] = []
            for block, raw in zip(batch.column("block").to_pylist(), as_bytes(batch.column("raw")), strict=True):
                words = raw.lower().split()
                if words:
                    out.append((block, None, len(words)))
                    out += [(block, w, 1) for w in set(words)]
            yield pa.RecordBatch.from_pydict({k: pa.array([x[i] for x in out], t) for i, (k, t) in enumerate((("block", pa.int32()), ("word", pa.binary()), ("n", pa.int64())))})

    size = items.agg(F.coalesce(F.sum(F.length("raw")), F.lit(0))).first()[0]
    n = size // BLOCK_BYTES + 1
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "raw"), F.lit(n)).cast("int"))
    words = items.mapInArrow(counted, "block int, word binary, n long").groupBy("block", "word").agg(F.sum("n").alias("n"), F.count("*").alias("items"))
    if n > 1:  # a block's words go to the driver with it, and no others
        total = words.where("word is not null").groupBy("word").agg(F.sum("n").alias("total"))
        words = checkpointed(words.where("word is not null").join(total, "word").select("block", "word", F.col("total").alias("n"), "items").unionByName(words.where("word is null")))
    totals = words.where("word is null").agg(F.sum("items"), F.sum("n")).first()
    for k in range(n):
        df = {bytes(r["word"]): r["n"] for r in words.where(F.col("word").isNotNull() & (F.col("block") == k)).toLocalIterator()}
        yield sorted((r["item_id"], bytes(r["raw"])) for r in items.where(F.col("block") == k).toLocalIterator()), Corpus(totals[0] or 0, (totals[1] or 0) / max(1, totals[0] or 0), df)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, question_share, answer_share of each leak."""
    raw = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    out = None
    for block in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(build(*block))  # of at most about BLOCK_BYTES of text

        def searched(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                rows = [(d, *m) for d, r in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("raw")), strict=True) for m in matches(index, r)]
                yield pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate((("doc_id", pa.int64()), ("item_id", pa.int64()), ("question_share", pa.float64()), ("answer_share", pa.float64())))})

        found = raw.mapInArrow(searched, "doc_id long, item_id long, question_share double, answer_share double")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.max("question_share").alias("question_share"), F.max("answer_share").alias("answer_share"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold an item; rows with null text stay, extra columns too. One pass: rows are kept or dropped where they are searched, no join."""
    out, at = docs, [c.lower() for c in docs.columns].index("text")
    for block in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(build(*block))

        def kept(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                yield batch.filter(pa.array([t is None or not matches(index, t.encode("utf-8", "surrogatepass")) for t in batch.column(at).to_pylist()], pa.bool_()))

        out = out.mapInArrow(kept, docs.schema)
    return out


def op9(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
