"""Language identification of mixed-language text.

The script of a word narrows the candidate languages, hashed character n-grams score the word under each of them, and
a Viterbi pass with a switching penalty labels spans. A document's language is the one with most letters in its spans,
its score their share. Null text, and text without a letter: `und` with score 0. Ties go to the language that sorts
first. Without training rows everything with a letter is `und` too. Repeated rows are labelled each, an empty table
gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import fold, hash_below, slices, unlike

SLOTS = 1 << 16
SWITCH_PENALTY = 12.0
#: Training documents a language, about.
MAX_PER_LANG = 4_000
#: Starts of script ranges (fixed values of the Unicode block table): first code point, script.
SCRIPT_STARTS = [
    (0x0, 0), (0x370, 1), (0x400, 2), (0x530, 3), (0x590, 4), (0x600, 5), (0x780, 0), (0x900, 6), (0x980, 7), (0xA00, 8), (0xA80, 9), (0xB00, 10),
    (0xB80, 11), (0xC00, 12), (0xC80, 13), (0xD00, 14), (0xD80, 15), (0xE00, 16), (0xE80, 17), (0xF00, 18), (0x1000, 19), (0x10A0, 20), (0x1100, 21),
    (0x1200, 22), (0x13A0, 0), (0x1780, 23), (0x1800, 24), (0x18B0, 0), (0x1F00, 1), (0x2000, 0), (0x3040, 25), (0x3100, 26), (0x3130, 21), (0x3190, 26),
    (0xAC00, 21), (0xD800, 0), (0xF900, 26), (0xFB00, 0), (0xFB50, 5), (0xFE00, 0), (0x20000, 26),
]
N_SCRIPTS = 27


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: is it a letter; its lower case (the first code point of it)."""
    n = 0x110000
    return np.fromiter((chr(i).isalpha() for i in range(n)), bool, n), np.fromiter((ord(chr(i).lower()[0]) for i in range(n)), np.uint32, n)


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(16)).astype(np.int64)


def scan(texts: list[str]) -> dict:
    """Words of all texts: their document, first and end code point, script; slots of n-grams with their word."""
    letter, lower = _tables()
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    lengths = np.array([len(c) + 3 for c in codes], np.int64)  # three separators, so no n-gram crosses texts
    begins = np.concatenate([[0], np.cumsum(lengths)])
    c = np.zeros(begins[-1] + 3, np.uint32)
    for b, x in zip(begins, codes, strict=False):
        c[b + 3 : b + 3 + len(x)] = x
    is_letter = letter[c]
    c = np.where(is_letter, lower[c], 0).astype(np.uint32)
    edge = np.diff(is_letter.astype(np.int8))
    first, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    doc = np.searchsorted(begins, first, "right") - 1
    starts, script_of = np.array([s for s, _ in SCRIPT_STARTS]), np.array([s for _, s in SCRIPT_STARTS])
    at = np.flatnonzero(is_letter | np.concatenate([[False], is_letter[:-1]]))  # letters and the place after each word
    word = np.searchsorted(first, at, "right") - 1
    a, b, d = c[at - 2], c[at - 1], c[at]
    a = np.where(b == 0, 0, a).astype(np.uint32)
    pair = _mix(b * np.uint32(0x85EBCA6B) + d * np.uint32(0xC2B2AE35) + np.uint32(1))
    triple = _mix(a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA6B) + d * np.uint32(0xC2B2AE35) + np.uint32(7))
    return {"doc": doc, "first": first - begins[doc] - 3, "end": end - begins[doc] - 3, "script": script_of[np.searchsorted(starts, c[first], "right") - 1], "word": word, "pair": pair, "triple": triple}


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float, block: int = 64) -> np.ndarray:
    """Best labels of words, text after text (counts: words of each), where each change of label costs `penalty`.

    Texts are cut into blocks that are solved side by side for every entering label; the blocks of a text are then
    chained, so one long text costs no more than many short ones.
    """
    n, k = scores.shape
    counts = counts[counts > 0]
    blocks_of = -(-counts // block)
    first_block = np.concatenate([[0], np.cumsum(blocks_of)])
    total = first_block[-1]
    begin = np.cumsum(counts) - counts
    inside = np.arange(n) - np.repeat(begin, counts)
    where = (np.repeat(first_block[:-1], counts) + inside // block, inside % block)
    s = np.zeros((total, block, k), np.float32)
    s[where] = scores
    through = np.where(np.eye(k, dtype=bool), 0, -1e30).astype(np.float32)[None].repeat(total, 0)
    for t in range(block):
        through = np.maximum(through, through.max(2, keepdims=True) - penalty) + s[:, t, None, :]
    entering, leaving = np.zeros((total, k), np.float32), np.zeros((total, k), np.float32)
    for step in range(int(blocks_of.max(initial=0))):
        own = first_block[:-1][blocks_of > step] + step
        if step:
            entering[own] = leaving[own - 1] - leaving[own - 1].max(1, keepdims=True)
        leaving[own] = (entering[own][:, :, None] + through[own]).max(1)
    del through
    at, best = entering, np.empty((total, block, k), np.float32)
    for t in range(block):
        best[:, t] = at = np.maximum(at, at.max(1, keepdims=True) - penalty) + s[:, t]

    def before(values: np.ndarray, now: np.ndarray) -> np.ndarray:
        stay = np.take_along_axis(values, now, 1) >= values.max(1, keepdims=True) - penalty
        return np.where(stay, now, values.argmax(1)[:, None])

    path = np.empty((total, block, k), np.int16)
    path[:, -1] = now = np.arange(k)[None].repeat(total, 0)
    for t in range(block - 2, -1, -1):
        path[:, t] = now = before(best[:, t], now)
    into = before(entering, now)
    last = np.zeros(total, np.int64)
    for step in range(int(blocks_of.max(initial=0))):  # from the last block of each text to its first
        own = first_block[1:][blocks_of > step] - 1 - step
        ends = step == 0
        last[own] = leaving[own].argmax(1) if ends else into[own + 1, last[own + 1]]
    return path[where[0], where[1], last[where[0]]].astype(np.int64)


@dataclass
class Model:
    langs: list[str]
    pair: np.ndarray  # SLOTS x languages, log shares
    triple: np.ndarray
    script: np.ndarray  # N_SCRIPTS x languages: may a word of this script be of the language

    def label(self, texts: list[str]) -> tuple[list[str], np.ndarray, list[list[tuple[int, int, str]]]]:
        """Language, score and spans (first and end code point, language) of each text."""
        langs, scores, spans = ["und"] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
        words = scan(texts)
        if not len(words["doc"]) or not self.langs:
            return langs, scores, spans
        heads = np.flatnonzero(np.diff(words["word"], prepend=-1))
        by_word = np.add.reduceat(self.triple[words["triple"]] + np.float32(0.5) * self.pair[words["pair"]], heads, axis=0)
        by_word += np.where(self.script[words["script"]], 0, -50).astype(np.float32)
        doc = words["doc"]
        labels = viterbi(by_word, np.bincount(doc, minlength=len(texts)), SWITCH_PENALTY)
        letters = np.zeros((len(texts), len(self.langs)))
        np.add.at(letters, (doc, labels), words["end"] - words["first"])
        some = letters.sum(1) > 0
        scores[some] = letters[some].max(1) / letters[some].sum(1)
        top = letters.argmax(1)
        cut = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(labels, prepend=-1) != 0))
        for a, b in zip(cut, [*cut[1:], len(doc)], strict=True):
            spans[doc[a]].append((int(words["first"][a]), int(words["end"][b - 1]), self.langs[labels[a]]))
        return [self.langs[top[i]] if some[i] else "und" for i in range(len(texts))], scores, spans


def fit(docs: DataFrame, held: int = 2, folds: int = 4) -> Model:
    """Counts of n-grams and scripts over about MAX_PER_LANG training documents a language, drawn by hash."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", folds) != held))
    known = known.select("doc_id", F.col("lang").alias("lang"), F.col("text").alias("text"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((SLOTS, 0)), np.zeros((SLOTS, 0)), np.zeros((N_SCRIPTS, 0), bool))
    chosen = F.lit(False)
    for x in langs:
        chosen = F.when(F.col("lang") == x, hash_below(F.col("doc_id"), MAX_PER_LANG / sizes[x])).otherwise(chosen)
    index = {x: i for i, x in enumerate(langs)}
    width = 2 * SLOTS + N_SCRIPTS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), width), np.int64)
        for batch in batches:
            lang, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for a, b in slices([len(t) for t in texts], 500_000):
                w = scan(texts[a:b])
                of = np.array([index[x] for x in lang[a:b]])
                at = of[w["doc"]]
                np.add.at(total, (at, 2 * SLOTS + w["script"]), 1)
                for start, kind in ((0, "pair"), (SLOTS, "triple")):
                    total += np.bincount(at[w["word"]] * width + start + w[kind], minlength=total.size).reshape(total.shape)
        lang, slot = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(total[lang, slot])], names=["lang", "slot", "n"])

    got = known.where(chosen).select("lang", "text").mapInArrow(counted, "lang int, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((len(langs), width))
    total[got.column("lang").to_numpy(), got.column("slot").to_numpy()] = got.column("n").to_numpy()
    log_share = lambda x: np.log((x + 0.5) / (x + 0.5).sum(1, keepdims=True)).T.astype(np.float32)
    scripts = total[:, 2 * SLOTS :]
    may = scripts >= 0.01 * np.maximum(scripts.sum(1, keepdims=True), 1)
    may |= ~may.any(0)  # a script that no language uses excludes none
    return Model(langs, log_share(total[:, :SLOTS]), log_share(total[:, SLOTS : 2 * SLOTS]), may.T.copy())


def label(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns `keep` with lang_pred, score and spans array<struct<first, end, lang>>, which replace columns of these names."""
    keep = unlike(keep, "lang_pred", "score", "spans")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded: two tables of SLOTS rows a language
    span = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column("~text").to_pylist()]
            langs, scores, spans = [], [], []
            for a, b in slices([len(t) for t in texts], 500_000):
                x, y, z = m.label(texts[a:b])
                langs += x
                scores += y.tolist()
                spans += [[{"first": p, "end": q, "lang": r} for p, q, r in one] for one in z]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, span)], names=[*keep, "lang_pred", "score", "spans"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, F.col("text").alias("~text")).mapInArrow(labelled, f"{fields}, lang_pred string, score double, spans array<struct<first:int,end:int,lang:string>>")


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs)
    rows = docs.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "text")
    return label(rows, model, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))
