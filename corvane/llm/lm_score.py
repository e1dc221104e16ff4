"""Language-model scores of whole texts.

Two figures a document. The base is a unigram model with one added to every count, over words counted in all training
documents. The score comes from a causal self-attention model over the subword ids of the lower-cased words (see
attention.py) and those word counts: P(word | before) = P(its first id | before) * ((1 - u) * its share of the training
words with that first id + u * P(its other ids | before)), where the spelling ends with the chance that a new word begins,
and u is the share of training words with that first id that occur once; with the chance REPEAT, a word is drawn from
those before it in its text instead. Summed over all words this is at most 1.

What the model knows is gathered from all training documents: counts of words and of subword ids, and what stands
around each id, by which ids are grouped. The attention layer is fitted on all of them too, in ROUNDS rounds: each has a
part of the training documents of its own, together all, and more, up to all in each, where that is less than LEAST_IDS
ids. In a round, tasks train copies and Spark averages them. Texts are cut into words once: training and scoring read
the numbers of each text's words.

Null text counts as empty: it has the end token only. Rows whose doc_id is null count as training rows. Repeated rows
are scored and counted each; an empty table gives no rows. Words of over LONGEST characters are encoded in pieces.
Other columns than doc_id and text are not read.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.attention import CELLS, NEIGHBOURS, WINDOW, Attention, after_cells, averaged, cells, flattened, neighbours, softplus, train, untrained
from corvane.llm.common import as_bytes, checkpointed, distinct, fold, packed, parts_for, ragged, slices, unpacked
from corvane.llm.shingles import word_spans

VOCABULARY_FILE = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How byte-pair vocabularies of this kind divide text before merging (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_VOCABULARY_BYTES = 16 << 20
END_HASH = np.uint64(0x5DEECE66D1234567)
LONGEST = 256
#: Rounds of training by their step widths, ids that one sees at least (if there are so many), and ids for a task.
ROUNDS = (0.02, 0.015, 0.008)
LEAST_IDS, TASK_IDS = 3_000_000, 600_000
#: Chance that a word is drawn from those before it in its text; words that the share of new words counts for.
REPEAT, FEW = 0.07, 5
#: Words scored at a time; numbers in a block of a table, and tables that one task adds up.
SLICE, BLOCK, FAN = 80_000, 1 << 16, 64
_ODD_SPACE = re.compile(r"[^\S ]")

_subwords: dict[int, Subwords] = {}


class Subwords:
    """Subword ids of words, each with the space before it."""

    def __init__(self, ranks: bytes):
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("subwords", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.end = max(table.values()) + 1
        self.size = self.end + 1
        self.bytes_of = np.zeros(self.size, np.int64)
        self.begins = np.zeros(self.size, bool)
        self.begins[self.end] = True
        for token, i in table.items():
            self.bytes_of[i] = len(token)
            self.begins[i] = token.startswith(b" ")

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, and how many each has. The empty word stands for the end."""
        texts = [w.decode("utf-8", "replace") for w in words]
        odd = any(_ODD_SPACE.search(t) for t in ("".join(texts),))
        alone = [i for i, t in enumerate(texts) if not t or len(t) > LONGEST or (odd and _ODD_SPACE.search(t))]
        count = np.zeros(len(words), np.int64)
        own = {}
        for i in alone:
            pieces = [texts[i][k : k + LONGEST] for k in range(0, len(texts[i]), LONGEST)]
            own[i] = [x for k, p in enumerate(pieces) for x in self.encoding.encode_ordinary(p if k else " " + p)] or [self.end]
            count[i] = len(own[i])
        rest = np.setdiff1d(np.arange(len(words)), alone)
        spaced = [" " + texts[i] for i in rest.tolist()]
        ids = np.array(self.encoding.encode_ordinary("".join(spaced)), np.int32)
        ends = np.cumsum([len(s.encode("utf-8")) for s in spaced])
        if len(rest):
            count[rest] = np.bincount(np.searchsorted(ends, np.cumsum(self.bytes_of[ids]) - self.bytes_of[ids], "right"), minlength=len(rest))
        out, begin = np.empty(int(count.sum()), np.int32), np.cumsum(count) - count
        out[ragged(begin[rest], count[rest])] = ids
        for i, x in own.items():
            out[begin[i] : begin[i] + len(x)] = x
        return out, count


def subwords(ranks: bytes) -> Subwords:
    """One for each vocabulary and process."""
    if hash(ranks) not in _subwords:
        _subwords[hash(ranks)] = Subwords(ranks)
    return _subwords[hash(ranks)]


class Words:
    """The words of texts, each text followed by the end: distinct ones by hash, the place of each word in those, and words of each text."""

    def __init__(self, raws: list[bytes]):
        h, first, last, self._joined = word_spans(raws)
        n = np.diff(np.searchsorted(first, np.cumsum([0, *(len(r) + 1 for r in raws)])))
        after = np.cumsum(n)
        self.counts = n + 1
        self.hashes, some, self.place = distinct(np.insert(h, after, END_HASH))
        self._first, self._last = (np.insert(x, after, 0)[some] for x in (first, last))

    def spelled(self) -> list[bytes]:
        """The distinct words."""
        return [self._joined[a:b] for a, b in zip(self._first.tolist(), self._last.tolist(), strict=True)]


def _blocks(part: int, keys: np.ndarray, values: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Numbers at some places of a table (sorted), by blocks of it."""
    block = keys // BLOCK
    cuts = np.flatnonzero(np.diff(block)) + 1
    return [(part, int(k[0]) // BLOCK, packed({"k": pa.array((k % BLOCK).astype(np.uint32)), "x": pa.array(x)})) for k, x in zip(np.split(keys, cuts), np.split(values, cuts), strict=True) if len(k)]


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the lists, one after the other, and where each begins, and the last ends."""
    lists = column.combine_chunks()
    return lists.values.to_numpy(), lists.offsets.to_numpy().astype(np.int64)


def _summed(rows: DataFrame, n: int, size: int) -> np.ndarray:
    """Sum of tables of `size` numbers, given in blocks (part, at, a) of n parts; FAN at a time, in an order of their own."""

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [unpacked(x) for x in pa.Table.from_batches(batches).sort_by("part").column("a")]
        keys, values = (np.concatenate([t.column(c).to_numpy() for t in tables]) for c in ("k", "x"))
        total = np.bincount(keys, weights=values)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([key[1].as_py()], pa.int32()), pa.array([key[0].as_py()], pa.int32()), pa.array([packed({"k": pa.array(at.astype(np.uint32)), "x": pa.array(total[at])})], pa.binary())], names=["part", "at", "a"])

    while n > 0:
        rows = rows.withColumn("to", F.floor(F.col("part") / FAN).cast("int")).groupBy("at", "to").applyInArrow(add, "part int, at int, a binary")
        n = 0 if n <= FAN else -(-n // FAN)
    got = rows.toArrow()  # a table of fixed size
    out = np.zeros(size, np.float32)
    for at, x in zip(got.column("at").to_pylist(), got.column("a"), strict=True):
        t = unpacked(x)
        out[at * BLOCK + t.column("k").to_numpy().astype(np.int64)] = t.column("x").to_numpy()
    return out


def in_round(n: int, part: int, k: int, share: float) -> np.ndarray:
    """Which of a part's n training documents round k sees: the k-th of as many equal shares as there are rounds, and those next to it up to `share`; all rounds together see each."""
    fine = 20
    every = len(ROUNDS) * fine
    j = np.arange(n) + part  # parts of few documents don't all begin with the same round
    at = (j % len(ROUNDS)) * fine + j // len(ROUNDS) % fine
    return (at - k * fine) % every < max(fine, math.ceil(share * every))


def _taught(docs: DataFrame, ranks, model: Attention, rate: float, n_tasks: int, k: int, share: float) -> Attention:
    """The model after round k: tasks train copies of it on their part of docs (part, a, b: words' ids and texts' words), which are averaged by what they saw."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # sized by the vocabulary

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, m = subwords(ranks.value), shared.value
        found = []
        for batch in batches:
            for part, a, b in zip(batch.column("part").to_pylist(), batch.column("a"), batch.column("b"), strict=True):
                texts = unpacked(b)
                place = texts.column("place").filter(pc.invert(texts.column("held_out"))).combine_chunks()
                place = place.filter(pa.array(in_round(len(place), part, k, share)))
                ids, begin = _lists(unpacked(a).column("ids"))
                own = place.flatten().to_numpy()
                found.append((part, ids[ragged(begin[own], begin[own + 1] - begin[own])].astype(np.int32)))
        joined = np.concatenate([np.array([s.end], np.int32), *(x for _, x in sorted(found, key=lambda x: x[0]))])
        weight = len(joined)
        joined = np.resize(joined, weight + (1 - weight) % WINDOW) if weight > 1 else joined  # whole windows
        new, met, steps = train(m, joined, rate=rate, seed=k)
        if steps:
            moved = (new.ids - m.ids) * met[:, None]
            flat = np.concatenate([[weight], flattened(new) * weight, met, moved.ravel()]).astype(np.float32)
            some = np.flatnonzero(flat)
            rows = _blocks(TaskContext.get().partitionId(), some, flat[some])
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["part", "at", "a"])

    n_layer, n_ids = len(flattened(model)), len(model.begins)
    total = _summed(docs.coalesce(n_tasks).mapInArrow(learn, "part int, at int, a binary"), n_tasks, 1 + n_layer + n_ids + model.ids.size)
    if not total[0]:
        return model
    met, moved = total[1 + n_layer : 1 + n_layer + n_ids], total[1 + n_layer + n_ids :].reshape(model.ids.shape)
    return averaged(model, total[1 : 1 + n_layer] / total[0], model.ids + moved / np.maximum(met, 1)[:, None])


def earlier(place: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word (its number, text after text): how often its text has it before, and how many words are before it there."""
    number = np.arange(len(place))
    begin = np.cumsum(texts) - texts
    width = len(place).bit_length()
    order = np.sort(((np.repeat(np.arange(len(texts)), texts) * (int(place.max(initial=0)) + 1) + place) << width) | number)
    at, word = order & ((1 << width) - 1), order >> width
    heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out = np.empty(len(place), np.int64)
    out[at] = number - np.repeat(heads, np.diff(np.append(heads, len(place))))
    return out, number - np.repeat(begin, texts)


def word_logs(model: Attention, after: np.ndarray, new: np.ndarray, end: int, ids: np.ndarray, sizes: np.ndarray, seen: np.ndarray, place: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Natural logs of the words' probabilities. after: log P(id | class, cell), new: by first id, the chance that a word is spelled. ids: of the words one after the other, sizes: how many each has, seen: its count, place: its number, texts: words of each text (the last is the end)."""
    first = np.cumsum(sizes) - sizes
    last = np.cumsum(texts) - 1
    lengths = np.diff(np.concatenate([[0], np.cumsum(sizes)[last]]))
    chosen, odds = model.logs(ids, lengths, end)
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.cumsum(lengths) - lengths] = end
    chosen += after[ids, cells(before, CELLS)]
    lead = chosen[first].astype(np.float64)
    inner = chosen - softplus(odds)
    inner[first] = 0
    spelled = np.add.reduceat(inner, first) - softplus(-odds[np.minimum(first + sizes, len(ids) - 1)])
    begins = ids[first]
    total, u = model.counts[begins], new[begins]
    with np.errstate(divide="ignore"):
        known = np.log((1 - u) * seen / np.maximum(total, 1))
    main = lead + np.where(total > 0, np.logaddexp(known, np.log(u) + spelled), spelled)
    main[last] = lead[last]
    again, at = earlier(place, texts)
    again[last] = 0
    with np.errstate(divide="ignore"):
        return np.where(at > 0, np.logaddexp(main + math.log(1 - REPEAT), np.log(REPEAT * again / np.maximum(at, 1))), main)


def score(docs: DataFrame, folds: int = 7, held: int = 2, vocabulary_file: str = VOCABULARY_FILE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    spark = docs.sparkSession
    with open(vocabulary_file, "rb") as f:
        vocabulary = f.read()
    if len(vocabulary) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is too large to broadcast")
    ranks, tokens = spark.sparkContext.broadcast(vocabulary), subwords(vocabulary)
    held_out = F.coalesce(fold("doc_id", folds) == held, F.lit(False))
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("raw"), held_out.alias("held_out"))
    n_parts = parts_for(docs)
    bits = max(1, (n_parts - 1).bit_length())
    parts = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "raw"), F.lit(n_parts)).cast("int"))

    def gather(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The part's distinct words with their training counts, cut by ranges of their hash; their ids, with the words of each text, sorted; and counts of ids and their neighbours in training texts."""
        t, part, s = pa.Table.from_batches(batches), key[0].as_py(), subwords(ranks.value)
        raws = as_bytes(t.column("raw"))
        order = sorted(range(len(raws)), key=raws.__getitem__)
        w, rest = Words([raws[i] for i in order]), t.select(["doc_id", "held_out"]).take(order)
        del t, raws
        trained = np.repeat(~rest.column("held_out").to_numpy(), w.counts)
        count = np.bincount(w.place, weights=trained, minlength=len(w.hashes)).astype(np.uint32)
        ids, n = s.encode(w.spelled())
        begin, place = np.cumsum(n) - n, w.place[trained]
        found, numbers, last = [], [], ids[:0]
        for a in range(0, len(place), 1 << 20):  # the last id before goes with each stretch
            own = place[a : a + (1 << 20)]
            flat = np.concatenate([last, ids[ragged(begin[own], n[own])]])
            near, last = neighbours(flat), flat[-1:]
            heads = np.flatnonzero(np.concatenate([[True], near[1:] != near[:-1]])) if len(near) else np.zeros(0, np.int64)
            found.append(near[heads])
            numbers.append(np.diff(np.append(heads, len(near))))
        near, _, at = distinct(np.concatenate([*found, np.zeros(0, np.int64)]))
        numbers = np.bincount(at, weights=np.concatenate([*numbers, np.zeros(0, np.int64)]), minlength=len(near))
        counted = np.bincount(ids, weights=np.repeat(count, n), minlength=s.size)
        used = np.flatnonzero(counted)
        bucket = (w.hashes >> np.uint64(64 - bits)).astype(np.int32)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        out = [("word", part, int(b), x.tobytes(), c.tobytes()) for b, x, c in zip(bucket[np.concatenate([[0], cuts]).astype(int)], np.split(w.hashes, cuts), np.split(np.stack([count, ids[begin].astype(np.uint32)], 1), cuts), strict=True)]
        values = np.concatenate([counted[used], numbers]).astype(np.uint32)
        out += [("table", p, at, x, None) for p, at, x in _blocks(part, np.concatenate([used, near + s.size]), values)]
        lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)), pa.int32()), pa.array(ids))
        texts = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *w.counts]), pa.int32()), pa.array(w.place.astype(np.uint32)))
        out.append(("docs", part, -1, packed({"ids": lists}), packed({"doc_id": rest.column("doc_id").combine_chunks(), "held_out": rest.column("held_out").combine_chunks(), "place": texts})))
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["kind", "part", "at", "a", "b"])

    gathered = checkpointed(parts.groupBy("part").applyInArrow(gather, "kind string, part int, at int, a binary, b binary"))

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts over all parts, back in each part's order, the sums with the first row; words that occur once by their first id."""
        t = pa.Table.from_batches(batches)
        hashes = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("a")]
        _, some, at = distinct(np.concatenate(hashes))
        given = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32).reshape(-1, 2) for x in t.column("b")])
        total = np.bincount(at, weights=given[:, 0], minlength=len(some)).astype(np.int64)
        back = np.split(total[at], np.cumsum([len(x) for x in hashes])[:-1])
        alone = np.bincount(given[some[total == 1], 1])
        used = np.flatnonzero(alone)
        out = [("count", p, a, x.tobytes(), 0, 0) for p, a, x in zip(t.column("part").to_pylist(), t.column("at").to_pylist(), back, strict=True)]
        out[0] = (*out[0][:4], int(total.sum()), int((total > 0).sum()))
        out += [("once", *x, 0, 0) for x in _blocks(key[0].as_py(), used, alone[used])]
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["kind", "part", "at", "a", "n", "v"])

    docs = gathered.where("kind = 'docs'")
    counted = checkpointed(gathered.where("kind = 'word'").groupBy("at").applyInArrow(add, "kind string, part int, at int, a binary, n long, v long"))
    n_train, n_distinct = (x or 0 for x in counted.agg(F.sum("n"), F.sum("v")).first())
    once = _summed(counted.where("kind = 'once'").select("part", "at", "a"), 1 << bits, tokens.size).astype(np.float64)
    tables = _summed(gathered.where("kind = 'table'").select("part", "at", "a"), n_parts, tokens.size * (1 + CELLS + NEIGHBOURS))
    counts, near = tables[: tokens.size].astype(np.float64), tables[tokens.size :].reshape(tokens.size, -1)
    new = np.clip((once + FEW * (once.sum() + 1) / (n_train + 2)) / (counts + FEW), 1e-6, 1 - 1e-6)
    model, n_ids = untrained(counts, near, tokens.begins, tokens.end), int(counts.sum())
    if n_ids:
        share = min(1.0, max(1 / len(ROUNDS), LEAST_IDS / n_ids))
        for k, rate in enumerate(ROUNDS):
            model = _taught(docs.select("part", "a", "b"), ranks, model, rate, max(1, round(n_ids * share / TASK_IDS)), k, share)
    shared = spark.sparkContext.broadcast((model, after_cells(near, counts, model.group()), new))  # sized by the vocabulary
    del tables, near

    def scored(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (m, after, new), s, t = shared.value, subwords(ranks.value), pa.Table.from_batches(batches)
        by_bucket = sorted(zip(t.column("at").to_pylist(), t.column("a"), t.column("b"), strict=True), key=lambda x: x[0])
        (_, a, b), *counts = by_bucket  # at -1
        ids, begin = _lists(unpacked(a).column("ids"))
        texts = unpacked(b)
        place, ends = _lists(texts.column("place"))
        size, count, n = np.diff(begin), np.concatenate([np.frombuffer(c.as_buffer(), np.int64) for _, c, _ in counts]), np.diff(ends)
        found = []
        for a, b in slices(n.tolist(), SLICE):
            own, texts_of = place[ends[a] : ends[b]].astype(np.int64), np.repeat(np.arange(b - a), n[a:b])
            seen, total = count[own], lambda x: np.bincount(texts_of, weights=x, minlength=b - a)  # noqa: B023
            of_words = word_logs(m, after, new, s.end, ids[ragged(begin[own], size[own])], size[own], seen, own, n[a:b])
            found.append((total(seen > 0), total(np.log10(seen + 1.0)), total(of_words) / math.log(10)))
        known, logs, score = map(np.concatenate, zip(*found, strict=True))
        yield from pa.table([texts.column("doc_id"), texts.column("held_out"), pa.array(n, pa.int64()), pa.array(known.astype(np.int64)), pa.array(logs), pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "logs", "score"]).to_batches()

    known = counted.where("kind = 'count'").select("part", "at", "a", F.lit(None).cast("binary").alias("b")).unionByName(docs.select("part", "at", "a", "b"))
    out = known.groupBy("part").applyInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double")
    base = F.col("logs") - F.col("n_tokens") * math.log10(n_train + n_distinct + 1)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op7(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
