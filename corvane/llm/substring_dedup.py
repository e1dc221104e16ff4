"""Removal of byte strings that an earlier document holds, found with suffix arrays.

Every string of WIDTH bytes has an anchor, the smallest hashed SEED-gram in it, so equal strings have equal anchors.
Documents are dealt into parts. A part posts its distinct anchors; those of more than one document send the bytes
around them, once for each distinct context of a part, to where all contexts of an anchor meet. There a suffix array,
by two-stage sorting, puts equal strings of WIDTH bytes side by side, adjacent common prefixes delimit them, and all
but those of the smallest doc_id are marked. The marks go back to the parts and are cut out of the bytes. Contexts of
one anchor count as equal if 64-bit hashes of their bytes are. An anchor with more than HOT distinct contexts (a line
that is everywhere, between ever new neighbours) would bring them all to one task; its strings of WIDTH bytes are sent
one by one instead, each to where its own hash says. The result is the same either way.

Null texts count as empty; texts shorter than WIDTH lose nothing. A null doc_id counts as larger than any other; rows
with equal doc_id are one document, and none of them is earlier. An empty table gives no rows. Extra columns are left
out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import packed, parts_for, ragged, slices, unpacked
from corvane.llm.shingles import mix, powers
from corvane.llm.suffix import SuffixArray

WIDTH, SEED = 50, 20
#: Contexts of an anchor that may meet in one task.
HOT = 4096
LAST_ID = (1 << 63) - 1
#: Bytes of text, and of contexts, worked on at a time.
SLICE, CONTEXTS = 200_000, 500_000
_BYTE = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = 0x5851F42D4C957F2D


def anchors(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: anchors' text, place in it and hash, and begin and end of the strings of WIDTH bytes that have it as their anchor."""
    lengths = np.array([len(r) for r in raws], np.int64)
    begins = np.cumsum(lengths) - lengths
    buf = np.frombuffer(b"".join(raws), np.uint8)
    n = len(buf) - WIDTH + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, np.zeros(0, np.uint64), none, none
    grams, power, width = {1: _BYTE[buf]}, _STEP, 1
    while width < 16:
        x = grams[width]
        grams[2 * width] = x[:-width] * np.uint64(power) + x[width:]
        power, width = power * power % (1 << 64), 2 * width
    value = mix(grams[16][: len(buf) - SEED + 1] * np.uint64(pow(_STEP, 4, 1 << 64)) + grams[4][16 : 16 + len(buf) - SEED + 1])
    del grams
    # The place stands in the low half, so that of values with equal high halves the leftmost counts.
    half, width = np.uint64(32), 1
    least = (value >> half << half) | np.arange(len(value), dtype=np.uint64)
    span = WIDTH - SEED + 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[step:], least[:-step])
        width += step
    n_starts = np.maximum(lengths - WIDTH + 1, 0)
    start = ragged(begins, n_starts)
    if not len(start):
        return none, none, np.zeros(0, np.uint64), none, none
    at = least[start] & np.uint64((1 << 32) - 1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    at = at[first].astype(np.int64)
    of = np.searchsorted(begins + lengths, start[first], "right")
    return of, at - begins[of], value[at], start[first] - begins[of], start[last] + WIDTH - begins[of]


def range_hashes(raws: list[bytes], of: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes from begin to end of the texts `of`."""
    lengths = np.array([len(r) for r in raws], np.int64)
    begins = (np.cumsum(lengths) - lengths)[of] + begin
    buf = np.frombuffer(b"".join(raws), np.uint8)
    up, down = powers(1 << max(20, len(buf).bit_length()))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[buf] * up[: len(buf)], dtype=np.uint64)])
    return mix((total[begins + end - begin] - total[begins]) * down[begins] + (end - begin).astype(np.uint64))


def _documents(t: pa.Table) -> tuple[np.ndarray, list[bytes], list[int | None]]:
    """A part's ids (null last), texts and ids as given, in a fixed order."""
    rows = sorted(((LAST_ID if i is None else i, r or b"", i) for i, r in zip(t.column("doc_id").to_pylist(), t.column("raw").to_pylist(), strict=True)), key=lambda x: x[:2])
    return np.array([x[0] for x in rows], np.int64), [x[1] for x in rows], [x[2] for x in rows]


def _posted(raws: list[bytes], whole: bool = False) -> tuple[np.ndarray, ...]:
    """All anchors of a part, sorted by hash, row and place: hash, row, place, begin, end; is it the first with its hash; if whole, a hash of all bytes from begin to end."""
    none = np.zeros(0, np.int64)
    found = [[none, none, np.zeros(0, np.uint64), none, none, np.zeros(0, np.uint64)]]
    for a, b in slices([len(r) for r in raws], SLICE):
        of, at, value, begin, end = anchors(raws[a:b])
        hashed = range_hashes(raws[a:b], of, begin, end) if whole else value
        found.append([of + a, at, value, begin, end, hashed])
    of, at, value, begin, end, hashed = (np.concatenate([f[i] for f in found]) for i in range(6))
    value = mix(value)  # anchors are smallest hashes; ranges of these hold equal numbers of them
    order = np.argsort(value, kind="stable")  # texts and places ascend already
    value = value[order]
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    return value, of[order], at[order], begin[order], end[order], new, hashed[order]


def _same(value: np.ndarray, lead: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """A hash by which contexts of an anchor count as equal: of their bytes and the anchor's place in them."""
    return mix(hashed + mix(value + lead.astype(np.uint64)))


def _contexts_of(value: np.ndarray, heads: np.ndarray, same: np.ndarray) -> np.ndarray:
    """How many distinct contexts each anchor of a part has; the anchors are sorted, `heads` are the first of each."""
    n = np.diff(heads, append=len(value))
    out = np.ones(len(heads), np.int64)
    several = np.flatnonzero(np.repeat(n > 1, n))
    if len(several):
        group, key = np.repeat(np.arange(len(heads)), n)[several], same[several]
        order = np.lexsort((key, group))
        group, key = group[order], key[order]
        new = np.ones(len(group), bool)
        new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        out = np.maximum(out, np.bincount(group[new], minlength=len(heads)))
    return out


def _strings(raws: list[bytes], of: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All strings of WIDTH bytes from begin to end of the texts `of`, by text: their text, place and hash."""
    order = np.argsort(of, kind="stable")
    of, begin, n = of[order], begin[order], (end - begin)[order] - WIDTH + 1
    at, of = ragged(begin, n), np.repeat(of, n)
    value = np.zeros(len(of), np.uint64)
    for a, b in slices([len(r) for r in raws], SLICE):
        x, y = np.searchsorted(of, [a, b])
        if x < y:
            value[x:y] = range_hashes(raws[a:b], of[x:y] - a, at[x:y], at[x:y] + WIDTH)
    return of, at, value


def windows_of_earlier(strings: list[bytes], ids: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """For each string a mask: bit i is set if its `width` bytes from i also stand in a string with a smaller id."""
    sa = SuffixArray(strings)
    new = ~sa.alike(width)
    own = ids[sa.owner[sa.order]]
    heads = np.flatnonzero(new)
    least = np.minimum.reduceat(own, heads)
    at = sa.order[own > np.repeat(least, np.diff(heads, append=len(own)))]
    begin = np.concatenate([[0], sa.ends[:-1] + 1])
    masks = np.zeros(len(strings), np.int64)
    np.bitwise_or.at(masks, sa.owner[at], np.int64(1) << (at - begin[sa.owner[at]]))
    return masks


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes) and spans (of removed bytes). Anchors of more than `hot` contexts are split; the result doesn't depend on it."""
    n_parts = parts_for(docs)
    bits = max(1, (n_parts - 1).bit_length())
    bucket_of = lambda v: (v >> np.uint64(64 - bits)).astype(np.int32)
    parts = docs.select("doc_id", F.col("text").cast("binary").alias("raw")).withColumn("part", F.pmod(F.xxhash64("doc_id", "raw"), F.lit(n_parts)).cast("int"))

    def post(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, raws, _ = _documents(pa.Table.from_batches(batches))
        value, of, at, begin, _, new, hashed = _posted(raws, whole=True)
        if not len(value):
            return
        heads = np.flatnonzero(new)
        many = np.maximum.reduceat(ids[of], heads) > np.minimum.reduceat(ids[of], heads)
        n_contexts = np.minimum(_contexts_of(value, heads, _same(value, at - begin, hashed)), 0x7FFF)
        many = (2 * n_contexts + many).astype(np.uint16)
        value = value[heads]
        cuts = np.flatnonzero(np.diff(bucket_of(value))) + 1
        columns = [[int(bucket_of(v[:1])[0]) for v in np.split(value, cuts)], [v.tobytes() for v in np.split(value, cuts)], [m.tobytes() for m in np.split(many, cuts)]]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(columns[0]), pa.int32()), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], names=["part", "bucket", "hashes", "many"])

    posts = parts.groupBy("part").applyInArrow(post, "part int, bucket int, hashes binary, many binary")

    def share(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, hashes, many = [], [], []
        for batch in batches:
            part += batch.column("part").to_pylist()
            hashes += [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("hashes")]
            many += [np.frombuffer(x.as_buffer(), np.uint16) for x in batch.column("many")]
        flat = np.concatenate(hashes)
        order = np.argsort(flat, kind="stable")
        new = np.concatenate([[True], np.diff(flat[order]) != 0])
        group = np.cumsum(new) - 1
        codes = np.concatenate(many)[order]
        shared = (np.bincount(group) > 1) | (np.bincount(group, weights=codes & 1) > 0)
        split = shared & (np.bincount(group, weights=codes >> 1) > hot)
        flags = np.empty((2, len(flat)), bool)
        flags[:, order] = np.stack([shared, split])[:, group]
        for p, f in zip(part, np.split(flags, np.cumsum([len(h) for h in hashes])[:-1], axis=1), strict=True):
            yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "bucket": pa.array([key[0].as_py()], pa.int32()), "flags": pa.array([np.packbits(f[0]).tobytes()], pa.binary()), "split": pa.array([np.packbits(f[1]).tobytes()], pa.binary()), "n": pa.array([f.shape[1]], pa.int32())})

    flags = posts.groupBy("bucket").applyInArrow(share, "part int, bucket int, flags binary, split binary, n int")

    def contexts(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        ids, raws, _ = _documents(left)
        value, of, at, begin, end, new, hashed = _posted(raws, whole=True)
        by_bucket = sorted(right.select(["bucket", "flags", "split", "n"]).to_pylist(), key=lambda r: r["bucket"])
        shared, split = (np.concatenate([np.zeros(0, bool), *[np.unpackbits(np.frombuffer(r[c], np.uint8), count=r["n"]).astype(bool) for r in by_bucket]]) for c in ("flags", "split"))
        anchor = np.cumsum(new) - 1
        keep, cut_up = (np.flatnonzero(x[anchor]) for x in (shared & ~split, split))
        lead = at - begin
        same = _same(value[keep], lead[keep], hashed[keep])
        string_of, string_at, string = _strings(raws, of[cut_up], begin[cut_up], end[cut_up])
        # what is sent: contexts by their anchors, then strings of split anchors by their own hashes
        value, same, of = np.append(value[keep], string), np.append(same, string), np.append(of[keep], string_of)
        lead = np.append(lead[keep], np.zeros_like(string_at))
        begin, end = np.append(begin[keep], string_at), np.append(end[keep], string_at + WIDTH)
        to = bucket_of(mix(value))
        by = np.lexsort((same, to))  # stable: of one context the smallest id comes first
        value, same, of, lead, begin, end, to = (x[by] for x in (value, same, of, lead, begin, end, to))
        head = np.ones(len(to), bool)
        head[1:] = (same[1:] != same[:-1]) | (value[1:] != value[:-1])
        rows: list[tuple[int, bytes]] = []
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1, [len(to)]]) if len(to) else np.zeros(1, np.int64)
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            starts = np.flatnonzero(head[x:y])
            first, n = x + starts, np.diff(starts, append=y - x)
            own = np.add.reduceat(ids[of[x:y]] == np.repeat(ids[of[first]], n), starts, dtype=np.int32)
            columns = {
                "hash": pa.array(value[first]), "lead": pa.array(lead[first].astype(np.uint8)), "context": pa.array([raws[o][i:j] for o, i, j in zip(of[first].tolist(), begin[first].tolist(), end[first].tolist(), strict=True)], pa.binary()),
                "doc_id": pa.array(ids[of[first]]), "own": pa.array(own), "places": pa.ListArray.from_arrays(pa.array(2 * np.append(starts, y - x), pa.int32()), pa.array(np.stack([of[x:y], begin[x:y]], 1).ravel(), pa.int32())),
            }
            rows.append((int(to[x]), packed(columns)))
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([key[0].as_py()] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "part", "rows"])

    sent = parts.groupBy("part").cogroup(flags.groupBy("part")).applyInArrow(contexts, "bucket int, part int, rows binary")

    def resolve(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [(p.as_py(), unpacked(r)) for batch in batches for p, r in zip(batch.column("part"), batch.column("rows"), strict=True)]
        t = pa.concat_tables([x for _, x in tables])
        hashes, ids, context = t.column("hash").to_numpy(), t.column("doc_id").to_numpy(), t.column("context").to_pylist()
        same = np.fromiter(map(hash, zip(t.column("lead").to_pylist(), context, strict=True)), np.int64, len(ids))
        order = np.lexsort((ids, same, hashes))
        head = np.ones(len(order), bool)  # of its context the smallest id
        head[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (same[order[1:]] != same[order[:-1]])
        group = np.cumsum(head) - 1
        first = order[head]
        full = (np.int64(1) << (pc.binary_length(t.column("context")).to_numpy() - WIDTH + 1).astype(np.int64)) - 1
        # contexts that are alone with their hash have no other string in common with a smaller id
        h = hashes[first]
        several = np.zeros(len(first), bool)
        several[1:] |= h[1:] == h[:-1]
        several[:-1] |= h[1:] == h[:-1]
        some = first[several]
        found = np.zeros(len(first), np.int64)
        at = np.flatnonzero(several)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(hashes[some])) + 1, [len(some)]]) if len(some) else np.zeros(1, np.int64)
        sizes = np.add.reduceat(np.fromiter((len(context[i]) for i in some), np.int64, len(some)), cuts[:-1]) if len(some) else np.zeros(0, np.int64)
        for a, b in slices(sizes.tolist(), CONTEXTS):
            rows = some[cuts[a] : cuts[b]]
            found[at[cuts[a] : cuts[b]]] = windows_of_earlier([context[i] for i in rows], ids[rows])
        masks = np.zeros(len(ids), np.int64)
        masks[order] = np.where(ids[order] > ids[first][group], full[order], found[group])
        ends = np.cumsum([len(x) for _, x in tables])
        out = []
        for (_, x), end in zip(tables, ends.tolist(), strict=True):
            own = slice(end - len(x), end)
            x = x.select(["own", "places"]).append_column("mask", pa.array(masks[own])).append_column("full", pa.array(full[own]))
            n_places = x.column("places").combine_chunks().value_lengths().to_numpy() // 2
            x = x.filter(pa.array((masks[own] != 0) | (n_places > x.column("own").to_numpy())))
            out.append(packed({c: x.column(c).combine_chunks() for c in x.column_names}))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in tables], pa.int32()), pa.array(out, pa.binary())], names=["part", "rows"])

    marks = sent.groupBy("bucket").applyInArrow(resolve, "part int, rows binary")

    def cut(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        _, raws, given = _documents(left)
        marked = pa.concat_tables([unpacked(x) for x in right.column("rows")]) if right.num_rows else pa.table({"own": pa.array([], pa.int32()), "places": pa.array([], pa.list_(pa.int32())), "mask": pa.array([], pa.int64()), "full": pa.array([], pa.int64())})
        places = marked.column("places").combine_chunks()
        n = places.value_lengths().to_numpy() // 2
        flat = places.flatten().to_numpy().reshape(-1, 2)
        within = ragged(np.zeros(len(n), np.int64), n)
        mask = np.where(within < np.repeat(marked.column("own").to_numpy(), n), np.repeat(marked.column("mask").to_numpy(), n), np.repeat(marked.column("full").to_numpy(), n))
        order = np.argsort(flat[:, 0], kind="stable")
        flat, mask = flat[order].astype(np.int64), mask[order]
        out: dict[str, list] = {c: [] for c in ("n_removed", "n_spans", "kept", "spans")}
        for a, b in slices([len(r) for r in raws], SLICE):
            lengths = np.array([len(r) for r in raws[a:b]], np.int64)
            begins = np.cumsum(lengths) - lengths
            x, y = np.searchsorted(flat[:, 0], [a, b])
            base = begins[flat[x:y, 0] - a] + flat[x:y, 1]
            size = int(lengths.sum())
            begun = np.zeros(size + WIDTH, bool)  # where a string to be removed begins
            for bit in range(WIDTH - SEED + 1):
                begun[base[(mask[x:y] >> bit) & 1 == 1] + bit] = True
            until = np.cumsum(begun, dtype=np.int32)
            gone = until[:size] > np.concatenate([np.zeros(WIDTH, np.int32), until[: max(0, size - WIDTH)]])[:size]
            buf = np.frombuffer(b"".join(raws[a:b]), np.uint8)
            for raw, begin, length in zip(raws[a:b], begins, lengths, strict=True):
                own = gone[begin : begin + length]
                if not own.any():
                    out["n_removed"].append(0), out["n_spans"].append(0), out["kept"].append(raw), out["spans"].append([])
                    continue
                fenced = np.concatenate([[False], own, [False]])
                edges = np.flatnonzero(fenced[1:] != fenced[:-1]).reshape(-1, 2)
                out["n_removed"].append(int(own.sum())), out["n_spans"].append(len(edges)), out["kept"].append(buf[begin : begin + length][~own].tobytes())
                out["spans"].append([{"start": s, "end": e} for s, e in edges.tolist()])
        columns = [pa.array(given, pa.int64()), pa.array([len(r) for r in raws], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in out["kept"]], pa.string()), pa.array(out["kept"], pa.binary())]
        return pa.table([*columns, pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])

    return parts.groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:int,end:int>>")


def op3(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
