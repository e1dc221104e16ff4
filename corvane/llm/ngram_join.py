"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Documents with equal shingle sets form a class, stood for by its smallest doc_id. Each class sorts its shingles rarest
first (by a bounded table of hashed document frequencies over all documents) and posts a prefix that any partner must
share. Classes meet on prefix n-grams; n-grams with the same smallest class travel together (and with those of that
class's own smallest one), so that near copies, which share most of their prefixes, are sent once and not once for each
n-gram. Where they meet, an index of prefix n-grams with their positions gives the candidates, which the length and the
positional filter thin out; then the suffix filter, halving ranges of hashes, on sketches; and what is left is verified on
whole sets, in the group of the pair's first common prefix n-gram and nowhere else, unless both are joined by then.

A group of over BLOCK members is cut into blocks: members meet those of their block and a few pivots that visit all
blocks. Members that their block doesn't join to the pivot that most are joined to then visit all other blocks. So k
near copies take about k rows, never all pairs of them or of their blocks. Joined pairs leave as a spanning forest.

Rows with equal doc_id count as one document. Null and empty texts, and texts of white space, have no shingle and link
with nothing. Null ids form no links. An empty table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import as_bytes, checkpointed, ragged, slices
from corvane.llm.components import components
from corvane.llm.shingles import mix, shingle_sets

#: Cells of the table of document frequencies; a fixed size, whatever the input.
CELLS = 1 << 20
CELL_BLOCK = 1 << 14
#: Members of a group that meet in one task, about; of a larger group, how many visit all blocks.
BLOCK, PIVOTS = 512, 8
#: Large groups that are broadcast, at most; beyond, they are shuffled. Ways that rows of one key are dealt in joins.
MOST_LARGE, SALTS = 1_000_000, 16
FREQUENCY_BITS = 26
#: Bits of the map of documents that are sent to a group.
BITMAP = 1 << 23
#: Bytes of text hashed at a time.
SLICE = 1_000_000
#: Candidate pairs looked at together.
PAIRS = 20_000


def _frequencies(raw: DataFrame, n: int) -> np.ndarray:
    """Documents by cell of hashed shingles, over all documents."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            raws = as_bytes(batch.column("raw"))
            for a, b in slices([len(r) for r in raws], SLICE):
                h, _ = shingle_sets(raws[a:b], n)
                total += np.bincount((h & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        blocks = total.reshape(-1, CELL_BLOCK).astype(np.uint32)
        used = np.flatnonzero(blocks.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([blocks[i].tobytes() for i in used], pa.binary())], names=["block", "counts"])

    def added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELL_BLOCK, np.uint64)
        for batch in batches:
            for x in batch.column("counts"):
                total += np.frombuffer(x.as_buffer(), np.uint32)
        yield pa.RecordBatch.from_pydict({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary())})

    got = raw.mapInArrow(counted, "block int, counts binary").groupBy("block").applyInArrow(added, "block int, counts binary").toArrow()
    table = np.zeros((CELLS // CELL_BLOCK, CELL_BLOCK), np.uint32)
    for i, x in zip(got.column("block").to_pylist(), got.column("counts"), strict=True):
        table[i] = np.frombuffer(x.as_buffer(), np.uint32)
    return table.ravel()


def _rare_first(h: np.ndarray, sizes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Each set's shingles by (frequency, hash); they come by hash. Frequencies of 2**FREQUENCY_BITS - 1 and more count as equal."""
    n = np.minimum(table[(h & np.uint64(CELLS - 1)).astype(np.int64)], (1 << FREQUENCY_BITS) - 1).astype(np.uint64)
    own = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    width = len(h).bit_length()
    if width + FREQUENCY_BITS + len(sizes).bit_length() > 64:
        return h[np.lexsort((h, n, own))]
    key = (((own << np.uint64(FREQUENCY_BITS)) | n) << np.uint64(width)) | np.arange(len(h), dtype=np.uint64)
    key.sort()
    return h[(key & np.uint64((1 << width) - 1)).astype(np.int64)]


def _signatures(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums that tell sets apart, whatever the order of their members."""
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(salt)), dtype=np.uint64)])
        ends = np.cumsum(sizes)
        out.append((total[ends] - total[ends - sizes]).view(np.int64))
    return out[0], out[1]


def _listed(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.view(np.int64)))


def least_overlap(x: int, y: int, percent: int) -> int:
    """Fewest common shingles of sets of x and y with a Jaccard similarity of percent or more."""
    return -(-percent * (x + y) // (100 + percent))


def _sketch(h: np.ndarray) -> bytes:
    """Members by range of hash: about half as many ranges as members, counts up to 255."""
    bits = max(6, (len(h) - 1).bit_length() - 1)
    return np.minimum(np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


class Group:
    """Classes that meet: their ids, sizes and roles, and the prefix n-grams of this group, with their positions in the rare-first order."""

    def __init__(self, rep: np.ndarray, size: np.ndarray, guest: np.ndarray, visits: np.ndarray, few: np.ndarray, again: bool, grams: list[np.ndarray], places: list[np.ndarray], percent: int):
        self.rep, self.size, self.guest, self.visits, self.few, self.again, self.percent = rep, size, guest, visits, few, again, percent
        self.rank = np.empty(len(rep), np.int64)
        self.rank[np.lexsort((rep, size))] = np.arange(len(rep))  # small sets first
        member = np.repeat(np.arange(len(rep)), [len(g) for g in grams])
        h, place = np.concatenate(grams), np.concatenate(places)
        by = np.lexsort((self.rank[member], h))
        self.member, self.place, h = member[by], place[by], h[by]
        run = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        self.start = np.repeat(run, np.diff(np.append(run, len(h))))

    def candidates(self) -> Iterator[tuple[np.ndarray, ...]]:
        """Pairs x, y that share a prefix n-gram within the length and positional filters, x the smaller set, and the places of their first shared one in x and in y; about PAIRS at a time, by the rank of y."""
        entry = np.argsort(self.rank[self.member], kind="stable")
        n = entry - self.start[entry]
        entry, n = entry[n > 0], n[n > 0]
        for a, b in slices(n.tolist(), PAIRS):
            at, count = entry[a:b], n[a:b]
            some = ragged(self.start[at], count)
            x, y, i, j = self.member[some], np.repeat(self.member[at], count), self.place[some], np.repeat(self.place[at], count)
            sx, sy = self.size[x], self.size[y]
            ok = (100 * sx >= self.percent * sy) & (np.minimum(sx - i, sy - j) >= -(-self.percent * (sx + sy) // (100 + self.percent)))
            # guests meet in the band before; here only to be joined to pivots
            ok &= ~(self.guest[x] & self.guest[y]) | ((self.visits[x] | self.visits[y]) & (not self.again))
            x, y, i, j = x[ok], y[ok], i[ok], j[ok]
            if self.again or self.visits.any():
                vx, vy = self.visits[x], self.visits[y]
                resident, visitor = np.where(vx, y, x), np.where(vx, x, y)
                ok = np.where(vx | vy, ~(vx & vy) & ~(self.few[resident] & (self.rep[resident] < self.rep[visitor])), not self.again)
                x, y, i, j = x[ok], y[ok], i[ok], j[ok]
            if len(x):
                first = np.lexsort((j, x, self.rank[y]))
                x, y = x[first], y[first]
                new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
                yield x[new], y[new], i[first][new], j[first][new]


def _survivors(group: Group, sketches: list[bytes]) -> np.ndarray:
    """Which members have a candidate within the suffix filter: sets of x and y members whose counts by range differ by d in all have (x + y - d) / 2 in common at most. Ranges are halved until the pair is out or they are as fine as the sketches."""
    width = min(map(len, sketches), default=1)
    levels = [np.array([np.frombuffer(s, np.uint8).reshape(width, -1).sum(1) for s in sketches], np.int32)]
    while levels[0].shape[1] > 8:
        levels.insert(0, levels[0].reshape(len(sketches), -1, 2).sum(2))
    keep = np.zeros(len(sketches), bool)
    for x, y, _, _ in group.candidates():
        new = ~keep[x] | ~keep[y]
        x, y = x[new], y[new]
        total = group.size[x] + group.size[y]
        least = -(-group.percent * total // (100 + group.percent))
        for table in levels:
            ok = (total - np.abs(table[x] - table[y]).sum(1)) // 2 >= least
            x, y, total, least = x[ok], y[ok], total[ok], least[ok]
            if not len(x):
                break
        keep[x] = keep[y] = True
    return keep


def _joined(group: Group, sets: list[np.ndarray]) -> tuple[list[tuple[int, int]], list[int]]:
    """Linked pairs that join members not joined before, and a root for each member. sets: whole, rare-first. A pair whose first common prefix n-gram is another group's is left to that."""
    parent = list(range(len(sets)))
    whole = [np.sort(s) for s in sets]
    out = []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for pairs in group.candidates():
        for x, y, i, j in zip(*(v.tolist() for v in pairs), strict=True):
            a, b = find(x), find(y)
            if a == b or np.isin(sets[x][:i], sets[y][:j], assume_unique=True).any():
                continue
            large = whole[y]
            at = np.minimum(np.searchsorted(large, whole[x]), len(large) - 1)
            if int((large[at] == whole[x]).sum()) >= least_overlap(len(large), len(whole[x]), group.percent):
                parent[max(a, b)] = min(a, b)
                out.append((x, y))
    return out, [find(i) for i in range(len(sets))]


def ngram_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    spark = docs.sparkSession
    raw = docs.select("doc_id", F.col("text").cast("binary").alias("raw"))
    table = spark.sparkContext.broadcast(_frequencies(raw.select("raw"), n))  # CELLS numbers

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = as_bytes(batch.column("raw"))
            for a, b in slices([len(r) for r in raws], SLICE):
                h, sizes = shingle_sets(raws[a:b], n)
                s1, s2 = _signatures(h, sizes)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], pa.array(sizes), pa.array(s1), pa.array(s2)], names=["doc_id", "n_shingles", "s1", "s2"])

    def prefixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = as_bytes(batch.column("raw"))
            for a, b in slices([len(r) for r in raws], SLICE):
                h, sizes = shingle_sets(raws[a:b], n)
                s1, s2 = _signatures(h, sizes)
                h = _rare_first(h, sizes, table.value)
                long = np.where(sizes > 0, sizes - -(-percent * sizes // 100) + 1, 0)
                place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], pa.array(sizes), pa.array(s1), pa.array(s2), _listed(h[place < np.repeat(long, sizes)], long)], names=["doc_id", "n_shingles", "s1", "s2", "prefix"])

    rows = checkpointed(raw.mapInArrow(summed, "doc_id long, n_shingles long, s1 long, s2 long"))
    posted = raw.where("doc_id is not null").mapInArrow(prefixed, "doc_id long, n_shingles long, s1 long, s2 long, prefix array<long>")
    classes = checkpointed(rows.where("doc_id is not null and n_shingles > 0").groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    prefixes = posted.where("n_shingles > 0").groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min_by("prefix", "doc_id").alias("prefix"))
    entries = prefixes.select("rep", F.posexplode("prefix").alias("place", "h"))
    named = entries.groupBy("h").agg(F.min("rep").alias("label"), F.count("*").alias("n")).where("n > 1").select("h", "label")
    # an n-gram may be in many prefixes; the row that names it is one, and adaptive execution splits such keys
    shared = checkpointed(entries.join(named, "h").groupBy("label", "rep").agg(F.collect_list("place").alias("places")))  # places of one prefix
    moved = shared.groupBy(F.col("rep").alias("label")).agg(F.min("label").alias("to")).where("to < label")
    moved = moved.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    merged = shared.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).join(moved, ["label", "salt"], "left")
    merged = merged.groupBy(F.coalesce("to", "label").alias("label"), "rep").agg(F.flatten(F.collect_list("places")).alias("places"))
    # Two classes within the length filter share a band or have neighbouring ones; a class goes to its own, and to the
    # next as a guest. Guests are not compared with each other there.
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(-math.log(percent / 100) * (1 + 1e-9))).cast("int")
    sent = checkpointed(merged.join(classes, "rep").select("label", "rep", "s1", "s2", "places", F.posexplode(F.array(band, band + 1)).alias("guest", "band")))
    crowd = sent.groupBy("label", "band").agg(F.count("*").alias("n"), F.min("guest").alias("first"))
    large = checkpointed(crowd.where(F.col("n") > BLOCK).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")))
    n_large = large.count()
    hot = sent.join(F.broadcast(large) if n_large <= MOST_LARGE else large, ["label", "band"], "left")
    small = hot.where("n is null").join(crowd.where((F.col("n") <= BLOCK) & (F.col("n") > 1) & (F.col("first") == 0)).select("label", "band"), ["label", "band"], "left_semi")
    flag = lambda x: F.lit(x)
    place = lambda block, visits, few: F.struct("label", "band", block.cast("int").alias("block"), visits.alias("visits"), few.alias("few"), (F.col("guest") == 1).alias("guest"), "places").alias("to")
    placed = small.select("rep", "s1", "s2", place(F.lit(0), flag(False), flag(False)))
    crowded = None
    if n_large:
        own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
        pivot = F.pmod(F.xxhash64(F.lit("pivot"), "rep"), F.lit(1 << 30)) < F.lit(PIVOTS << 30) / F.col("n")
        crowded = hot.where("first = 0").withColumn("own", own).withColumn("pivot", pivot)
        visits = crowded.where("pivot").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("block <> own")
        placed = placed.unionByName(crowded.select("rep", "s1", "s2", place(F.col("own"), flag(False), F.col("pivot")))).unionByName(visits.select("rep", "s1", "s2", place(F.col("block"), flag(True), flag(True))))
    listed = raw.where("doc_id is not null").select(F.col("doc_id").alias("rep"), "raw")

    def texts_of(some: DataFrame) -> DataFrame:
        """some (rep, ...) with the texts; a bitmap of fixed size keeps most other documents out of the shuffle."""
        cell = lambda c: F.pmod(F.xxhash64(c), F.lit(BITMAP)).cast("long")
        marks = np.zeros((BITMAP // 32768, 4096), np.uint8)
        for r in some.select((cell("rep") + 1).alias("x")).groupBy(F.bitmap_bucket_number("x").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits")).collect():
            marks[r["k"] - 1] = np.frombuffer(r["bits"], np.uint8)
        bitmap = spark.sparkContext.broadcast(marks.ravel())

        def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column("cell").to_numpy()
                yield batch.filter(pa.array((bitmap.value[at >> 3] >> (at & 7)) & 1 == 1)).select(["rep", "raw"])

        return some.join(listed.withColumn("cell", cell("rep")).mapInArrow(marked, "rep long, raw binary"), "rep")

    role = "label:long,band:int,block:int,visits:boolean,few:boolean,guest:boolean"
    to, group = f"array<struct<{role},places:array<int>>>", ["label", "band", "block"]
    fields = f"{role.replace(':', ' ').replace(',', ', ')}, places array<int>"

    def sets_of(part: pa.RecordBatch, raws: list[bytes]) -> tuple[pa.RecordBatch, list[np.ndarray]]:
        """The rows whose text has the signature asked for (rows with equal ids may differ in text), and their sets, rare first."""
        h, sizes = shingle_sets(raws, n)
        s1, s2 = _signatures(h, sizes)
        same = (s1 == part.column("s1").to_numpy()) & (s2 == part.column("s2").to_numpy())
        h, sizes = h[np.repeat(same, sizes)], sizes[same]
        return part.filter(pa.array(same)), np.split(_rare_first(h, sizes, table.value), np.cumsum(sizes)[:-1]) if len(sizes) else []

    def with_(columns, names: list[str]):
        """Rows (rep, s1, s2, to) with what `columns` makes of their sets instead of the text."""

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raws = as_bytes(batch.column("raw"))
                for a, b in slices([len(r) for r in raws], SLICE):
                    part, sets = sets_of(batch.slice(a, b - a), raws[a:b])
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("rep", "s1", "s2", "to")), *columns(sets, part)], names=["rep", "s1", "s2", "to", *names])

        return made

    def sketches(sets: list[np.ndarray], part: pa.RecordBatch) -> list[pa.Array]:
        prefix = [s[: len(s) - -(-percent * len(s) // 100) + 1] for s in sets]
        return [pa.array([len(s) for s in sets], pa.int64()), pa.array([_sketch(s) for s in sets], pa.binary()), _listed(np.concatenate([*prefix, np.zeros(0, np.uint64)]), np.array([len(p) for p in prefix], np.int64))]

    def members(sets: list[np.ndarray], part: pa.RecordBatch) -> list[pa.Array]:
        return [_listed(np.concatenate([*sets, np.zeros(0, np.uint64)]), np.array([len(s) for s in sets], np.int64))]

    def arrays(t: pa.Table, column: str, kind: type) -> list[np.ndarray]:
        lists = t.column(column).combine_chunks()
        flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
        return [flat[a:b].view(kind) for a, b in zip(at[:-1], at[1:], strict=True)]

    def group_of(t: pa.Table, size: np.ndarray, grams: list[np.ndarray], again: bool) -> Group:
        rep, guest, visits, few = (t.column(c).to_numpy() for c in ("rep", "guest", "visits", "few"))
        return Group(rep, size, guest, visits, few, again, grams, arrays(t, "places", np.int32), percent)

    def linked(placed: DataFrame, again: bool) -> DataFrame:
        """Links (a, b) that join what meets. again: residents have met each other before."""
        placed = checkpointed(placed.groupBy("rep", "s1", "s2").agg(F.collect_list("to").alias("to")))  # as many as a set has prefix shingles, at most, and blocks of those that visit
        sketched = texts_of(placed).select("rep", "s1", "s2", "to", "raw").mapInArrow(with_(sketches, ["size", "sketch", "prefix"]), f"rep long, s1 long, s2 long, to {to}, size long, sketch binary, prefix array<long>")
        sketched = sketched.select("rep", "s1", "s2", "size", "sketch", "prefix", F.explode("to").alias("to")).withColumn("grams", F.transform("to.places", lambda p: F.get("prefix", p))).select("to.*", "grams", "rep", "s1", "s2", "size", "sketch")

        def screened(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(batches)
            keep = _survivors(group_of(t, t.column("size").to_numpy(), arrays(t, "grams", np.uint64), again), [x.as_py() for x in t.column("sketch")])
            yield from t.filter(pa.array(keep)).drop_columns(["size", "sketch", "grams"]).to_batches()

        left = sketched.groupBy(*group).applyInArrow(screened, f"{fields}, rep long, s1 long, s2 long")
        left = checkpointed(left.groupBy("rep", "s1", "s2").agg(F.collect_list(F.struct(*group, "visits", "few", "guest", "places")).alias("to")))
        sets = texts_of(left).select("rep", "s1", "s2", "to", "raw").mapInArrow(with_(members, ["members"]), f"rep long, s1 long, s2 long, to {to}, members array<long>")
        sets = sets.select("rep", "members", F.explode("to").alias("to")).select("to.*", "rep", "members")

        def verified(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(batches)
            whole, rep = arrays(t, "members", np.uint64), t.column("rep").to_numpy()
            grams = [s[p] for s, p in zip(whole, arrays(t, "places", np.int32), strict=True)]
            g = group_of(t, np.array([len(s) for s in whole], np.int64), grams, again)
            found, root = _joined(g, whole)
            out = [(int(rep[x]), int(rep[y]), None, None, None) for x, y in found]
            pivots = np.flatnonzero(g.few)
            if len(pivots) and not again:
                pivots = pivots[np.argsort(rep[pivots])].tolist()
                out += [(int(rep[k]), None, key[0].as_py(), key[1].as_py(), [int(rep[p]) for p in pivots if root[p] == root[k]]) for k in np.flatnonzero(~g.visits).tolist()]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=["a", "b", "label", "band", "pivots"])

        return sets.groupBy(*group).applyInArrow(verified, "a long, b long, label long, band int, pivots array<long>")

    links = linked(placed, False)
    if crowded is not None:
        links = checkpointed(links)
        held = links.where("label is not null").select("label", "band", F.col("a").alias("rep"), "pivots")
        most = held.select("label", "band", F.explode("pivots").alias("pivot")).groupBy("label", "band", "pivot").agg(F.count("*").alias("m")).groupBy("label", "band").agg(F.max_by("pivot", F.struct("m", "pivot")).alias("most"))
        held = held.join(F.broadcast(most) if n_large <= MOST_LARGE else most, ["label", "band"]).where(F.array_contains("pivots", F.col("most"))).select("rep", "label", "band", F.lit(True).alias("held"))
        met = checkpointed(crowded.join(held, ["rep", "label", "band"], "left").withColumn("apart", F.col("held").isNull()))
        away = met.where("apart").select("label", "band").distinct()
        if not away.isEmpty():
            visits = met.where("apart").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("block <> own")
            rest = met.join(F.broadcast(away) if n_large <= MOST_LARGE else away, ["label", "band"], "left_semi").select("rep", "s1", "s2", place(F.col("own"), flag(False), F.col("apart")))
            links = links.unionByName(linked(rest.unionByName(visits.select("rep", "s1", "s2", place(F.col("block"), flag(True), flag(True)))), True))
    links = links.where("b is not null").select("a", "b")
    found = components(links).withColumnRenamed("node", "rep")
    # classes of one document without links need no join; the others' rows are dealt by salt, as one class may have many
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    of_class = classes.join(found, "rep", "left").where("component is not null or copies > 1").select("s1", "s2", "n_shingles", F.coalesce("component", "rep").alias("component_id"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    full, none = rows.where("doc_id is not null and n_shingles > 0").withColumn("salt", salt), rows.where("doc_id is null or n_shingles = 0")
    out = full.join(of_class, ["s1", "s2", "n_shingles", "salt"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.unionByName(none.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op4(spark, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), n=4, percent=85)
