"""RET-02: a kept approximate vector index, an inverted file of cells with product-quantised residuals.

Vectors are dealt to the nearest of some centres; what is left of each after its centre is cut into sub-vectors, and each
of these is replaced by the number of its nearest codeword, so a vector takes a byte for every few dimensions. A search
scores the codes of a query's nearest cells by tables of inner products, and the best of these exactly. The index is a
folder: `model` (one row: centres, codewords, what calibration found) and `rows` (cell, chunk_id, code, embedding, by
shelves of cells), so that a search reads codes of the shelves it needs and embeddings of few rows.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.meeting import best_rows, meet
from corvane.operators.retrieval import QUERY_BLOCK, asked_vectors, matrix, top_ranked, unit, vector_top_k

#: Vectors that centres and codewords are fitted on, at most; all vectors are indexed.
SAMPLE = 20_000
#: Sampled vectors that calibration asks for, over the whole index.
TRIED = 64
#: Dimensions of a sub-vector, codewords for each, folders of cells, rows of a cell that one task takes.
SUB, WORDS, SHELVES, CELL_ROWS = 4, 256, 256, 1 << 16


@dataclass(frozen=True)
class Model:
    """Centres (cells, d), codewords (parts, words, SUB), rows of each cell; how many cells a query looks at, how many rows it scores exactly, and the recall this was measured to give."""

    dim: int
    centres: np.ndarray
    words: np.ndarray
    counts: np.ndarray
    probes: int = 1
    depth: int = 1
    recall: float = 0.0
    schema: str = ""

    def rows(self, spark: SparkSession, path: str) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{path}/rows")

    def padded(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors, with zeros up to whole sub-vectors."""
        return np.pad(unit(x), ((0, 0), (0, self.centres.shape[1] - self.dim)))

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-(x @ self.centres.T), axis=1, kind="stable")[:, :n]

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and code of each unit vector, some at a time: distances to all centres are held."""
        parts = [self._coded(x[a : a + 512]) for a in range(0, max(1, len(x)), 512)]
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))

    def _coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = (x @ self.centres.T).argmax(1)
        left = (x - self.centres[cell]).reshape(len(x), len(self.words), SUB)
        return cell, np.stack([_closest(left[:, j], w) for j, w in enumerate(self.words)], 1).astype(np.uint8)

    def tables(self, x: np.ndarray) -> np.ndarray:
        """Inner products of each vector's sub-vectors with all codewords."""
        return np.einsum("qjs,jws->qjw", x.reshape(len(x), len(self.words), SUB), self.words)

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, dim=self.dim, centres=self.centres, words=self.words, counts=self.counts, probes=self.probes, depth=self.depth, recall=self.recall, schema=self.schema)
        return out.getvalue()

    @staticmethod
    def unpacked(raw: bytes) -> Model:
        held = np.load(io.BytesIO(raw))
        return Model(int(held["dim"]), held["centres"], held["words"], held["counts"], int(held["probes"]), int(held["depth"]), float(held["recall"]), str(held["schema"]))


def _closest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words**2).sum(1) - 2 * x @ words.T).argmin(1)


def _means(x: np.ndarray, n: int, seed: int, spherical: bool = False, rounds: int = 15) -> np.ndarray:
    """n centres of k-means; of length one where spherical."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:n]]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(1) if spherical else _closest(x, centres)
        size = np.bincount(near, minlength=len(centres))[:, None]
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = np.where(size > 0, total / np.maximum(size, 1), centres)
        centres = unit(centres) if spherical else centres
    return centres


def _scores(tables: np.ndarray, base: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Approximate cosines, a row a query. base: inner products with the centres."""
    out = base.copy()
    for j in range(code.shape[1]):
        out += tables[:, j, code[:, j]]
    return out


def _codes(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, parts)


def _write(rows: DataFrame, path: str, model: Model, mode: str) -> None:
    kept = rows.sparkSession.sparkContext.broadcast(model)  # some thousand centres at most

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = kept.value
        for batch in batches:
            at, x = matrix(batch.column("embedding"), m.dim)
            if len(at):
                cell, code = m.coded(m.padded(x))
                own = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array((cell % SHELVES).astype(np.int32)), pa.array(cell.astype(np.int32)), own.column("chunk_id"), pa.array([c.tobytes() for c in code], pa.binary()), own.column("embedding")], names=["shelf", "cell", "chunk_id", "code", "embedding"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = rows.mapInArrow(coded, f"shelf int, cell int, chunk_id {kinds['chunk_id']}, code binary, embedding {kinds['embedding']}")
    out.repartitionByRange("shelf", "cell", F.xxhash64("chunk_id")).sortWithinPartitions("shelf", "cell").write.mode(mode).partitionBy("shelf").parquet(f"{path}/rows")


def build(vectors: DataFrame, path: str, k: int = 10, recall: float = 0.95, seed: int = 1) -> Model:
    """Write an index of vectors (chunk_id, embedding) to the folder and return its model.

    Centres and codewords are fitted on SAMPLE vectors at most. How many cells a query looks at and how many rows it
    scores exactly is measured over the whole index: what TRIED sampled vectors need to find `recall` of their k nearest.
    Vectors with nulls are left out; all others have one length.
    """
    spark = vectors.sparkSession
    rows = vectors.where("embedding is not null").select("chunk_id", "embedding")
    n, least, most = rows.agg(F.count("*"), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if least != most:
        raise ValueError("vectors of different lengths")
    dim = most or 1
    share = F.pmod(F.xxhash64(F.lit(seed), "chunk_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, 1.2 * SAMPLE / max(1, n))) + 1
    drawn = rows.where(share).orderBy(F.xxhash64(F.lit(seed), "chunk_id")).limit(SAMPLE)
    sample = np.array([r["embedding"] for r in drawn.select("embedding").collect() if None not in r["embedding"]], np.float64).reshape(-1, dim)
    x = np.pad(unit(sample), ((0, 0), (0, -dim % SUB)))
    if not len(x):
        x = np.zeros((1, dim + -dim % SUB))
    centres = _means(x, max(1, min(int(n**0.5), len(x) // 16)), seed, spherical=True)
    left = (x - centres[(x @ centres.T).argmax(1)]).reshape(len(x), -1, SUB)
    words = np.stack([_means(left[:, j], max(1, min(WORDS, len(x) // 2)), seed + j) for j in range(left.shape[1])])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    model = Model(dim, centres, words, np.zeros(len(centres), np.int64), schema=f"cell int, chunk_id {kinds['chunk_id']}, code binary, embedding {kinds['embedding']}, shelf int")
    _write(rows, path, model, "overwrite")
    model = _calibrated(spark, path, rows, model, drawn.limit(TRIED), k, recall)
    spark.createDataFrame([(model.packed(),)], "model binary").write.mode("overwrite").parquet(f"{path}/model")
    return model


def extend(vectors: DataFrame, path: str) -> None:
    """Add vectors to an index, by its model as it is."""
    model = load(vectors.sparkSession, path)
    _write(vectors.where("embedding is not null").select("chunk_id", "embedding"), path, model, "append")


def load(spark: SparkSession, path: str) -> Model:
    return Model.unpacked(spark.read.parquet(f"{path}/model").first()["model"])


def _counted(spark: SparkSession, path: str, model: Model) -> np.ndarray:
    """Rows of each cell: as many numbers as there are cells."""
    counts = np.zeros(len(model.centres), np.int64)
    for r in model.rows(spark, path).groupBy("cell").count().collect():
        counts[r["cell"]] = r["count"]
    return counts


def _calibrated(spark: SparkSession, path: str, rows: DataFrame, model: Model, asked: DataFrame, k: int, recall: float) -> Model:
    counts = _counted(spark, path, model)
    index = model.rows(spark, path).select("cell", "chunk_id", "code")
    queries = asked.withColumnRenamed("chunk_id", "query_id")
    true = vector_top_k(rows, queries, k + 1).where("query_id <> chunk_id").join(index, "chunk_id").select("query_id", "cell", "code").collect()  # TRIED * k rows
    vectors = {r["query_id"]: r["embedding"] for r in queries.collect()}
    if not true:
        return replace(model, counts=counts, probes=len(model.centres), depth=k, recall=1.0)
    x = model.padded(np.array([vectors[r["query_id"]] for r in true], np.float64))
    cell, code = np.array([r["cell"] for r in true]), np.frombuffer(b"".join(bytes(r["code"]) for r in true), np.uint8).reshape(len(true), -1)
    at_cell = np.argsort(np.argsort(-(x @ model.centres.T), axis=1, kind="stable"), axis=1)[np.arange(len(x)), cell]
    own = (x * model.centres[cell]).sum(1) + np.take_along_axis(model.tables(x), code[:, :, None].astype(int), 2)[:, :, 0].sum(1)
    shared = spark.sparkContext.broadcast((model, x, own))

    def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many codes come before each true neighbour."""
        m, x, own = shared.value
        tables, to_centres, n = m.tables(x), x @ m.centres.T, np.zeros(len(x), np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                n += (_scores(tables, to_centres[:, part.column("cell").to_numpy()], _codes(part.column("code"), len(m.words))) > own[:, None] + 1e-12).sum(1)
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(n))), "n": pa.array(n)})

    before = index.select("cell", "code").mapInArrow(ahead, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).orderBy("i").collect()
    rank = np.array([r["n"] for r in before])
    at = min(len(true) - 1, int(np.ceil(recall**0.5 * len(true))) - 1)
    probes, depth = int(np.sort(at_cell)[at]) + 1, max(k, int(np.sort(rank)[at]) + 1)
    return replace(model, counts=counts, probes=probes, depth=depth, recall=float(((at_cell < probes) & (rank < depth)).mean()))


class _Coded:
    """The `depth` held rows of a cell with the best scores by code, for each asked vector."""

    def __init__(self, asked: pa.Table, model: Model):
        self.model, self.found, self.size = model, [], 0
        _, x = matrix(asked.column("asked").combine_chunks(), model.centres.shape[1])
        self.ids, cell = asked.column("query_id").combine_chunks(), asked.column("at_cell")[0].as_py()
        self.tables, self.base = model.tables(x), x @ model.centres[cell]

    def add(self, held: pa.RecordBatch) -> None:
        depth = self.model.depth
        for a in range(0, held.num_rows, 2048):
            part = held.slice(a, 2048)
            s = _scores(self.tables, np.repeat(self.base[:, None], part.num_rows, 1), _codes(part.column("code"), len(self.model.words)))
            least = np.partition(s, -depth, axis=1)[:, -depth][:, None] if s.shape[1] > depth else -np.inf
            query, row = np.nonzero(s >= least)
            self.found.append(pa.table({"q": query, "cell": part.column("cell").take(pa.array(row)), "chunk_id": part.column("chunk_id").take(pa.array(row)), "score": s[query, row]}))
            self.size += len(query)
            if self.size > 4 * depth * len(self.ids):
                self.found = [self.best()]
                self.size = len(self.found[0])

    def best(self) -> pa.Table:
        return best_rows(pa.concat_tables(self.found), self.model.depth, [("q", "ascending"), ("score", "descending"), ("chunk_id", "ascending")])

    def result(self) -> pa.Table | None:
        if not self.found:
            return None
        best = self.best()
        return pa.table([self.ids.take(best.column("q").combine_chunks()), best.column("cell"), best.column("chunk_id"), best.column("score")], names=["query_id", "cell", "chunk_id", "score"])


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int | None = None, depth: int | None = None, digits: int = 6) -> DataFrame:
    """The k best rows of each query (query_id, embedding): query_id, chunk_id, score, rank. Queries go to the cells that they look at, where the cell's codes stream past them; a large cell is split among tasks. The best `depth` of a query are scored exactly."""
    model = load(spark, path)
    model = replace(model, counts=_counted(spark, path, model), probes=min(probes or model.probes, len(model.centres)), depth=max(k, depth or model.depth))
    asked, n, dim = asked_vectors(queries)
    if n and dim != model.dim:
        raise ValueError("queries of another length than the index")
    kept = spark.sparkContext.broadcast(model)
    split = np.maximum(1, -(-model.counts // CELL_ROWS))
    blocks = max(1, -(-n * model.probes // (len(model.centres) * QUERY_BLOCK)))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = kept.value
        for batch in batches:
            at, x = matrix(batch.column("asked"), m.dim)
            x = m.padded(x)
            for a in range(0, len(at), 64):  # each goes to all its cells
                cells = m.nearest(x[a : a + 64], m.probes)
                row = a + np.repeat(np.arange(len(cells)), cells.shape[1])
                own = x[row]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, own.shape[1]), pa.int32()), pa.array(own.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(at[row])), lists, pa.array(cells.ravel().astype(np.int32))], names=["query_id", "asked", "at_cell"])

    parts = F.get(F.array(*[F.lit(int(s)) for s in split]), F.col("at_cell"))
    key = lambda cell, block, part: ((F.col(cell).cast("long") * blocks + F.col(block)) * int(split.max()) + F.col(part)).alias("meet")
    to_cells = asked.mapInArrow(routed, f"query_id {queries.schema['query_id'].dataType.simpleString()}, asked array<double>, at_cell int")
    to_cells = to_cells.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    index = model.rows(spark, path)
    wanted = to_cells.select((F.col("at_cell") % SHELVES).alias("shelf"), F.col("at_cell").alias("cell")).distinct()  # a row a cell at most
    held = index.select("shelf", "cell", "chunk_id", "code").join(F.broadcast(wanted), ["shelf", "cell"], "left_semi")
    held = held.withColumn("at_cell", F.col("cell")).withColumn("part", F.pmod(F.xxhash64("chunk_id"), parts)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    kinds = queries.schema["query_id"].dataType.simpleString(), index.schema["chunk_id"].dataType.simpleString()
    by_code = meet(to_cells.select(key("at_cell", "block", "part"), "query_id", "asked", "at_cell"), held.select(key("at_cell", "block", "part"), "cell", "chunk_id", "code"), lambda t: _Coded(t, kept.value), f"query_id {kinds[0]}, cell int, chunk_id {kinds[1]}, score double")
    near = top_ranked(by_code, model.depth).select("query_id", "cell", (F.col("cell") % SHELVES).alias("shelf"), "chunk_id")
    exact = near.join(index.select("shelf", "cell", "chunk_id", "embedding"), ["shelf", "cell", "chunk_id"]).join(asked, "query_id")
    score = F.coalesce(F.round(F.try_divide(_dot("embedding", "asked"), F.sqrt(_dot("embedding", "embedding") * _dot("asked", "asked"))), digits), F.lit(0.0))
    return top_ranked(exact.select("query_id", "chunk_id", score.alias("score")), k)


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
