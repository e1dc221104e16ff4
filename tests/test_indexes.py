"""Kept indexes of vectors and text: recall, equal results, what their plans read."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions.stemming import stem, stemmed
from corvane.operators import meeting, retrieval, text_index, vector_index


def values(d, *columns):
    return sorted(tuple(r) for r in d.select(*columns).collect())


def plan(d):
    return d._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def vectors(spark, data):
    return spark.read.parquet(f"{data}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")


@pytest.fixture(scope="module")
def asked(vectors):
    return vectors.where("chunk_id % 25 = 0").withColumnRenamed("chunk_id", "query_id")


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "vectors")
    vector_index.build(vectors, path)
    return path


def test_vector_index_finds_the_nearest_with_few_distances(spark, index, vectors, asked):
    exact = set(values(retrieval.vector_top_k(vectors, asked, 10), "query_id", "chunk_id"))
    near = set(values(vector_index.search(spark, index, asked, 10), "query_id", "chunk_id"))
    model = vector_index.load(spark, index)
    assert len(exact & near) / len(exact) >= 0.9 and model.recall >= 0.9
    assert model.depth * 10 <= vectors.count() == model.counts.sum()
    scores = dict(((q, c), s) for q, c, s in values(retrieval.vector_top_k(vectors, asked, 500), "query_id", "chunk_id", "score"))
    assert all(abs(scores[q, c] - s) < 2e-6 for q, c, s in values(vector_index.search(spark, index, asked, 10), "query_id", "chunk_id", "score"))


def test_all_cells_and_rows_give_the_exact_result(spark, index, vectors, asked):
    everything = vector_index.search(spark, index, asked, 10, probes=1 << 20, depth=1 << 20)
    assert values(everything, "query_id", "chunk_id", "rank") == values(retrieval.vector_top_k(vectors, asked, 10), "query_id", "chunk_id", "rank")


def test_codes_are_read_without_vectors(spark, index, asked):
    text = plan(vector_index.search(spark, index, asked, 10))
    scans = [line for line in text.splitlines() if "FileScan" in line and index in line]
    assert any("code:binary" in s and "embedding" not in s.split("ReadSchema")[1] for s in scans)


def test_vector_index_grows(spark, vectors, asked, tmp_path):
    path = str(tmp_path / "index")
    vector_index.build(vectors.where("chunk_id % 3 > 0"), path)
    vector_index.extend(vectors.where("chunk_id % 3 = 0"), path)
    exact = set(values(retrieval.vector_top_k(vectors, asked, 10), "query_id", "chunk_id"))
    assert len(exact & set(values(vector_index.search(spark, path, asked, 10), "query_id", "chunk_id"))) / len(exact) >= 0.9


def test_large_cells_and_many_queries_are_split(spark, index, asked, monkeypatch):
    want = values(vector_index.search(spark, index, asked, 10), "query_id", "chunk_id", "score", "rank")
    monkeypatch.setattr(vector_index, "CELL_ROWS", 7)
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", 1)
    assert values(vector_index.search(spark, index, asked, 10), "query_id", "chunk_id", "score", "rank") == want


@pytest.mark.parametrize("n", [0, 1, 5])
def test_small_vector_tables(spark, tmp_path, n):
    d = spark.createDataFrame([(i, [float(i), 1.0, 0.0]) for i in range(n)] + [(90, None), (91, [None, 1.0, 2.0])], "chunk_id long, embedding array<float>")
    d = d if n else d.where("chunk_id = 90")
    vector_index.build(d, str(tmp_path / "i"))
    q = spark.createDataFrame([(1, [0.0, 1.0, 0.0]), (2, None)], "query_id int, embedding array<float>")
    if n:
        assert len(values(vector_index.search(spark, str(tmp_path / "i"), q, 3), "query_id", "chunk_id")) == min(n, 3)
    assert vector_index.search(spark, str(tmp_path / "i"), q.where("false"), 3).count() == 0


def test_exact_search_is_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (300, 6)).astype(float)
    q = np.vstack([x[:7], np.zeros((1, 6))])
    cos = np.round((q @ x.T) / np.maximum(np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1), 1e-300), 6) + 0.0
    d = spark.createDataFrame([(f"c{i:03}", v.tolist()) for i, v in enumerate(x)] + [("z", None), ("y", [1.0]), ("w", [None] * 6)], "chunk_id string, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)] + [(99, None)], "query_id int, embedding array<double>")
    want = [(i, f"c{j:03}", r + 1) for i in range(8) for r, j in enumerate(sorted(range(300), key=lambda j: (-cos[i, j], j))[:9])]
    assert values(retrieval.vector_top_k(d, asked, 9), "query_id", "chunk_id", "rank") == sorted(want)
    assert retrieval.vector_top_k(d.where("false"), asked, 9).count() == 0 == retrieval.vector_top_k(d, asked.where("false"), 9).count()


def test_blocks_of_queries(spark, vectors, asked, monkeypatch):
    want = values(retrieval.vector_top_k(vectors, asked, 5), "query_id", "chunk_id", "rank")
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    assert values(retrieval.vector_top_k(vectors, asked, 5), "query_id", "chunk_id", "rank") == want


def test_a_computed_embedding_is_evaluated_once(spark):
    rows = spark.createDataFrame([("a", "x y"), ("b", "z")], "chunk_id string, content string")
    d = retrieval.vector_top_k(rows.withColumn("embedding", retrieval.hashed_vector(F.col("content"))), rows.select(F.col("chunk_id").alias("query_id"), F.col("content")).withColumn("embedding", retrieval.hashed_vector(F.col("content"))), 1)
    assert plan(d).count("sha2(") == 2  # one a side


def test_sides_meet_by_key(spark):
    class Sums:
        def __init__(self, asked):
            self.n, self.total = len(asked), 0

        def add(self, held):
            self.total += sum(held.column("x").to_pylist())

        def result(self):
            import pyarrow as pa

            return pa.table({"n": [self.n], "total": [self.total]})

    a = spark.createDataFrame([(i % 3, i) for i in range(9)] + [(7, 1)], "meet long, q int")
    b = spark.createDataFrame([(i % 4, i) for i in range(4000)], "meet long, x long")
    want = sorted((3, sum(i for i in range(4000) if i % 4 == m)) for m in range(3))
    assert sorted(tuple(r) for r in meeting.meet(a, b, Sums, "n long, total long").collect()) == want


STEMS = {
    "consigned": "consign", "consistency": "consist", "consolatory": "consolatori", "conspicuously": "conspicu", "constancy": "constanc", "knackeries": "knackeri", "kneeling": "kneel", "knitted": "knit", "generously": "generous", "generate": "generat",
    "communism": "communism", "happy": "happi", "dying": "die", "skies": "sky", "hopping": "hop", "hoping": "hope", "agreed": "agre", "luxuriate": "luxuri", "ties": "tie", "cries": "cri", "gas": "gas", "this": "this", "gaps": "gap", "by": "by",
    "say": "say", "cry": "cri", "rationally": "ration", "sensibility": "sensibl", "controller": "control", "rate": "rate", "youth": "youth", "enjoy": "enjoy", "tokens": "token", "queries": "queri", "inning": "inning", "succeeds": "succeed",
    "beautiful": "beauti", "formalize": "formal", "hopefulness": "hope", "adoption": "adopt", "arsenal": "arsenal", "bed": "bed", "embed": "emb", "straße": "straße", "東京": "東京", "": "",
}


def test_stems(spark):
    assert {w: stem(w) for w in STEMS} == STEMS
    d = spark.createDataFrame([(list(STEMS),), ([],), (None,)], "t array<string>")
    assert [r[0] for r in d.select(stemmed(F.col("t"))).collect()] == [list(STEMS.values()), [], []]


@pytest.fixture(scope="module")
def corpus(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return d.unionByName(spark.createDataFrame([(9001, None), (9002, ""), (9003, "red fox"), (9004, "red red dog"), (9005, "The FOX is red"), (9006, "foxes, redness")], d.schema))


@pytest.fixture(scope="module")
def questions(spark, corpus):
    some = corpus.where("content <> ''").select(F.col("chunk_id").alias("query_id"), F.array_join(F.slice(F.split("content", " "), 3, F.lit(1) + F.col("chunk_id").cast("int") % 3), " ").alias("query"))
    return some.unionByName(spark.createDataFrame([(-1, "red nothere"), (-2, ""), (-3, None), (-4, "the"), (-5, "red fox red")], some.schema))


def test_text_index_gives_what_a_scan_gives(spark, corpus, questions, tmp_path, monkeypatch):
    want = values(retrieval.text_top_k(corpus, questions, 7), "query_id", "chunk_id", "score", "rank")
    assert len(want) > 300
    for rows in (1 << 20, 5):  # with and without frequent terms in slices
        monkeypatch.setattr(text_index, "SLICE_ROWS", rows)
        path = str(tmp_path / f"index{rows}")
        text_index.build(corpus, path)
        assert values(text_index.search(spark, path, questions, 7), "query_id", "chunk_id", "score", "rank") == want
        spark.sql(f"DROP TABLE {text_index._table(path)}")  # as in a new session
        assert values(text_index.search(spark, path, questions, 7), "query_id", "chunk_id", "score", "rank") == want


def test_postings_are_not_shuffled(spark, corpus, questions, tmp_path):
    path = str(tmp_path / "index")
    text_index.build(corpus, path)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = plan(text_index.search(spark, path, questions, 7)).splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    scans = [i for i, x in enumerate(lines) if "FileScan" in x and text_index._table(path) in x]
    assert len(scans) == 3  # rarest terms twice, the others once
    indent = [len(x) - len(x.lstrip(" :+-*")) for x in lines]
    for i in scans:
        at, parents = indent[i], []
        for j in reversed(range(i)):
            if indent[j] < at:
                at = indent[j]
                parents.append(lines[j])
        assert "SortMergeJoin" in next(x for x in parents if "Exchange" in x or "SortMergeJoin" in x) and "Bucketed: true" in lines[i]


def test_english_search_meets_other_forms(spark, corpus, tmp_path):
    path = str(tmp_path / "index")
    text_index.build(corpus, path, terms=text_index.english_terms)
    q = spark.createDataFrame([(1, "a fox"), (2, "Foxes"), (3, "redness foxes")], "query_id int, query string")
    got = values(text_index.search(spark, path, q, 9, terms=text_index.english_terms), "query_id", "chunk_id")
    assert [c for i, c in got if i == 1] == [c for i, c in got if i == 2] == [c for i, c in got if i == 3] == [9003, 9005, 9006]
    score = lambda tf, df, length, n, mean: math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))
    totals = spark.read.parquet(f"{path}/totals").first()
    first = text_index.search(spark, path, q, 9, terms=text_index.english_terms).where("query_id = 1 and chunk_id = 9003").first()
    assert first["score"] == pytest.approx(score(1, 3, 2, totals["n"], totals["mean"]), abs=1e-6)
