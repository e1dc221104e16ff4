"""Periodic runs against brute force, and on awkward rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import runs


def brute(words, least=6, times=4):
    """All runs, by every period on its own, without those that a smaller period also has."""
    n, found = len(words), []
    for q in range(1, n):
        start = None
        for i in range(n - q + 1):
            same = i < n - q and words[i] == words[i + q]
            if same and start is None:
                start = i
            if not same and start is not None:
                size = i - start + q
                if size >= max(least, times * q) and not any(all(words[j] == words[j + d] for j in range(start, start + size - d)) for d in range(1, q)):
                    found.append((start, size, q))
                start = None
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("least,times", [(6, 4), (20, 4), (4, 4), (3, 3), (9, 5)])
def test_find_is_brute_force(least, times):
    rng = random.Random(least)
    for _ in range(250):
        words = [rng.randrange(rng.choice([1, 2, 2, 3, 9])) for _ in range(rng.randrange(60))]
        if rng.random() < 0.6 and words:
            a, p = rng.randrange(len(words)), rng.randint(1, 14)
            words = words[:a] + [words[a + (i - a) % min(p, len(words) - a)] for i in range(a, a + rng.randrange(90))] + words[a:]
        got = sorted(runs.find(np.array(words, np.int64), len(words), least, times), key=lambda r: (r[0], r[2]))
        assert got == brute(words, least, times)


def test_bands_cover_all_lags():
    for least, times in ((6, 4), (50, 4), (3, 3), (7, 6)):
        at = 1
        for first, last, k in runs.bands(3000, least, times):
            assert first == at and all(k >= q and k <= max(least, times * q) - q for q in range(first, last + 1))
            at = last + 1
        assert max(least, times * at) > 3000


def test_documents_do_not_meet(spark):
    rows = [(i, "a b a b a b") for i in range(20)] + [(99, " ".join(["x"] * 100_000)), (100, "A a A a A a A a")]
    got = {r["doc_id"]: r for r in runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), ["doc_id"]).collect()}
    assert all(got[i]["runs"] == [] and got[i]["collapsed"] == "a b a b a b" for i in range(20))
    assert [tuple(r) for r in got[99]["runs"]] == [(0, 100_000, 1)] and got[99]["collapsed"] == "x"
    assert [tuple(r) for r in got[100]["runs"]] == [(0, 8, 2)] and got[100]["collapsed"] == "A a"


def test_awkward_rows(spark):
    schema = "doc_id long, text string, Runs string, COLLAPSED int, raw string"
    rows = [(1, None, "r", 1, "x"), (2, "", "r", 1, "x"), (3, " \t\n", "r", 1, "x"), (None, "a a a a a a a", "r", 1, "x"), (4, "é é é é é é", None, None, None), (4, "é é é é é é", None, None, None)]
    d = spark.createDataFrame(rows, schema)
    got = runs.periodic_runs(d, d.columns)
    assert got.columns == ["doc_id", "text", "raw", "runs", "collapsed"]
    assert sorted((r["doc_id"] or 0, len(r["runs"]), r["collapsed"]) for r in got.collect()) == [(0, 1, "a"), (1, 0, ""), (2, 0, ""), (3, 0, ""), (4, 1, "é"), (4, 1, "é")]
    assert runs.periodic_runs(d.where("false"), ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(d, ["doc_id"], times=2)


def test_query(spark, data):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {r["doc_id"]: r for r in runs.op13(spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    hits = 0
    for r in docs:
        words = [w.decode() for w in (r["text"] or "").encode().split()]
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 400 and h % 10:
            continue  # brute force takes the square of the words
        found = brute(words)
        best = min(((-m, s, q) for s, m, q in found), default=None)
        want = (len(found), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4), sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(collapsed(words, found)))
        assert tuple(got[r["doc_id"]])[1:] == want
        hits += len(found)
    assert hits > 5


def test_text_with_loops(spark):
    d = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(30))) for i in range(60)] + [(None, "a b"), (61, None), (62, "")], "doc_id long, text string")
    got = d.select("doc_id", runs.looped(F.col("doc_id"), F.col("text")).alias("t")).collect()
    for r in got[:60]:
        h = zlib.crc32(str(r["doc_id"]).encode())
        g, words = h // 10, [f"w{k}" for k in range(30)]
        a = g % 30
        p = 1 + (30 - a) // (3 + g % 8)
        assert r["t"].split() == ([words[i] if i < a else words[a + (i - a) % p] for i in range(30)] if h % 10 == 0 else words)
    assert [r["t"] for r in got[60:]] == ["a b", None, ""]
