"""Small cases with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.operators import answers, chat, chunking, evaluation, patches, registry, retrieval, versioning, wiki
from corvane.operators.numbering import numbered
from corvane.sources import files as S
from corvane.streaming import push

FILE = "repository_id string, branch string, file_path string"


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("n", "want"), [(0, []), (1, [(1, 1)]), (50, [(1, 50)]), (51, [(1, 50), (41, 51)]), (90, [(1, 50), (41, 90)]), (91, [(1, 50), (41, 90), (81, 91)])])
def test_sliding_windows(spark, n, want):
    d = spark.createDataFrame([("r", "b", "f", "".join(f"l{i}\n" for i in range(n)))], f"{FILE}, content string")
    got = chunking.sliding_windows(d)
    assert values(got, "start_line", "end_line") == want
    if n == 51:
        assert got.where("start_line = 41").first()["content"] == "".join(f"l{i}\n" for i in range(40, 51))


def test_blank_and_mixed_line_ends(spark):
    d = spark.createDataFrame([("r", "b", "f", "   \n  "), ("r", "b", "g", "a\r\nb\rc\x0bd e"), ("r", "b", "h", None)], f"{FILE}, content string")
    assert values(chunking.sliding_windows(d), "file_path", "end_line") == [("g", 5)]
    with pytest.raises(ValueError):
        chunking.sliding_windows(d, 5, 5)


def test_structural_blocks_cover_the_file(spark):
    code = "import os\n\n" + "".join(f"def f{i}():\n    return {'x' * 200}\n\n" for i in range(6))
    d = spark.createDataFrame([("r", "b", "a.py", code), ("r", "b", "b.zzz", "x\n")], f"{FILE}, content string")
    got = chunking.chunk_files(d).where("file_path = 'a.py'").orderBy("start_line").collect()
    assert len(got) > 1 and "".join(r["content"] for r in got) == code
    assert all(r["content"].startswith("def ") for r in got[1:])
    assert chunking.chunk_files(d).where("file_path = 'b.zzz'").count() == 1


def test_languages(spark):
    names = ["a/B.PY", "Dockerfile", "x/makefile", "no", ".bashrc", "a.tar.rs", "b.txt"]
    d = spark.createDataFrame([(n,) for n in names], "p string").select("p", text.language_of(F.col("p")).alias("l"))
    assert {r["p"]: r["l"] for r in d.collect()} == {"a/B.PY": "python", "Dockerfile": "dockerfile", "x/makefile": "makefile", "no": None, ".bashrc": None, "a.tar.rs": "rust", "b.txt": None}


def test_filters(spark):
    d = spark.range(5)
    assert d.where(text.where_all({"id": {"in": [1, 3], ">": 1}})).count() == 1
    assert d.where(text.where_all({})).count() == 5
    for bad, error in (({"id": {"~": 1}}, ValueError), ({"id": {"in": "x"}}, TypeError), ({"id": object()}, TypeError), ({"id": {"like": 1}}, TypeError)):
        with pytest.raises(error):
            text.where_all(bad)


def test_active_versions(spark):
    """The pointer's version; legacy without a pointer row; nothing where the pointer is null."""
    rows = spark.createDataFrame([("r", "b", f, p) for f in "abc" for p in ("legacy", "v1", "v2")] + [("r", "b", "d", None)], f"{FILE}, publish_id string")
    pointers = spark.createDataFrame([("r", "b", "a", "v2"), ("r", "b", "b", None)], f"{FILE}, active_publish_id string")
    assert [tuple(r) for r in versioning.active_only(rows, pointers).select("file_path", "publish_id").orderBy("file_path").collect()] == [("a", "v2"), ("c", "legacy"), ("d", None)]


def test_publish_empty_batch_withdraws(spark):
    chunks = spark.createDataFrame([("1", "r", "b", "a", "v1")], f"chunk_id string, {FILE}, publish_id string")
    staged = chunks.where("false").drop("publish_id").withColumn("embedding", F.array(F.lit(1.0)))
    pointers = spark.createDataFrame([("r", "b", "a", "v1")], f"{FILE}, active_publish_id string")
    out = versioning.publish_full(staged, chunks, pointers, "v2")
    assert values(out.pointers, "file_path", "active_publish_id") == [("a", None)]
    assert values(out.cleanup, "file_path", "previous_publish_id") == [("a", "v1")]
    assert versioning.delete_versions(out.chunks, out.cleanup).count() == 0


def test_late_branch_events_are_ignored(spark):
    e = [("r", "b", "pending", None, "c2", 1), ("r", "b", "indexed", "c1", None, 2), ("r", "b", "failed", "c1", None, 3), ("r", "b", "indexed", "c2", None, 4)]
    d = spark.createDataFrame(e, "repository_id string, branch string, status string, latest_commit string, target_commit string, t long").withColumn("ts", F.timestamp_seconds("t"))
    r = versioning.branch_states(d).first()
    assert (r["status"], r["target_commit"], r["last_commit"], r["ignored"]) == ("indexed", None, "c2", 2)


def ranked(spark, ids, query=1):
    return spark.createDataFrame([(query, x, i + 1) for i, x in enumerate(ids)], "query_id int, chunk_id string, rank int")


def test_fusion(spark):
    got = retrieval.fuse([ranked(spark, ["a", "b"]), ranked(spark, ["b", "c"])]).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == ["b", "a", "c"]
    assert got[0]["score"] == pytest.approx(1 / 62 + 1 / 61) and got[1]["score"] == pytest.approx(1 / 61)
    # equal scores: the order they were met in
    assert [r["chunk_id"] for r in retrieval.fuse([ranked(spark, ["x", "y"]), ranked(spark, ["z", "w"])]).orderBy("rank").collect()] == ["x", "z", "y", "w"]


def test_rerank_and_failures(spark):
    d = spark.createDataFrame([(1, "q", "a", "one", 1), (1, "q", "b", "three", 2)], "query_id int, query string, chunk_id string, content string, rank int")
    assert [r["chunk_id"] for r in retrieval.rerank(d, lambda q, t: [float(len(x)) for x in t], 2).orderBy("new_rank").collect()] == ["b", "a"]
    assert [r["chunk_id"] for r in retrieval.rerank(d, lambda q, t: 1 / 0, 1).collect()] == ["a"]
    assert retrieval.generate(d.limit(1), lambda t: 1 / 0, "content").first()["error"]


def test_text_search_needs_every_term(spark):
    c = spark.createDataFrame([("1", "red fox"), ("2", "red red dog"), ("3", "The FOX is red")], "chunk_id string, content string")
    q = spark.createDataFrame([(1, "the red fox"), (2, "cat"), (3, "red")], "query_id int, query string")
    got = retrieval.text_top_k(c, q, 5)
    assert values(got.where("query_id = 1"), "chunk_id") == [("1",), ("3",)] and got.where("query_id = 2").count() == 0
    assert got.where("query_id = 3 and rank = 1").first()["chunk_id"] == "2"


@pytest.mark.parametrize(("n", "c", "k", "want"), [(3, 1, 1, 1 / 3), (3, 1, 2, 2 / 3), (3, 1, 3, 1), (0, 0, 1, 0), (5, 0, 2, 0), (5, 2, 9, 1), (5, 4, 2, 1), (10, 3, 4, 1 - 35 / 210)])
def test_pass_at_k(spark, n, c, k, want):
    assert one(spark, evaluation.pass_at_k(F.lit(n), F.lit(c), F.lit(k))) == pytest.approx(want)


def test_missing_tasks_are_reported(spark):
    r = spark.createDataFrame([(1, "a", True), (1, "b", True), (2, "a", False)], "run_id int, task_id string, resolved boolean")
    assert values(evaluation.same_tasks(r), "run_id", "task_id") == [(2, "b")]


def test_rates(spark):
    rates = spark.createDataFrame([("m", "x", 1.0, 2.0), ("m", "*", 3.0, 4.0)], "model string, region string, input_rate double, output_rate double")
    calls = spark.createDataFrame([("m", "x"), ("m", "y"), ("n", "x")], "model string, region string")
    assert [r["input_rate"] for r in evaluation.with_rates(calls, rates).orderBy("model", "region").collect()] == [1.0, 3.0, None]
    assert one(spark, evaluation.generation_cost(F.lit(-1), F.lit(1), F.lit(1.0), F.lit(1.0))) is None


def test_grid(spark):
    lists = {"family": ["all"], "context_source": ["code", "wiki"], "chunking_strategy": ["sliding", "ast"], "codegen_model": ["a", "b"], "embedding_model": ["e", "f"]}
    assert evaluation.experiment_grid(spark, lists, ["f1"]).distinct().count() == 16
    with pytest.raises(ValueError):
        evaluation.experiment_grid(spark, lists | {"family": ["nope"]}, ["f1"])


@pytest.mark.parametrize(("p", "g", "want"), [("7", "7", "correct"), (None, "7", "no_numeric_answer"), ("8", "7", "off_by_one"), ("-7", "7", "sign_error"), ("105", "100", "near_miss"), ("700", "7", "magnitude_error"), ("10", "7", "wrong_numeric"), ("7", None, "bad_reference"), ("1-2", "7", "format_error")])
def test_error_classes(spark, p, g, want):
    assert one(spark, answers.error_class(F.lit(False), F.lit(p).cast("string"), F.lit(g).cast("string"))) == want


def test_chat_cleaning(spark):
    m = [("a", 0, "system", "s"), ("a", 1, "human", " hi "), ("a", 2, "user", "there"), ("a", 3, "gpt", "yo"), ("a", 4, "user", "bye"), ("b", 0, "assistant", "x"), ("c", 0, "user", "alone"), ("d", 0, "user", '[{"text": "p"}, {"text": "q"}]'), ("d", 1, "model", '{"content": "r"}')]
    d = spark.createDataFrame(m, "conv_id string, turn int, role string, text string")
    assert values(chat.clean_messages(d), "conv_id", "place", "role", "content") == [("a", 0, "user", "hi\n\nthere"), ("a", 1, "assistant", "yo"), ("d", 0, "user", "p\nq"), ("d", 1, "assistant", "r")]


def test_patch_extraction_and_counts(spark):
    answer = "text <note>no</note>\n```diff\na/x.py\nb/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,9 +1,9 @@ f\nbare\n-old\n+new\n\n@@ -5 +5 @@\n x\n```"
    d = spark.createDataFrame([(1, answer), (2, None), (3, "plain</s>rest")], "id int, r string").select("id", text.model_patch(F.col("r")).alias("patch"))
    got = {r["id"]: r["patch"] for r in patches.recounted(d, "id").collect()}
    assert got[1] == "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,3 +1,3 @@ f\n bare\n-old\n+new\n \n@@ -5,1 +5,1 @@\n x\n"
    assert got[3] == "plain\n" and got[2] == ""
    assert one(spark, text.touched_paths(F.lit(got[1]))) == ["x.py"]


def test_nested_sections(spark):
    s = '{"sections": [{"slug": "a", "pages": [{"slug": "p", "title": "P"}], "subsections": [{"slug": "b", "pages": [{"slug": "q", "title": "Q", "source_file_hints": ["f"]}]}]}]}'
    d = spark.createDataFrame([(1, s), (2, "{}")], "id int, structure_json string")
    assert values(wiki.pages_of(d), "id", "section_path", "slug", "source_file_hints") == [(1, "a", "p", []), (1, "a/b", "q", ["f"])]


def test_repository_names(spark):
    for ref, want in (("https://GitHub.com/Own/Rep.git", "own/rep"), ("github.com/a/b/tree", "a/b"), ("a", None), ("https://gitlab.com/a/b", None), ("a/.git", None)):
        assert one(spark, text.repository_name(F.lit(ref))) == want


def test_shorten(spark):
    got = one(spark, text.shorten(F.lit("x" * 1000), 600))
    assert len(got) <= 600 and "\n...\n" in got
    assert one(spark, text.shorten(F.lit("x" * 300), 100)).startswith("x") and len(one(spark, text.shorten(F.lit("x" * 300), 100))) == 256


def test_unknown_ids_fail(spark):
    with pytest.raises(Exception, match="unknown id"):
        registry.slice_by_ids(spark.range(3), [9], "id").collect()


def test_predictions_keep_the_last(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"task_id": "a", "model_patch": "1"}\n\n{"task_id": " a ", "model_patch": " 2 ", "input_tokens": "7"}\n')
    assert values(S.predictions(spark, str(tmp_path / "p.jsonl")), "task_id", "model_patch", "input_tokens") == [("a", "2", 7)]
    (tmp_path / "e.jsonl").write_text("\n")
    with pytest.raises(ValueError):
        S.predictions(spark, str(tmp_path / "e.jsonl"))


def test_repository_scan(spark, tmp_path):
    for name, raw in (("a.py", b"x = 1\n"), ("b.txt", b"x"), ("yarn.lock", b"x"), ("c.md", b"  \n"), ("d.json", b"\xff{}")):
        (tmp_path / name).write_bytes(raw)
    assert [r["file_path"].rsplit("/")[-1] for r in S.repository_files(spark, str(tmp_path)).orderBy("file_path").collect()] == ["a.py", "d.json"]


def test_coalesced_pushes(spark):
    d = spark.createDataFrame([(1, "b", "0", "1", 0, 1), (1, "b", "1", "2", 10, 2), (1, "b", "2", "3", 60, 3)], "repository_id long, branch string, before_commit string, after_commit string, t long, push_id long").withColumn("ts", F.timestamp_seconds("t"))
    assert values(push.coalesced(d), "before_commit", "after_commit", "pushes") == [("0", "2", 2), ("2", "3", 1)]


def test_stream_states_equal_batch(spark, data):
    from corvane.plans import streams

    assert values(streams.str_04(spark, data), "repository_id", "branch", "status", "ignored") == values(streams.str_04_batch(spark, data), "repository_id", "branch", "status", "ignored")


def test_model_outputs_hold_all_lines(spark, tmp_path):
    from corvane.plans import analytics

    n = {0: 40, 1: 3000, 2: 41, 3: 1}
    spark.createDataFrame([(i, "\n".join(f"w{k}" for k in range(c))) for i, c in n.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    mark = {1: "-", 2: "+"}
    for r in analytics.flt_11(spark, str(tmp_path)).collect():
        assert r["patch"].split("\n")[3:] == [f"{mark.get(k, '')}w{k}" for k in range(n[r["doc_id"]])]
    for r in analytics.flt_12(spark, str(tmp_path)).collect():
        c = n[r["doc_id"]]
        own = c - 1 if c > 2 else c
        assert r["patch"].split("\n")[2:-1] == [f"@@ -1,{own} +1,{own} @@", *(f"{mark.get(k, ' ')}w{k}" for k in range(c))]
    assert {(r["doc_id"], *r["paths"]) for r in analytics.flt_13(spark, str(tmp_path)).collect()} == {(i, f"f{i}.txt") for i in n}


def test_sections_at_any_depth(spark):
    import json


    section = {"slug": "s9", "pages": [{"slug": "deep", "title": "t"}]}
    for k in range(8, -1, -1):
        section = {"slug": f"s{k}", "pages": [], "subsections": [section]}
    rows = [("g", json.dumps({"sections": [section, {"slug": "b", "pages": [{"slug": "p", "source_file_hints": ["x"]}]}]})), ("none", None), ("bad", "{"), ("empty", "{}")]
    got = wiki.pages_of(spark.createDataFrame(rows, "id string, structure_json string")).orderBy("slug").collect()
    assert [tuple(r) for r in got] == [("g", "/".join(f"s{k}" for k in range(10)), "deep", "t", "", []), ("g", "b", "p", None, "", ["x"])]


def test_vectors_that_are_zero_or_broken(spark):

    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [None, 1.0]), (4, [1.0]), (5, None), (6, [-1.0, 0.0])], "chunk_id long, embedding array<double>")
    q = spark.createDataFrame([(9, [2.0, 0.0])], "query_id long, embedding array<double>")
    assert [(r["chunk_id"], r["score"]) for r in retrieval.vector_top_k(v, q, 5).orderBy("rank").collect()] == [(1, 1.0), (2, 0.0), (6, -1.0)]
    with pytest.raises(ValueError):
        retrieval.vector_top_k(v, v.withColumnRenamed("chunk_id", "query_id"), 5)


def test_terms_by_smart_case(spark, monkeypatch):

    monkeypatch.setattr(retrieval, "TERM_BLOCK", 2)
    d = spark.createDataFrame([("a", "Some Token here"), ("b", "token HERE"), ("c", None), ("d", "")], "chunk_id string, content string")
    q = spark.createDataFrame([(1, ["Token", "here", "he", "zz"]), (2, ["token"]), (3, [])], "query_id long, terms array<string>")
    got = lambda smart: {(r["query_id"], r["chunk_id"]): r["score"] for r in retrieval.contains_any(d, q, 9, smart_case=smart).collect()}
    assert got(True) == {(1, "a"): 3.0, (1, "b"): 2.0, (2, "a"): 1.0, (2, "b"): 1.0}
    assert got(False) == {(1, "a"): 3.0, (1, "b"): 3.0, (2, "a"): 1.0, (2, "b"): 1.0}
    paths = spark.createDataFrame([("src/tests/a.py",), ("test_a.py",), ("a_test.go",), ("src/latest.py",)], "p string")
    assert [r[0] for r in paths.select(retrieval.is_test(F.col("p"))).collect()] == [True, True, True, False]


def test_expanded_search(spark):

    d = spark.createDataFrame([("a", "red fish"), ("b", "blue bird"), ("c", "green tree")], "chunk_id string, content string")
    vectors = lambda rows, column: rows.withColumn("embedding", retrieval.hashed_vector(F.col(column)))
    q = spark.createDataFrame([(1, "red fish", ["bird"]), (2, "green tree", [])], "query_id long, query string, keywords array<string>")
    got = retrieval.expanded([(d, vectors(d, "content"))], q, lambda rows: vectors(rows, "query"), 2)
    best = {r["query_id"]: r["chunk_id"] for r in got.where("rank = 1").collect()}
    assert best == {1: "a", 2: "c"} and got.where("rank > 2").count() == 0


def test_runs_that_differ(spark):

    runs = lambda rows: spark.createDataFrame(rows, "run_id string, family string, task_id string, resolved boolean")
    same = runs([("a", "f", "t", True), ("b", "f", "t", False)])
    assert evaluation.comparable(same).count() == 2
    for rows in ([("a", "f", "t", True), ("b", "g", "t", False)], [("a", "f", "t", True), ("b", "f", "u", False)]):
        with pytest.raises(ValueError):
            evaluation.comparable(runs(rows))
    tasks = spark.createDataFrame([(i, i) for i in range(5)], "task_id long, position long")
    assert evaluation.seeded_subset(tasks, 5, 1).count() == 5
    for n in (0, 6):
        with pytest.raises(ValueError):
            evaluation.seeded_subset(tasks, n, 1)
    c = spark.createDataFrame([(1,), (2,), (3,)], "conv_id long")
    assert tuple(chat.sample_counts(c, c.where("conv_id < 3"), "conv_id", 1).first()) == (1, 1)


def test_numbers_over_ranges(spark):
    """Numbers are dense in each group, null keys and large groups included, however the ranges are cut."""
    d = spark.range(0, 2000, 1, 7).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).alias("g"), F.col("id").cast("string").alias("o"), F.lit("x").alias("within"))
    got = numbered(d, ["g"], ["o"], "n").collect()
    for g in ("hot", None):
        own = sorted((r["n"], r["o"]) for r in got if r["g"] == g)
        assert [n for n, _ in own] == list(range(len(own))) and [o for _, o in own] == sorted(o for _, o in own)
    assert len(got) == 2000 and numbered(d.where("false"), ["g"], ["o"], "n").count() == 0


def test_incremental_index_over_batches(spark, tmp_path):
    """A second push changes one file and deletes one: only these are written again, and what they replace is listed."""
    store = f"file://{tmp_path}/store"
    text_of = lambda n: "".join(f"{n}{i}\n" for i in range(3))
    first = spark.createDataFrame([("1", "main", f, text_of(f)) for f in "abc"], f"{FILE}, content string")
    push.incremental_index(first, store)(spark.createDataFrame([("1", "main")], "repository_id string, branch string"), 0)
    second = spark.createDataFrame([("1", "main", "a", text_of("new")), ("1", "main", "b", text_of("unseen"))], f"{FILE}, content string")
    pushes = spark.createDataFrame([("1", "main", ["a", "c"])], "repository_id string, branch string, changed_files array<string>")
    for _ in range(2):  # running again replaces
        push.incremental_index(second, store)(pushes, 1)
    read = lambda part: spark.read.parquet(f"{store}/{part}")
    assert sorted((r[0], r[1] or "") for r in push.current_pointers(read("pointers")).select("file_path", "active_publish_id").collect()) == [("a", "b1"), ("b", "b0"), ("c", "")]
    assert values(read("cleanup").where("batch = 1"), "file_path", "previous_publish_id") == [("a", "b0"), ("c", "b0")]
    assert values(read("chunks").where("batch = 1"), "file_path", "publish_id") == values(read("vectors").where("batch = 1"), "file_path", "publish_id") == [("a", "b1")]
    push.incremental_index(second, store)(pushes.withColumn("changed_files", F.lit(None).cast("array<string>")), 2)
    assert sorted((r[0], r[1] or "") for r in push.current_pointers(read("pointers")).select("file_path", "active_publish_id").collect()) == [("a", "b2"), ("b", "b2"), ("c", "")]


def test_tasks_keep_the_best_rows_alone(spark):
    """What tasks of a text search hand on is k rows for each query, not a row for each term met."""
    d = spark.range(4000).select(F.col("id").alias("chunk_id"), F.concat(F.lit("red fox "), F.repeat(F.lit("pad "), (F.col("id") % 7).cast("int"))).alias("content")).repartition(2)
    q = spark.createDataFrame([(i, ["red", "fox", f"no{i}"]) for i in range(30)], "query_id long, terms array<string>")
    for step, got in ((1, retrieval.contains_any(d, q, 3)), (7, retrieval.text_top_k(d, q.select("query_id", F.lit("red fox").alias("query")), 3))):
        best = got.collect()
        assert sorted({(r["query_id"], r["rank"], r["chunk_id"]) for r in best}) == [(i, n + 1, step * n) for i in range(30) for n in range(3)]
        node = got._jdf.queryExecution().executedPlan().toString()
        assert node.count("MapInArrow") and "Join" not in node
