"""The indexed store of a stream of pushes: late and repeated batches, new streams, compaction."""

import pytest
from pyspark.sql import functions as F

from corvane.streaming import push

FILES = "repository_id string, branch string, file_path string, content string"
PUSHES = "repository_id string, branch string, before_commit string, after_commit string, t long, push_id long, changed_files array<string>"


def state(spark, store):
    return sorted((r["file_path"], r["active_publish_id"]) for r in push.pointer_log(spark, store).collect())


@pytest.fixture
def files(spark):
    return spark.createDataFrame([("r", "m", f, f"text of {f}") for f in "abc"] + [("r", "n", "z", "text")], FILES)


def pushed(spark, rows):
    return spark.createDataFrame(rows, "repository_id string, branch string, changed_files array<string>")


def test_batches_and_compaction(spark, files, tmp_path):
    store = str(tmp_path / "store")
    run = push.incremental_index(files, store)
    run(pushed(spark, [("r", "m", ["a", "b"])]), 0)
    run(pushed(spark, [("r", "m", ["b", "gone"]), ("r", "n", None)]), 1)
    assert state(spark, store) == [("a", "b0"), ("b", "b1"), ("gone", None), ("z", "b1")]
    assert push.compact(spark, store) == 1
    run(pushed(spark, [("r", "m", None)]), 2)
    want = [("a", "b2"), ("b", "b2"), ("c", "b2"), ("gone", None), ("z", "b1")]
    assert state(spark, store) == want
    run(pushed(spark, [("r", "m", None)]), 2)  # again, after a failure
    assert state(spark, store) == want
    assert sorted((r["file_path"], r["previous_publish_id"]) for r in spark.read.parquet(f"{store}/cleanup/batch=2").collect()) == [("a", "b0"), ("b", "b1")]
    plan = push.pointer_log(spark, store)._jdf.queryExecution().executedPlan().toString()
    assert "batch=0" not in plan and "batch=1" not in plan
    push.compact(spark, store)
    assert state(spark, store) == want


def test_compaction_comes_by_itself(spark, files, tmp_path):
    store = str(tmp_path / "store")
    run = push.incremental_index(files, store, compact_every=2)
    for i in range(5):
        run(pushed(spark, [("r", "m", ["abc"[i % 3]])]), i)
    assert push._folders(spark, f"{store}/base") == [1, 3]
    assert state(spark, store) == [("a", "b3"), ("b", "b4"), ("c", "b2")]


def test_a_new_stream_goes_on_behind_the_store(spark, files, tmp_path):
    store = str(tmp_path / "store")
    assert push.first_batch(spark, store, "one") == 0
    push.incremental_index(files, store)(pushed(spark, [("r", "m", ["a"])]), 0)
    assert push.first_batch(spark, store, "one") == 0 and push.first_batch(spark, store, "two") == 1
    push.incremental_index(files, store, push.first_batch(spark, store, "two"))(pushed(spark, [("r", "m", ["b"])]), 0)
    assert state(spark, store) == [("a", "b0"), ("b", "b1")] and push.first_batch(spark, store, "two") == 1


def test_pushes_coalesce_with_their_files(spark):
    rows = [("r", "m", "b0", "c0", 0, 0, ["a"]), ("r", "m", "b1", "c1", 10, 1, ["b", "a"]), ("r", "m", "b2", "c2", 100, 2, ["z"]), ("r", "m", "b3", "c3", 105, 3, None)]
    d = spark.createDataFrame(rows, PUSHES).withColumn("ts", F.timestamp_seconds("t"))
    got = push.coalesced(d).orderBy("first_ts").collect()
    assert [(r["before_commit"], r["after_commit"], r["pushes"], r["changed_files"]) for r in got] == [("b0", "c1", 2, ["a", "b"]), ("b2", "c3", 2, None)]


def test_late_pushes(spark, files, tmp_path):
    schema = spark.createDataFrame([], PUSHES).withColumn("ts", F.timestamp_seconds("t")).schema
    store = str(tmp_path / "store")
    batches = [[("r", "m", "b", "c0", 1000, 0, ["a"])], [("r", "m", "b", "c1", 9000, 1, ["b"])], [("r", "m", "b", "c2", 1010, 2, ["c"]), ("end", "end", "b", "c3", 99_000, 3, [])]]
    for rows in batches:
        spark.createDataFrame(rows, PUSHES).withColumn("ts", F.timestamp_seconds("t")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        push.index_pushes(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), files, store, f"{tmp_path}/checkpoint").awaitTermination()
    assert [f for f, _ in state(spark, store)] == ["a", "b"]  # c came after the watermark had passed
