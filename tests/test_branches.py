"""Branch states in batch and in streams against events taken one by one."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from corvane.operators import numbering, versioning
from corvane.streaming import push

SCHEMA = "repository_id string, branch string, status string, latest_commit string, target_commit string, t long"
COLUMNS = ["repository_id", "branch", "status", "target_commit", "last_commit", "indexed_at", "ignored"]


def one_by_one(events):
    """By the rules: a report of an end for another commit than the target's changes nothing; one for it clears the target."""
    states = {}
    for repo, branch, status, latest, target, t in sorted(events, key=lambda e: (e[5], *((x is not None, x) for x in e[2:5]))):
        s = states.setdefault((repo, branch), {"status": "pending", "target": None, "last": None, "at": None, "ignored": 0})
        aim = s["target"] if target is None else target
        guard = (status == "indexed" and aim is not None) or (status == "failed" and aim not in (None, ""))
        if guard and latest is not None and latest != aim:
            s["ignored"] += 1
            continue
        s["status"], s["target"] = status, aim
        if latest is not None and not (status == "indexed" and aim is not None and latest != aim):
            s["last"] = latest
        if status == "indexed":
            s["at"] = t
            if latest is not None and latest == aim:
                s["target"] = None
    return sorted((*k, s["status"], s["target"], s["last"], s["at"], s["ignored"]) for k, s in states.items())


def made(seed, n, ts=100_000):
    rng = random.Random(seed)
    commits = ["a", "b", "c", "", None, None]
    return [(f"r{rng.randrange(3)}", rng.choice("mn"), rng.choice(["pending", "indexing", "indexed", "indexed", "failed"]), rng.choice(commits), rng.choice([None, None, *commits]), rng.randrange(ts)) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("t")).drop("t")


def values(d):
    rows = d.withColumn("indexed_at", F.unix_seconds("indexed_at")).select(*COLUMNS).collect()
    return sorted((tuple(r) for r in rows), key=str)


@pytest.fixture(autouse=True)
def small_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("seed", range(4))
def test_states_of_a_batch(spark, seed):
    rows = made(seed, 400, 100_000 if seed else 60)
    assert values(versioning.branch_states(frame(spark, rows).repartition(5))) == sorted(one_by_one(rows), key=str)


def test_a_busy_branch_is_cut_into_ranges(spark):
    rows = [("r", "m", *e[2:]) for e in made(9, 3000)]
    d = frame(spark, rows)
    assert values(versioning.branch_states(d)) == sorted(one_by_one(rows), key=str)
    ranges = numbering.ranged(d.repartition(7), ["repository_id"], ["ts"])
    assert ranges.select("range__").distinct().count() > 1
    assert versioning.branch_states(d.where("false")).count() == 0


def test_last_known(spark):
    rng = random.Random(2)
    rows = [("ab"[rng.randrange(2)], i, rng.randrange(99) if rng.random() < 0.05 else None) for i in range(500)]
    d = numbering.ranged(spark.createDataFrame(rows, "k string, i int, v int"), ["k"], ["i"])
    for own in (True, False):
        want, last = [], {}
        for k, i, v in rows:
            before = last.get(k)
            last[k] = v if v is not None else before
            want.append((k, i, last[k] if own else before))
        assert sorted(map(tuple, numbering.last_known(d, ["k"], ["i"], F.col("v"), "w", own).select("k", "i", "w").collect())) == sorted(want)


@pytest.fixture
def streamed(spark, tmp_path):
    schema = frame(spark, made(0, 1)).schema

    def run(parts, **options):
        """Each part as a file of its own, the stream started anew for each from its checkpoint."""
        def keep(batch, batch_id):
            batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={batch_id}")

        for part in parts:
            frame(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            states = push.branch_state_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), **options)
            q = states.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
            q.awaitTermination()
        return spark.read.parquet(f"{tmp_path}/out")

    return run


def test_a_stream_goes_on_from_its_checkpoint(spark, streamed):
    rows = sorted(made(3, 240), key=lambda e: e[5])
    out = streamed([rows[:100], rows[100:130], rows[130:]])
    assert values(push.latest_states(out)) == sorted(one_by_one(rows), key=str)
    assert out.select("batch").distinct().count() == 3 and out.where("expired").count() == 0


def test_idle_branches_are_forgotten(spark, streamed):
    old = [("r", "m", "indexing", None, "a", 10), ("r", "m", "failed", "x", None, 15)]
    out = streamed([old, [("r", "n", "pending", None, "b", 900_000)], [("r", "n", "indexing", None, None, 900_100)], [("r", "m", "indexed", "z", None, 900_200)]], idle="2 days", late="1 minute")
    gone = out.where("expired").collect()
    assert [(r["branch"], r["status"], r["target_commit"], r["ignored"]) for r in gone] == [("m", "indexing", "a", 1)]
    assert push.latest_states(out).where("branch = 'm'").first()["last_commit"] == "z"  # its target was forgotten


@pytest.mark.parametrize("seed", range(3))
def test_a_branch_takes_rows_without_a_frame(seed):
    """A frame for each branch took some 20 ms."""
    class State:
        value = None
        exists = lambda self: self.value is not None
        get = lambda self: self.value

        def update(self, value):
            self.value = value

    rows = sorted((("r", "m", *e[2:]) for e in made(seed + 20, 90)), key=lambda e: e[5])
    row = lambda e: Row(repository_id=e[0], branch=e[1], ts=datetime(2024, 1, 1) + timedelta(seconds=e[5]), status=e[2], latest_commit=e[3], target_commit=e[4])
    states = push.BranchStates()
    states.state = State()
    for a in (0, 30, 60):
        (out,) = states.handleInputRows(("r", "m"), iter([row(e) for e in rows[a : a + 30]]), None)
    (want,) = one_by_one(rows)
    at = None if out["indexed_at"] is None else int((out["indexed_at"] - datetime(2024, 1, 1)).total_seconds())
    assert (out["repository_id"], out["branch"], out["status"], out["target_commit"], out["last_commit"], at, out["ignored"]) == want
