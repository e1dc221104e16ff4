"""Visibility by sets of hides (JOI-02): what is shuffled grows with users, repositories and grants, not with their product."""

import pytest
from pyspark.sql import functions as F

from corvane.operators import registry

USERS, REPOS = 600, 900


@pytest.fixture(scope="module")
def tables(spark):
    repos = spark.range(REPOS).select(F.col("id").cast("string").alias("repository_id"), (F.col("id") % 3 == 0).alias("is_private"), F.col("id").alias("added_at"))
    users = spark.range(USERS).select(F.col("id").alias("user_id"), (F.col("id") % 2).alias("hides"))
    grants = spark.range(2 * USERS).select((F.col("id") % USERS).alias("user_id"), (F.col("id") * 3 % REPOS).cast("string").alias("repository_id"))
    hidden = spark.range(0, REPOS, 4).select(F.lit(1).cast("long").alias("hides"), F.col("id").cast("string").alias("repository_id"))
    return repos, users, grants, hidden


def apart(tables):
    """The same, each user with hides of its own."""
    repos, users, grants, hidden = tables
    return repos, users.select("user_id"), grants, users.join(hidden, "hides").select("user_id", "repository_id")


def shuffled(spark, rows) -> int:
    """Rows that a query's exchanges write."""
    rows._jdf.queryExecution().executedPlan()
    rows.write.format("noop").mode("overwrite").save()
    total, plan = 0, [rows._jdf.queryExecution().executedPlan()]
    rows.collect()
    while plan:
        p = plan.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            plan.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            plan.append(p.plan())
        else:
            if name == "ShuffleExchangeExec":
                total += p.metrics().apply("shuffleRecordsWritten").value()
            plan += [p.children().apply(i) for i in range(p.children().size())]
    return total


def values(rows):
    return sorted(tuple(map(str, r)) for r in rows.collect())


def test_lists_of_hides_are_made_once_a_set(spark, tables):
    got = registry.visibility(*tables)
    assert values(got) == values(registry.visibility(*apart(tables))) and got.count() == USERS
    assert shuffled(spark, got) < 10 * (USERS + REPOS)


def test_pairs_seen_are_not_shuffled(spark, tables):
    branches = spark.createDataFrame([("1", "b"), ("1", "a")], "repository_id string, branch string")
    got = registry.visible(*tables, branches)
    assert values(got) == values(registry.visible(*apart(tables), branches)) and got.count() > USERS * REPOS / 2
    assert shuffled(spark, got) < 10 * (USERS + REPOS)


def test_pairs_asked_for_meet_sets(spark, tables):
    repos, users, grants, hidden = tables
    pairs = users.withColumn("repository_id", (F.col("user_id") * 7 % REPOS).cast("string"))
    got = registry.sees(pairs, repos, grants, hidden)
    assert got.columns == ["user_id", "repository_id"]
    assert values(got) == values(registry.sees(pairs.drop("hides"), *apart(tables)[:1], *apart(tables)[2:]))
    assert shuffled(spark, got) < 10 * (USERS + REPOS)


def test_pairs_are_listed_by_even_tasks(spark, tables):
    """Few sets and blocks, hashed to the session's few parts, crowd in some; the largest task then holds the others up."""
    got = registry.visible(*tables, spark.createDataFrame([("1", "b")], "repository_id string, branch string"))
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= sum(sizes) / 2


def test_users_meet_repositories_in_groups(spark, tables, monkeypatch):
    """Users travel to each slice of the repositories as groups, not one by one; a set of many users is split, so a task holds few pairs at a time."""
    repos, _, _, hidden = tables
    branches = spark.createDataFrame([("1", "b")], "repository_id string, branch string")
    some = repos.where("added_at < 30")
    many = spark.range(20_000).select(F.col("id").alias("user_id"), (F.col("id") % 2).alias("hides"))
    none = spark.createDataFrame([], "user_id long, repository_id string")
    assert shuffled(spark, registry.visible(some, many, none, hidden, branches)) < 3 * 20_000
    got = registry.visible(*tables, branches)
    want = values(got)
    monkeypatch.setattr(registry, "GROUP_USERS", 50)
    assert values(registry.visible(*tables, branches)) == want


def test_a_null_user_sees_what_its_set_shows(spark, tables):
    repos, _, grants, hidden = tables
    users = spark.createDataFrame([(None, 1), (2, 1)], "user_id long, hides long")
    got = registry.visible(repos, users, grants.limit(0), hidden, spark.createDataFrame([], "repository_id string, branch string"))
    assert {r["user_id"]: r["count"] for r in got.groupBy("user_id").count().collect()} == {None: 450, 2: 450}


def nodes(rows):
    """The plan's operators, once it has run."""
    rows.collect()
    found, plan = [], [rows._jdf.queryExecution().executedPlan()]
    while plan:
        p = plan.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            plan.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            plan.append(p.plan())
        else:
            found.append((name, p))
            plan += [p.children().apply(i) for i in range(p.children().size())]
    return found


def with_lists(rows, kind: str) -> list:
    return [p for name, p in nodes(rows) if name == kind and "hidden#" in p.output().mkString(",")]


def test_lists_are_copied_one_at_a_time(tables):
    """An explode makes all copies of its row before any is handed on, so it must not carry a list; nor may few copies be broadcast to the lists."""
    repos, users, grants, hidden = tables
    got = registry.visibility(repos, users, grants, hidden.withColumn("hides", F.col("repository_id").cast("long") % 4 + 1))  # a literal set would need no key to join by
    assert not with_lists(got, "GenerateExec")
    assert len(with_lists(got, "SortMergeJoinExec")) >= 1


def test_lists_have_no_more_copies_than_parts(tables, monkeypatch):
    want = values(registry.visibility(*tables))
    monkeypatch.setattr(registry, "SHARE_USERS", 1)
    got = registry.visibility(*tables)
    assert values(got) == want
    rows = sum(p.metrics().apply("shuffleRecordsWritten").value() for p in with_lists(got, "ShuffleExchangeExec"))
    assert 0 < rows <= 2 * 4
