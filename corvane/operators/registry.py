"""Repositories, users, branches: visibility, availability, resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Branch states from most to least urgent (fixed values).
STATUS_PRIORITY = ["INDEXING", "PENDING", "FAILED", "INDEXED"]


#: Users of a set of hides that a repository meets at a time.
GROUP_USERS = 8192
#: Slices of the repositories for each part of the session: with few sets, groups and slices, hashed to parts, would crowd in some.
SLICES = 4
#: Tasks for each part of the session that list what users see.
TASKS = 2
#: Users of a set of hides that meet one copy of its list, at least; more where there would be more copies than parts.
SHARE_USERS = 256


def _by_set(rows: DataFrame) -> DataFrame:
    """Rows with the set of hides they go by: the column `hides`, or else the user."""
    return rows if "hides" in rows.columns else rows.withColumn("hides", F.col("user_id"))


def _dealt(rows: DataFrame, *columns: str, times: int = 1) -> DataFrame:
    """Rows dealt to as many parts as the session shuffles into (or so many times that), however small they are: what they are joined to is larger than they show."""
    return rows.repartition(times * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def _each(n) -> Column:
    """A row for each number below n."""
    return F.explode(F.sequence(F.lit(0), n - 1))


def _copied(rows: DataFrame, copies: DataFrame, on: list[str]) -> DataFrame:
    """Rows once for each row of copies with their key. Sorted, copies stream past a row, so one is made at a time; exploded, or streamed past broadcast copies, all of a row's would be held together."""
    return copies.join(rows.hint("merge"), on)


def visible(repositories: DataFrame, users: DataFrame, grants: DataFrame, hidden: DataFrame, branches: DataFrame) -> DataFrame:
    """JOI-02: repositories that each user sees: public or granted, not hidden, with sorted branches. This lists every public repository for every user asked for; `visibility` and `sees` don't.

    hidden: user_id, repository_id; or hides, repository_id, where users (user_id, hides) that hide the same share a set.
    What a set's users see of the public ones is found once for the set, in slices that meet its users in groups of some
    GROUP_USERS; the pairs are never shuffled, and a task holds those of one repository and one group at a time.
    """
    users, hidden = _by_set(users).select("user_id", "hides").distinct(), _by_set(hidden).select("hides", "repository_id")
    listed = branches.groupBy("repository_id").agg(F.array_sort(F.collect_set("branch")).alias("branches"))
    known = repositories.join(listed, "repository_id", "left").select("repository_id", "added_at", F.coalesce("is_private", F.lit(True)).alias("is_private"), F.coalesce("branches", F.array().cast("array<string>")).alias("branches"))
    slices = SLICES * int(repositories.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = users.groupBy("hides").agg(F.ceil(F.count("*") / GROUP_USERS).cast("int").alias("groups"))
    shown = known.where("not is_private").crossJoin(sets).join(hidden, ["hides", "repository_id"], "left_anti")
    shown = shown.withColumns({"group": _each(F.col("groups")), "slice": F.pmod(F.xxhash64("repository_id"), F.lit(slices)).cast("int")})
    groups = users.join(sets, "hides").groupBy("hides", F.pmod(F.xxhash64("user_id"), F.col("groups")).cast("int").alias("group")).agg(F.flatten(F.collect_list(F.array("user_id"))).alias("askers"))  # bare, a null would be left out
    askers = _copied(groups, sets.select("hides", _each(F.col("groups")).alias("group")).withColumn("slice", _each(F.lit(slices))), ["hides", "group"])
    key = ["hides", "group", "slice"]
    met = _dealt(shown, *key, times=TASKS).join(_dealt(askers, *key, times=TASKS).hint("merge"), key)  # as in _copied
    public = met.withColumn("user_id", F.explode("askers"))
    granted = grants.select("user_id", "repository_id").distinct().join(users, "user_id").join(hidden, ["hides", "repository_id"], "left_anti").join(known.where("is_private"), "repository_id")
    columns = ["user_id", "repository_id", "added_at", "branches"]
    return public.select(*columns).unionByName(granted.select(*columns))


def visibility(repositories: DataFrame, users: DataFrame, grants: DataFrame, hidden: DataFrame) -> DataFrame:
    """JOI-02: what tells a user's repositories from the public ones, a row a user: private ones granted and not hidden, and public ones hidden, both sorted.

    users and hidden as in `visible`. A set's list of hidden ones is made once and joined to its users, SHARE_USERS or more
    of them to a copy, so what is shuffled has the size of grants and sets; only the rows of the result hold a list a user.
    A task makes a copy, and a row of the result, at a time.
    """
    users, hidden = _by_set(users).select("user_id", "hides").distinct(), _by_set(hidden).select("hides", "repository_id").distinct()
    known = repositories.select("repository_id", "is_private")
    own = grants.select("user_id", "repository_id").join(known.where("is_private"), "repository_id", "left_semi").distinct().join(users, "user_id")
    private = own.join(hidden, ["hides", "repository_id"], "left_anti").groupBy("user_id").agg(F.sort_array(F.collect_list("repository_id")).alias("granted"))
    sizes = users.groupBy("hides").agg(F.count("*").alias("n"))
    share = F.greatest(F.lit(SHARE_USERS), F.sum("n") / int(users.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sets = sizes.crossJoin(F.broadcast(sizes.agg(share.alias("share")))).select("hides", F.ceil(F.col("n") / F.col("share")).cast("int").alias("copies"))  # share is one row
    lists = hidden.join(known.where(~F.col("is_private")), "repository_id").groupBy("hides").agg(F.sort_array(F.collect_list("repository_id")).alias("hidden"))
    away = _copied(lists, sets.select("hides", _each(F.col("copies")).alias("copy")), ["hides"])
    asked = users.join(private, "user_id", "left").join(sets, "hides", "left").withColumn("copy", F.pmod(F.xxhash64("user_id"), F.coalesce("copies", F.lit(1))).cast("int"))
    none = F.array().cast("array<string>")
    met = _dealt(asked, "hides", "copy").join(_dealt(away, "hides", "copy"), ["hides", "copy"], "left")
    return met.select("user_id", F.coalesce("granted", none).alias("granted"), F.coalesce("hidden", none).alias("hidden"))


def sees(pairs: DataFrame, repositories: DataFrame, grants: DataFrame, hidden: DataFrame) -> DataFrame:
    """JOI-02: those of the pairs (user_id, repository_id, and any other columns) whose user sees the repository. hidden as in `visible`, where pairs have `hides`, which is left out of the result."""
    columns = [c for c in pairs.columns if c != "hides"]
    named = _by_set(pairs).join(repositories.select("repository_id", "is_private"), "repository_id").join(_by_set(hidden).select("hides", "repository_id"), ["hides", "repository_id"], "left_anti")
    granted = grants.select("user_id", "repository_id", F.lit(True).alias("granted")).distinct()
    return named.join(granted, ["user_id", "repository_id"], "left").where(~F.col("is_private") | F.col("granted")).select(*columns)


def branch_available(requests: DataFrame, chunks: DataFrame, pointers: DataFrame) -> DataFrame:
    """JOI-03: may a branch be searched: its repository has no data, or the branch is in chunks or pointers."""
    have = chunks.select("repository_id", "branch").union(pointers.select("repository_id", "branch")).distinct()
    with_data = have.select("repository_id").distinct().withColumn("has_data", F.lit(True))
    exact = have.withColumn("has_branch", F.lit(True))
    joined = requests.join(with_data, "repository_id", "left").join(exact, ["repository_id", "branch"], "left")
    return joined.select(*requests.columns, (F.col("has_data").isNull() | F.col("has_branch").isNotNull()).alias("available"))


def indexed_branches(chunks: DataFrame, pointers: DataFrame) -> DataFrame:
    """JOI-03: branches from pointers, or from chunks for repositories without any."""
    named = pointers.select("repository_id", "branch").distinct()
    rest = chunks.select("repository_id", "branch").distinct().join(named.select("repository_id").distinct(), "repository_id", "left_anti")
    return named.unionByName(rest)


def resolved(requests: DataFrame, repositories: DataFrame) -> DataFrame:
    """JOI-04: repository of a name or external id; unknown ones become null, which filters nothing."""
    known = repositories.select(F.col("repository_id").alias("resolved_id"), F.explode(F.array_distinct(F.array(F.col("repository_id"), F.col("external_id").cast("string")))).alias("reference"))
    return requests.join(known, "reference", "left")


def in_repository(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """JOI-04: those of the rows found for requests (query_id, repository_id, ...) that lie in the request's repository; a request without one keeps all that it found."""
    scope = requests.select("query_id", "resolved_id")
    return rows.join(scope, "query_id").where(F.col("resolved_id").isNull() | (F.col("resolved_id") == F.col("repository_id"))).select(*rows.columns)


def scope_sizes(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """JOI-04: how many rows each request may search: its repository's, or all without one. Rows are counted once a repository; requests meet the counts."""
    counts = rows.groupBy("repository_id").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("all"))  # one row
    met = requests.join(counts, F.col("resolved_id") == F.col("repository_id"), "left").crossJoin(F.broadcast(total))
    return met.groupBy("query_id").agg(F.sum(F.when(F.col("resolved_id").isNull(), F.col("all")).otherwise(F.col("n"))).alias("n")).where("n > 0")


def index_status(branches: DataFrame) -> DataFrame:
    """WIK-08: the most urgent status of a repository's branches; an unknown one only if there is no other."""
    place = F.array_position(F.array(*map(F.lit, STATUS_PRIORITY)), F.upper("status"))
    order: Column = F.when(place == 0, len(STATUS_PRIORITY) + 1).otherwise(place)
    return branches.groupBy("repository_id").agg(F.min_by(F.upper("status"), F.struct(order, F.col("branch"))).alias("index_status"))


def requested_minus_indexed(requested: DataFrame, indexed: DataFrame) -> DataFrame:
    """SET-02: requested branches that aren't indexed yet, in their order."""
    return requested.join(indexed.select("repository_id", "branch"), ["repository_id", "branch"], "left_anti")


def first_rows(rows: DataFrame, key: str, n: int | None) -> DataFrame:
    """SRC-10: the first n rows by key, all without n. Each task keeps n rows before any are moved."""
    return rows if n is None else rows.orderBy(key).limit(n)


def slice_by_ids(rows: DataFrame, ids: list, key: str) -> DataFrame:
    """SRC-10: rows of the requested ids in the order of the request; unknown ids are an error."""
    spark = rows.sparkSession
    asked = spark.createDataFrame([(v, i) for i, v in enumerate(ids)], [key, "position"]).select(F.col(key).cast(dict(rows.dtypes)[key]).alias(key), "position")
    joined = asked.join(rows.withColumn("known", F.lit(True)), key, "left")
    check = F.when(F.col("known").isNull(), F.raise_error(F.concat(F.lit("unknown id "), F.col(key).cast("string"))).cast("long")).otherwise(F.col("position"))
    return joined.withColumn("position", check).drop("known")
