"""Repair of conversation structure: the cheapest edits that make roles an optional system turn and pairs of user, assistant.

A turn's signature is its role's initial and its first fault: blank (no character but white space), duplicate (role and
text seen earlier in the conversation), truncated (the last character other than white space ends no sentence). Keeping a
turn costs 0, another role 3, deleting it 4 (a must for blank and duplicate turns), an empty turn put in 3, and a truncated
turn that stays 3 more. Of equally cheap edits the audit, their initials in order, is the least in ASCII.

Costs depend on the signatures from a turn on and on the grammar's state, nothing else. So the distinct signatures of all
conversations are sorted by their reverse, which makes them the paths of an automaton that shares suffixes: a node, all
equal suffixes, is built once, with the cost to go and the best edit of each state; with its child's it is the best audit
from there on. Edits of a state have different initials, so ties are settled where they arise. Only the path of the
first signature of a range is built again by a task. Conversations then look their signature's audit up: signatures that
many conversations share are few, and broadcast; the others are joined.

Turns are taken by number, nulls first; ties by role, then by a hash of the text. A null role or text counts as a space,
rows without conv_id are one conversation. Texts are compared by 128 bits of hashes. The role's first character counts;
one that is none of s, u, a fits nowhere. Equal rows are duplicates. An empty table gives no rows. A conversation's turns, sorted, pass
through one task, as they make up one row of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import checkpointed

#: The last character that is not white space.
LAST = r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z"
ROLES = {"s": "system", "u": "user", "a": "assistant"}
#: Signatures that this share of the conversations have are at most as many; with the longest that is broadcast, they take some MB.
COMMON, LONGEST = 512, 4096
# The grammar: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; NEXT has the state after each role.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FITS = ("u", "u", "a", "u")
NEVER = 1 << 60

Node = tuple[tuple[int, ...], str]


def _inserted(best: list[tuple[int, str]]) -> Node:
    """Puts turns in where that is cheaper, or as cheap and less in ASCII."""
    for _ in range(3):  # from state 0 or 1 over 2 to 3, or back
        best = [min(own, (best[NEXT[q][FITS[q]]][0] + 3, "I")) for q, own in enumerate(best)]
    return tuple(c for c, _ in best), "".join(e for _, e in best)


#: After the last turn: nothing is left to do in states 0 and 3.
END = _inserted([(0, "."), (NEVER, "."), (NEVER, "."), (0, ".")])


def node(symbol: str, child: Node) -> Node:
    """Cost to go and best edit of each state before a turn with this signature. Signatures: s, u, a, o (other), in capitals when truncated, x when the turn must go."""
    best, more, role = [], 3 * symbol.isupper(), symbol.lower()
    for q in range(4):
        ways = [(4 + child[0][q], "D")]
        if symbol != "x":
            ways.append((3 + more + child[0][NEXT[q][FITS[q]]], "R"))
            if role in NEXT[q]:
                ways.append((more + child[0][NEXT[q][role]], "K"))
        best.append(min(ways))
    return _inserted(best)


def audit(signature: str, path: list[Node]) -> str:
    """The best edits from the start; path has the nodes from the end of the signature, the first after its last turn."""
    edits, q, at = [], 0, 0
    while (edit := path[len(signature) - at][1][q]) != ".":
        edits.append(edit)
        if edit == "K":
            q = NEXT[q][signature[at].lower()]
        elif edit != "D":
            q = NEXT[q][FITS[q]]
        at += edit != "I"
    return "".join(edits)


def solve(signatures: DataFrame) -> DataFrame:
    """signatures: distinct signature, and what else is to be kept. Adds cost and audit; a node of the shared suffixes is built once in each range of reversed signatures."""

    columns = signatures.columns

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, path = "", [END]
        for batch in batches:
            own, costs, audits = batch.column("signature").to_pylist(), [], []
            for signature in own:
                backwards = signature[::-1]
                same = 0
                while same < min(len(last), len(backwards)) and last[same] == backwards[same]:
                    same += 1
                del path[same + 1 :]
                for symbol in backwards[same:]:
                    path.append(node(symbol, path[-1]))
                last = backwards
                costs.append(path[-1][0][0])
                audits.append(audit(signature, path))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(costs, pa.int64()), pa.array(audits, pa.string())], names=[*columns, "cost", "audit"])

    backwards = F.reverse("signature")
    ordered = signatures.repartitionByRange(backwards).sortWithinPartitions(backwards)
    return ordered.mapInArrow(solved, "".join(f"{f.name} {f.dataType.simpleString()}, " for f in signatures.schema) + "cost long, audit string")


def _hashes(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def faults(turns: DataFrame) -> DataFrame:
    """turns: conv_id, turn, role, text, none of role and text null. A row a conversation: conv_id, signature, gaps, blank, duplicate, truncated, illegal."""
    last = F.regexp_extract("text", LAST, 1)
    first, second = _hashes(F.col("text"))
    rows = turns.select("conv_id", "turn", "role", first.alias("h1"), second.alias("h2"), last.alias("last"))
    in_order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "h1", "h2")
    rows = rows.withColumn("at", F.row_number().over(in_order)).withColumn("before", F.lag("role").over(in_order)).withColumn("new", F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(in_order)))
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "h1", "h2").orderBy("at")) > 1
    rows = rows.withColumn("fault", F.when(F.col("last") == "", "blank").when(again, "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated"))
    initial = F.substring("role", 1, 1)
    pair = F.concat(F.substring("before", 1, 1), initial)  # null for the first turn
    role = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(role)).otherwise(role)
    count = lambda c: F.count_if(c).alias
    return rows.withColumn("symbol", symbol).groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "symbol"))), lambda x: x["symbol"]), "").alias("signature"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_if("new"), F.lit(0)).cast("long").alias("gaps"),
        count(F.col("fault") == "blank")("blank"), count(F.col("fault") == "duplicate")("duplicate"), count(F.col("fault") == "truncated")("truncated"),
        count(~pair.isin("su", "ua", "au"))("illegal"),
    )


def audited(found: DataFrame) -> DataFrame:
    """found: rows with signature. Adds cost and audit, solved once a signature."""
    counted = found.groupBy("signature").agg(F.count("*").alias("n"))
    solved = checkpointed(solve(counted))
    total = solved.agg(F.sum("n")).first()[0] or 0
    common = (F.col("n") * COMMON >= total) & (F.length("signature") <= LONGEST)
    named = lambda d, p: d.select("signature", F.struct("cost", "audit").alias(p))
    rows = found.join(F.broadcast(named(solved.where(common), "~c")), "signature", "left")  # at most COMMON rows of LONGEST turns
    # rows that have found theirs are spread by their id and match nothing more
    rows = rows.withColumn("~k", F.when(F.col("~c").isNull(), F.col("signature"))).withColumn("~s", F.when(F.col("~c").isNotNull(), F.xxhash64("conv_id")).otherwise(0))
    rest = named(solved.where(~common), "~r").select(F.col("signature").alias("~k"), F.lit(0).cast("long").alias("~s"), "~r")
    best = F.coalesce("~c", "~r")
    return rows.join(rest, ["~k", "~s"], "left").select(*found.columns, best["cost"].alias("cost"), best["audit"].alias("audit"))


def repaired(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """audits: conv_id, audit. conv_id and turns array<struct<role, text, edit>>, the conversation as repaired, without what was deleted."""
    first, second = _hashes(F.col("text"))
    lines = turns.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", first.alias("h1"), second.alias("h2"))
    heads = audits.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"))
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]))

    def put_right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, out, size, edits, q = [], [], 0, iter(()), 0

        def add(edit: str, role: str, text: str) -> None:
            nonlocal q, size
            q = NEXT[q][role[0]]
            out[-1].append({"role": role, "text": text, "edit": edit})
            size += len(text) + 40

        def step(role: str | None, text: str) -> None:
            """The edits up to the one that takes this turn; all that are left when there is none."""
            for edit in edits:
                fitting = ROLES[FITS[q]]
                if edit == "I":
                    add("insert", fitting, "")
                    continue
                if edit == "K":
                    add("keep", role, text)
                elif edit == "R":
                    add("rerole", fitting, text)
                return

        for batch in batches:
            for conv, k, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text")), strict=True):
                if k:
                    step(role, text)
                    continue
                if ids:
                    step(None, "")
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("conv_id").type), pa.array(out, kind)], names=["conv_id", "turns"])
                    ids, out, size = [], [], 0
                ids.append(conv)
                out.append([])
                edits, q = iter(text), 0
        if ids:
            step(None, "")
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("conv_id").type), pa.array(out, kind)], names=["conv_id", "turns"])

    dealt = lines.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "h1", "h2")
    id_type = turns.schema["conv_id"].dataType.simpleString()
    return dealt.select("conv_id", "kind", "role", "text").mapInArrow(put_right, f"conv_id {id_type}, turns array<struct<role: string, text: string, edit: string>>")


def filled(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text, null roles and texts being a space."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    return conversations.select("conv_id", "turn", space("role"), space("text"))


def repair(conversations: DataFrame) -> DataFrame:
    """A row a conversation: conv_id, signature, gaps, blank, duplicate, truncated, illegal, cost, audit, and the repaired turns array<struct<role, text, edit>>."""
    rows = filled(conversations)
    summary = audited(checkpointed(faults(rows)))
    turns = repaired(rows, summary.select("conv_id", "audit")).withColumnRenamed("conv_id", "~id")
    return summary.join(turns, F.col("conv_id").eqNullSafe(F.col("~id"))).drop("~id")


def damaged(conversations: DataFrame) -> DataFrame:
    """Every row, by crc32 of conv_id:turn: dropped, emptied, without sentence ends, repeated, made the user's, or as it is."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = filled(conversations).withColumn("~h", F.crc32(key.cast("binary")) % 20).where("`~h` <> 0")
    h = F.col("~h")
    text = F.when(h == 1, "").when(h == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(h == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(h == 3, 2).otherwise(1))))
    return rows.drop("col")


def op11(spark, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    fixed = repair(damaged(conversations))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    digests = fixed.select(F.col("conv_id").alias("~id"), *counts, "audit", F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))
    every = conversations.select("conv_id").distinct()
    whole = every.join(digests, F.col("conv_id").eqNullSafe(F.col("~id")), "left")
    return whole.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
