"""Cleaning of chat data for supervised fine-tuning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Role names and what they mean (fixed values).
ROLES = {"user": "user", "human": "user", "assistant": "assistant", "gpt": "assistant", "model": "assistant", "system": "system"}


def role_of(role: Column) -> Column:
    """CHT-01: user, assistant or system; null for other roles."""
    return F.try_element_at(F.create_map(*[F.lit(x) for p in ROLES.items() for x in p]), F.lower(role))


def flat_content(content: Column) -> Column:
    """CHT-02: text of a string, of an object's text or content, or of a list of these, joined by newlines. Plain text is trimmed."""
    json = F.try_parse_json(content)
    part = lambda v: F.coalesce(F.try_variant_get(v, "$.text", "string"), F.try_variant_get(v, "$.content", "string"))
    text_list = F.from_json(content, "array<string>")
    parts = F.transform(text_list, lambda x: F.trim(F.coalesce(F.get_json_object(x, "$.text"), F.get_json_object(x, "$.content"), x)))
    joined = F.array_join(F.filter(parts, lambda x: x != ""), "\n")
    is_object, is_list = F.ltrim(content).startswith("{"), F.ltrim(content).startswith("[")
    return F.trim(F.when(is_object & json.isNotNull(), F.coalesce(part(json), content)).when(is_list & json.isNotNull(), joined).otherwise(content))


def clean_messages(messages: DataFrame) -> DataFrame:
    """CHT-03: conversations (conv_id, turn, role, text) with merged, alternating messages that begin with the user and end with the assistant: conv_id, place, role, content.

    A conversation's messages meet in one task; conversations are short.
    """
    d = messages.select("conv_id", "turn", role_of(F.col("role")).alias("role"), flat_content(F.col("text")).alias("text")).where("role in ('user', 'assistant') and text <> ''")
    by_turn = Window.partitionBy("conv_id").orderBy("turn")
    d = d.withColumn("new", F.coalesce((F.lag("role").over(by_turn) != F.col("role")).cast("int"), F.lit(1)))
    d = d.withColumn("place", F.sum("new").over(by_turn.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    merged = d.groupBy("conv_id", "place", "role").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n").alias("content"))
    whole = Window.partitionBy("conv_id")
    ends = merged.withColumns({"first_role": F.min(F.when(F.col("place") == 0, F.col("role"))).over(whole), "last": F.max("place").over(whole)})
    # roles alternate once runs are merged, so even length means that the last is the assistant's
    kept = F.col("last") - (F.col("last") % 2 == 0).cast("int")
    return ends.where((F.col("first_role") == "user") & (kept >= 1) & (F.col("place") <= kept)).select("conv_id", F.col("place").cast("int").alias("place"), "role", "content")


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """CHT-04: n rows in a seeded order. `sample_counts` tells how many that keeps and skips."""
    return rows.withColumn("draw", F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))).orderBy("draw", key).limit(n)


def sample_counts(rows: DataFrame, cleaned: DataFrame, key: str, n: int) -> DataFrame:
    """CHT-04: rows kept by a sample of n of the cleaned ones, and skipped by cleaning."""
    total = rows.agg(F.countDistinct(key).alias("total")).crossJoin(cleaned.agg(F.countDistinct(key).alias("clean")))  # one row each
    return total.select(F.least("clean", F.lit(n)).alias("kept"), (F.col("total") - F.col("clean")).alias("skipped"))
