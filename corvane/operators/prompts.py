"""FLT-10: prompts from tasks and their ranked snippets of code, wiki pages or both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands above the snippets of each kind, and in their place when there are none.
KINDS = {"code": ("Code found:", "(no code found)"), "wiki": ("Pages found:", "(no pages found)"), "fused": ("Code and pages found:", "(nothing found)")}


def code_block(place: Column) -> Column:
    """A snippet of code with its file and lines, and why it was taken where that is known."""
    reason = F.when(F.trim(F.col("reason")) != "", F.concat(F.lit("reason: "), F.trim(F.col("reason"))))
    head = F.concat(F.lit("["), place.cast("string"), F.lit("] "), F.col("file_path"), F.lit(" lines "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    return F.concat_ws("\n", head, reason, F.rtrim(F.regexp_replace("content", r"\s+\z", "")))


def wiki_block(place: Column) -> Column:
    """A page with its title and section."""
    section = F.when(F.col("section_path") != "", F.concat(F.lit(" in "), F.col("section_path")))
    head = F.concat(F.lit("["), place.cast("string"), F.lit("] "), F.col("title"), F.coalesce(section, F.lit("")))
    return F.concat_ws("\n", head, F.regexp_replace("content", r"\s+\z", ""))


def prompts(tasks: DataFrame, snippets: DataFrame, kind: str) -> DataFrame:
    """tasks (query_id, head, tail and others) with a prompt: the head, the snippets by rank, the tail, with blank lines between.

    snippets: query_id, rank, content, reason, and by kind file_path, start_line, end_line or title, section_path; for
    `fused` all of them with corpus, code or wiki. A task has as many snippets as a search gives it at most; they are
    numbered as they come. Null heads and tails are left out.
    """
    above, none = KINDS[kind]
    shape = {"code": code_block, "wiki": wiki_block, "fused": lambda p: F.when(F.col("corpus") == "wiki", wiki_block(p)).otherwise(code_block(p))}[kind](F.lit("#"))
    listed = snippets.select("query_id", "rank", shape.alias("block")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("list"))
    body = F.array_join(F.transform("list", lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.substr(s["block"], F.lit(3)))), "\n\n")
    found = tasks.join(listed.select("query_id", body.alias("body")), "query_id", "left")
    return found.withColumn("prompt", F.concat_ws("\n\n", "head", F.concat(F.lit(above + "\n"), F.coalesce("body", F.lit(none))), "tail")).drop("body")
