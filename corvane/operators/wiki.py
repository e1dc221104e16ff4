"""Preparation of the wiki corpus: outlines, page lists, page contexts, generations."""

from __future__ import annotations

from collections.abc import Iterator
from json import loads

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvane.operators.numbering import numbered

MAX_PATHS, MAX_SAMPLES, PAGE_CHUNKS = 500, 20, 15
NO_CONTEXT = "No code context available."


def block(path: Column, start: Column, end: Column, content: Column, language: Column | None = None) -> Column:
    return F.concat(F.lit("### "), path, F.lit(" (lines "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(")\n```"), F.coalesce(language, F.lit("")) if language is not None else F.lit(""), F.lit("\n"), content, F.lit("\n```"))


def outline(chunks: DataFrame, keys: list[str], paths: int = MAX_PATHS, samples: int = MAX_SAMPLES) -> DataFrame:
    """WIK-01: each branch's first file paths and first chunks, joined. Only rows within the caps are gathered."""
    w = Window.partitionBy(*keys)
    files = chunks.select(*keys, "file_path").distinct().withColumn("n", F.row_number().over(w.orderBy("file_path"))).where(F.col("n") <= paths)
    files = files.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("file_path")), "\n").alias("paths"))
    first = chunks.withColumn("n", F.row_number().over(w.orderBy("file_path", "start_line"))).where(F.col("n") <= samples)
    text = block(F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("content"))
    first = first.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", text.alias("t")))), lambda x: x["t"]), "\n\n").alias("sample"))
    return files.join(first, keys)


def pages_of(structures: DataFrame, json: str = "structure_json") -> DataFrame:
    """WIK-02: pages of nested sections, however deep, with the path of slugs. A structure is one row, so one task walks it."""
    ids = [c for c in structures.columns if c != json]
    schema = StructType([*structures.select(*ids).schema, *StructType.fromDDL("section_path string, slug string, title string, description string, source_file_hints array<string>")])
    text = lambda x: None if x is None else str(x)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, given in enumerate(batch.column(json).to_pylist()):
                todo = [(s, []) for s in reversed(_sections(given))]
                while todo:
                    section, above = todo.pop()
                    path = [*above, text(section.get("slug")) or ""]
                    for p in section.get("pages") or []:
                        at.append(i)
                        rows.append(("/".join(path), text(p.get("slug")), text(p.get("title")), text(p.get("description")) or "", [text(h) for h in p.get("source_file_hints") or []]))
                    todo += [(s, path) for s in reversed(section.get("subsections") or [])]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.string()] * 4 + [pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at, pa.int64())) for c in ids), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], names=schema.names)

    return structures.mapInArrow(walked, schema)


def _sections(structure: str | None) -> list[dict]:
    """Sections of a structure's JSON; none if it isn't one."""
    try:
        found = loads(structure or "{}")
    except ValueError:
        return []
    return [s for s in found.get("sections") or [] if isinstance(s, dict)] if isinstance(found, dict) else []


def staged_pages(pages: DataFrame, batch: Column, order: list[str]) -> DataFrame:
    """WIK-03: an empty row for each page, numbered in its batch, hints as JSON."""
    placed = numbered(pages.withColumn("batch_id", batch), ["batch_id"], order, "seq_index")
    return placed.withColumns({"content": F.lit(""), "source_files": F.to_json("source_file_hints")}).drop("source_file_hints")


def page_contexts(pages: DataFrame, hits: DataFrame) -> DataFrame:
    """WIK-04: each page's chunks, best first, as one text. pages: query_id; hits: query_id, rank, file_path, start_line, end_line, content, language. At most PAGE_CHUNKS a page are gathered."""
    text = block(F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("content"), F.col("language"))
    gathered = hits.where(F.col("rank") <= PAGE_CHUNKS).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))), lambda x: x["t"]), "\n\n").alias("context"))
    return pages.join(gathered, "query_id", "left").withColumn("context", F.coalesce("context", F.lit(NO_CONTEXT)))


def fill_content(staged: DataFrame, content: DataFrame, page: str = "slug") -> DataFrame:
    """WIK-05: generated content by batch and the column that tells its pages apart; pages without any keep theirs."""
    new = content.select("batch_id", page, F.col("content").alias("new"))
    return staged.join(new, ["batch_id", page], "left").withColumn("content", F.coalesce("new", "content")).drop("new")


def latest_generation(generations: DataFrame, completed: bool = False) -> DataFrame:
    """WIK-06 and WIK-07: newest generation (of completed ones) of each branch."""
    rows = generations.where("status = 'completed'") if completed else generations
    return rows.groupBy("repository_id", "branch").agg(F.max_by(F.struct("generation_id", "status"), F.struct("created_at", "generation_id")).alias("g")).select("repository_id", "branch", "g.generation_id", "g.status")


def latest_pages(generations: DataFrame, pages: DataFrame) -> DataFrame:
    """WIK-07: pages of the newest completed generation, numbered by section and slug."""
    own = latest_generation(generations, completed=True).join(pages, "generation_id")
    return own.withColumn("position", F.row_number().over(Window.partitionBy("repository_id", "branch").orderBy("section_path", "slug")))
