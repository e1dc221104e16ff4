"""Files to chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import blocks
from corvane.functions.text import language_of, lines_of, once
from corvane.operators.numbering import numbered

MAX_LINES, OVERLAP = 50, 10


def chunk_hash(content: Column) -> Column:
    """CHK-04: stable hash of a chunk's content."""
    return F.md5(content.cast("binary"))


def window_spans(total: Column, max_lines: int, overlap: int) -> Column:
    """First and last lines, from 1, of windows over so many lines; the last ends with the file."""
    step = max_lines - overlap
    if step < 1:
        raise ValueError("windows must advance")
    last = F.greatest(F.lit(0), F.ceil((total - max_lines) / F.lit(float(step)))).cast("int") * step
    return F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda at: F.struct((at + 1).alias("start_line"), F.least(at + max_lines, total).alias("end_line")))


def _cut(files: DataFrame, spans: Column) -> DataFrame:
    """Chunks of files that are not blank, by spans of their lines (column lines); without spans there are none."""
    others = [c for c in files.columns if c != "content"]
    split = files.where(F.col("content").rlike(r"\S")).withColumn("lines", lines_of(F.col("content"))).withColumn("spans", spans)
    each = split.select(*others, "lines", F.inline("spans"))
    content = F.array_join(F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "")
    return each.select(*others, "start_line", "end_line", content.alias("content")).withColumn("chunk_hash", chunk_hash(F.col("content")))


def sliding_windows(files: DataFrame, max_lines: int = MAX_LINES, overlap: int = OVERLAP) -> DataFrame:
    """CHK-01: windows of max_lines lines that share `overlap` lines; the last ends with the file. Blank files give none."""
    step = max_lines - overlap
    if step < 1:
        raise ValueError("windows must advance")
    others = [c for c in files.columns if c != "content"]
    split = files.where(F.col("content").rlike(r"\S")).withColumn("lines", lines_of(F.col("content"))).withColumn("total", F.size("lines"))
    last = F.greatest(F.lit(0), F.ceil((F.col("total") - max_lines) / F.lit(float(step)))).cast("int") * step
    windows = split.select(*others, "lines", "total", F.explode(F.sequence(F.lit(0), last, F.lit(step))).alias("at"))
    content = F.array_join(F.slice("lines", F.col("at") + 1, F.lit(max_lines)), "")
    out = windows.select(*others, (F.col("at") + 1).alias("start_line"), F.least(F.col("at") + max_lines, F.col("total")).alias("end_line"), content.alias("content"))
    return out.withColumn("chunk_hash", chunk_hash(F.col("content")))


def structural_blocks(files: DataFrame, budget: int = 500) -> DataFrame:
    """CHK-02: blocks of the text's structure, cut and joined up to `budget` characters that are not white space.

    files: any columns with content and language; language null gives none, nor does a text that breaks its language's
    rules. A line over the budget stands alone.
    """
    return _cut(files, blocks.spans(budget)("content", "language"))


def chunk_files(files: DataFrame, max_lines: int = MAX_LINES, overlap: int = OVERLAP, budget: int = 500) -> DataFrame:
    """CHK-03: structural chunks where the language is known, sliding windows for the rest and where structure fails. files: repository_id, branch, file_path, content."""
    known = files.withColumn("language", language_of(F.col("file_path")))
    windows = once(F.size("lines"), lambda total: window_spans(total, max_lines, overlap))
    return _cut(known, F.coalesce(blocks.spans(budget)("content", "language"), windows))


def overlapping(chunks: DataFrame, windows: DataFrame, keys: list[str], lines: int = 64) -> DataFrame:
    """Pairs of chunks and windows of a file that share lines: keys, the ids of both, and how many lines they share.

    Rows of a file meet by stretches of `lines` lines; a pair is kept in the first stretch that both reach.
    """
    reach = lambda d, p: d.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in ("chunk_id", "start_line", "end_line")]).withColumn("stretch", F.explode(F.sequence(F.floor(F.col(f"{p}_start_line") / lines), F.floor(F.col(f"{p}_end_line") / lines))))
    met = reach(chunks, "c").join(reach(windows, "w"), [*keys, "stretch"])
    first, last = F.greatest("c_start_line", "w_start_line"), F.least("c_end_line", "w_end_line")
    return met.where((first <= last) & (F.col("stretch") == F.floor(first / lines))).select(*keys, F.col("c_chunk_id").alias("chunk_id"), F.col("w_chunk_id").alias("window_id"), (last - first + 1).alias("shared"))


def duplicate_report(chunks: DataFrame) -> DataFrame:
    """CHK-05: chunk hashes that occur more than once, how often, and the first id."""
    return chunks.groupBy("chunk_hash").agg(F.count("*").alias("copies"), F.min("chunk_id").alias("first_id")).where("copies > 1")


def staged(chunks: DataFrame, batch: Column) -> DataFrame:
    """SRC-04: chunks numbered from 0 in each batch by file and line."""
    return numbered(chunks.withColumn("batch_id", batch), ["batch_id"], ["repository_id", "branch", "file_path", "start_line"], "seq_index")
