"""Unified diffs as rows of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HEADER = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@(.*)$"


def recounted(patches: DataFrame, key: str, column: str = "patch") -> DataFrame:
    """FLT-12: patches with counted hunk headers: bare context lines get a space, a pair of path lines becomes a header, stray opening tags go. A non-empty patch ends with a newline.

    Lines become rows; a hunk is the rows from its header to the next header of any kind.
    """
    text = F.regexp_replace(F.regexp_replace(F.col(column), "\r\n", "\n"), r"^\s+|\s+$", "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "<diff>")
    bare = (F.size(lines) >= 2) & F.get(lines, F.lit(0)).startswith("a/") & F.get(lines, F.lit(1)).startswith("b/")
    headed = F.when(bare, F.concat(F.array(F.concat(F.lit("diff --git "), F.get(lines, F.lit(0)), F.lit(" "), F.get(lines, F.lit(1)))), F.slice(lines, F.lit(3), F.greatest(F.lit(0), F.size(lines) - 2)))).otherwise(lines)
    rows = patches.select(key, F.posexplode(headed).alias("at", "line"))
    by_line = Window.partitionBy(key).orderBy("at")
    upto = by_line.rowsBetween(Window.unboundedPreceding, 0)
    is_hunk = F.col("line").rlike(HEADER)
    is_break = is_hunk | F.col("line").rlike(r"^(diff --git |--- |\+\+\+ |@@ )")
    rows = rows.withColumns({"is_hunk": is_hunk, "is_break": is_break})
    rows = rows.withColumn("part", F.sum(F.col("is_break").cast("int")).over(upto))
    rows = rows.withColumn("in_hunk", F.coalesce(F.max(F.col("is_hunk")).over(Window.partitionBy(key, "part")) & ~F.col("is_break"), F.lit(False)))
    known = F.substring("line", 1, 1).isin(" ", "+", "-", "\\")
    rows = rows.withColumn("line", F.when(F.col("in_hunk") & (F.col("line") == ""), F.lit(" ")).when(F.col("in_hunk") & ~known, F.concat(F.lit(" "), "line")).otherwise(F.col("line")))
    whole = Window.partitionBy(key, "part")
    counted = lambda marks: F.sum((F.col("in_hunk") & F.substring("line", 1, 1).isin(*marks)).cast("int")).over(whole)
    rows = rows.withColumns({"old": counted([" ", "-"]), "new": counted([" ", "+"])})
    header = F.concat(F.lit("@@ -"), F.regexp_extract("line", HEADER, 1), F.lit(","), F.col("old"), F.lit(" +"), F.regexp_extract("line", HEADER, 2), F.lit(","), F.col("new"), F.lit(" @@"), F.regexp_extract("line", HEADER, 3))
    rows = rows.withColumn("line", F.when(F.col("is_hunk"), header).otherwise(F.col("line")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy(key).agg(joined.alias(column)).withColumn(column, F.when(F.col(column) == "", "").otherwise(F.concat(column, F.lit("\n"))))
