"""Readers and writers of the evaluation and corpus file formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.text import is_indexable
from corvane.operators.numbering import numbered

#: Columns of an answer record that aren't flags.
RECORD_COLUMNS = ["idx", "split", "question", "gold_answer", "pred_answer", "error_type", "answer_style", "problem_cluster", "completion"]


def repository_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC-01 and SRC-02: indexable files of a folder tree as file_path and content; blank ones go, bad bytes become U+FFFD."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    good = raw.where(is_indexable(F.col("path"), F.col("length")))
    return good.select(F.col("path").alias("file_path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content")).where(F.col("content").rlike(r"\S"))


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """SRC-06: the last record of each task in JSON lines (by file, then place in it); blank lines are skipped, numbers coerced, a record without task_id is an error, and so is an empty file."""
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))  # ids grow within a block of a file
    lines = spark.read.text(path).withColumn("line", place).where(F.trim("value") != "")
    field = lambda n: F.trim(F.get_json_object("value", f"$.{n}"))
    task = field("task_id")
    checked = F.when(F.coalesce(task, F.lit("")) == "", F.raise_error(F.concat(F.lit("no task_id: "), "value")).cast("string")).otherwise(task)
    rows = lines.select(checked.alias("task_id"), F.coalesce(field("model_patch"), F.lit("")).alias("model_patch"), field("model_name_or_path").alias("model_name_or_path"), *[field(n).try_cast(t).alias(n) for n, t in (("input_tokens", "long"), ("output_tokens", "long"), ("latency_ms", "double"))], "line")
    last = rows.withColumn("n", F.row_number().over(Window.partitionBy("task_id").orderBy(F.col("line").desc()))).where("n = 1").drop("n", "line")
    if last.isEmpty():
        raise ValueError(f"no predictions in {path}")
    return last


def task_results(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """SRC-07: per-task results under run folders, run id from the path: <run>/tasks/<task>/result.json. multi_line: a file is one result, else a line is."""
    schema = "task_id string, resolved boolean, prediction_present boolean, patch_exists boolean, patch_applied boolean, failing_tests array<string>, pytest_targets array<string>"
    rows = spark.read.schema(schema).option("multiLine", str(multi_line).lower()).json(path).withColumn("run_id", F.regexp_extract("_metadata.file_path", r"([^/]+)/tasks/", 1))
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return rows.select("run_id", "task_id", *[no(c) for c in ("resolved", "prediction_present", "patch_exists", "patch_applied")], *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("failing_tests", "pytest_targets")])


def run_ids(results: DataFrame) -> DataFrame:
    return results.select("run_id").distinct()


def report(rows: DataFrame, column: str = "value") -> DataFrame:
    """SRC-08: a report's JSON object of instances, a row each; missing or wrong parts take defaults."""
    tests = "struct<success:array<string>,failure:array<string>>"
    instance = f"struct<patch_exists:boolean,patch_successfully_applied:boolean,resolved:boolean,tests_status:struct<FAIL_TO_PASS:{tests},PASS_TO_PASS:{tests}>>"
    d = rows.select(F.explode(F.from_json(column, f"map<string,{instance}>")).alias("task_id", "r"))
    none = F.array().cast("array<string>")
    return d.select(
        "task_id", *[F.coalesce(F.col(f"r.{a}"), F.lit(False)).alias(b) for a, b in (("patch_exists", "patch_exists"), ("patch_successfully_applied", "patch_applied"), ("resolved", "resolved"))],
        F.coalesce("r.tests_status.FAIL_TO_PASS.success", none).alias("fail_to_pass_successes"), F.coalesce("r.tests_status.FAIL_TO_PASS.failure", none).alias("fail_to_pass_failures"), F.coalesce("r.tests_status.PASS_TO_PASS.failure", none).alias("pass_to_pass_failures"),
    )


CONFIG = "task_type string, task_count long, shared_library_repo_count long, consumer_repo_mode string, python_version_target string, context_modes array<string>, seed long"
MANIFEST = f"family string, version string, generation_config struct<{CONFIG.replace(' string', ':string').replace(' long', ':long').replace(' array', ':array')}>, " + "tasks array<struct<task_id:string,task_type:string,title:string,problem_statement:string,repo_a_id:long,repo_b_id:long,pytest_targets:array<string>,visible_api_names:array<string>>>"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """SRC-09: a task manifest, a row a task."""
    return spark.read.schema(MANIFEST).option("multiLine", "true").json(path).select("family", "version", F.explode("tasks").alias("t")).select("family", "version", "t.*")


def config_errors(manifests: DataFrame, config: dict) -> DataFrame:
    """SRC-09: settings in which a manifest's generation_config is not the config: family, rule. A setting that the config lacks must be absent."""
    kinds = dict(part.rsplit(" ", 1) for part in CONFIG.split(", "))
    wanted = {c: F.lit(None).cast(kind) if config.get(c) is None else (F.array(*map(F.lit, config[c])) if isinstance(config[c], (list, tuple)) else F.lit(config[c])).cast(kind) for c, kind in kinds.items()}
    differ = F.array(*[F.when(~F.col(f"generation_config.{c}").eqNullSafe(v), F.lit(f"{c} differs from the config")) for c, v in wanted.items()])
    return manifests.select("family", F.explode(F.filter(differ, lambda x: x.isNotNull())).alias("rule"))


def manifest_errors(tasks: DataFrame) -> DataFrame:
    """SRC-09: the rules that each task breaks: task_id, rule."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    rules: dict[str, Column] = {f"{c} is required": blank(c) for c in ("task_id", "task_type", "title", "problem_statement")}
    rules |= {f"{c} must be positive": F.coalesce(F.col(c), F.lit(0)) <= 0 for c in ("repo_a_id", "repo_b_id")}
    rules["pytest_targets is required"] = F.coalesce(F.size("pytest_targets"), F.lit(0)) <= 0
    return tasks.select("task_id", F.explode(F.filter(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]), lambda x: x.isNotNull())).alias("rule"))


def answer_records(spark: SparkSession, path: str, flags: list[str]) -> DataFrame:
    """SRC-11: answer records of a CSV file with a header; all columns but RECORD_COLUMNS are integer flags."""
    raw = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    return raw.select(*[F.col(c).try_cast("int").alias(c) if c in flags or c == "idx" else F.col(c) for c in raw.columns])


def pricing(rows: DataFrame, column: str = "value", provider: str = "provider") -> DataFrame:
    """SRC-12: a catalog's JSON, a row for each model and region; a model without regions has region *."""
    rate = "generation_input_per_million_usd:double,generation_output_per_million_usd:double,embedding_input_per_million_usd:double"
    d = rows.select(provider, F.explode(F.from_json(column, f"struct<models:map<string,struct<{rate},regions:map<string,struct<{rate}>>>>>")["models"]).alias("model", "m"))
    own = F.map_from_arrays(F.array(F.lit("*")), F.array(F.struct(*[F.col(f"m.{f.split(':')[0]}") for f in rate.split(",")])))
    return d.select(provider, "model", F.explode(F.coalesce("m.regions", own)).alias("region", "r")).select(provider, "model", "region", F.col("r.generation_input_per_million_usd").alias("input_rate"), F.col("r.generation_output_per_million_usd").alias("output_rate"), F.col("r.embedding_input_per_million_usd").alias("embedding_rate"))


def text_table(rows: DataFrame, order: list[str], columns: list[str] | None = None) -> DataFrame:
    """SRC-13: rows as lines of a table with padded columns, under names and a rule: line_no (0 and 1 for these), line. Nulls show as -."""
    columns = columns or rows.columns
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    widths = rows.agg(*[F.coalesce(F.max(F.length(cell(c))), F.lit(0)).alias(c) for c in columns]).first()
    width = {c: max(len(c), widths[c]) for c in columns}
    spark = rows.sparkSession
    head = spark.createDataFrame([(0, "  ".join(c.ljust(width[c]) for c in columns)), (1, "  ".join("-" * width[c] for c in columns))], "line_no long, line string")
    line = F.concat_ws("  ", *[F.rpad(cell(c), width[c], " ") for c in columns])
    body = numbered(rows.withColumn("one__", F.lit(1)), ["one__"], order, "n__").select((F.col("n__") + 2).cast("long").alias("line_no"), line.alias("line"))
    return head.unionByName(body).withColumn("line", F.rtrim("line"))


def write_json(rows: DataFrame, path: str) -> None:
    """SRC-13: JSON lines; Spark's commit makes them visible at once."""
    rows.write.mode("overwrite").json(path)
