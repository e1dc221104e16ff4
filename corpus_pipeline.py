"""A corpus from `documents`: filtered, free of near copies, benchmark items and secrets, mixed to weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import decontaminate, mixing, ngram_join, quality, secrets


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones of docs, rejects go."""
    network = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")  # columns named like the score stay as they are
    return quality.score(rows, network, keep=["row"]).where("predicted = 1").select("row.*")


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8) stays, the one with the smallest doc_id. Rows that share a doc_id are told apart by their texts, which are compared like any others; of rows with equal ids and texts one stays. Rows without doc_id stay."""
    columns = docs.columns
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("~many"))
    named = docs.withColumn("~id", F.col("doc_id")).withColumn("~many", F.lit(None).cast("boolean"))
    clashes = not repeated.isEmpty()
    if clashes:
        named = docs.join(repeated, "doc_id", "left").withColumn("~id", F.when(F.col("~many"), F.xxhash64(F.lit("row"), "doc_id", "text")).otherwise(F.col("doc_id")))
    groups = ngram_join.ngram_components(named.select(F.col("~id").alias("doc_id"), "text"), n=5, percent=80)
    copies = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("~id")).distinct()
    kept = named.join(copies, "~id", "left_anti")
    if not clashes:
        return kept.select(*columns)
    ordered = F.struct(*[c for c, kind in docs.dtypes if "map<" not in kind])
    one = kept.where(F.col("~many")).groupBy("~id").agg(F.min_by(F.struct(*columns), ordered).alias("row")).select("row.*")
    return kept.where(F.col("~many").isNull()).select(*columns).unionByName(one)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows."""
    out = secrets.redact(docs)
    counts = [c for c in docs.columns if c.lower() == "n_chars"]
    return out.withColumns({c: F.when(F.col(c).isNotNull(), F.length("text")).cast("long") for c in counts})


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix with how often each is taken (reps), and their source's size and target in words."""
    return mixing.mix(docs, keep=docs.columns).where("reps > 0")


STAGES = [
    ("quality_classifier", quality_stage),
    ("ngram_jaccard_join", near_copies_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scan", secrets_stage),
    ("source_mixing", mixing_stage),
]

#: SQL can't express the stages; tests compare them with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
