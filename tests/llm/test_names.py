"""Columns whose names differ from the operators' in case only, rows that share an id, and inputs of unknown size."""

import pytest
from pyspark.sql import functions as F

from corvane.llm import bpe, common, decontaminate, langid, mixing, quality, runs, secrets


@pytest.fixture(scope="module")
def odd(spark, data):
    """Documents whose columns are spelled otherwise, with some that clash with results."""
    d = spark.read.parquet(f"{data}/documents.parquet")
    d = d.select(F.col("doc_id").alias("Doc_ID"), F.col("text").alias("Text"), F.col("lang").alias("LANG"), F.col("source").alias("Source"), F.col("n_chars").alias("N_chars"))
    return d.withColumns({"Score": F.lit(1.0), "PREDICTED": F.lit(7), "Lang_Pred": F.lit("x"), "Spans": F.lit("y"), "Size": F.lit(2), "Target": F.lit(3), "Reps": F.lit(9), "Source_size": F.lit(4), "Runs": F.lit(0), "IDS": F.lit(0)})


def same(d, n, *results):
    names = [c.lower() for c in d.columns]
    assert len(names) == len(set(names)) and set(results) <= set(d.columns) and d.count() == n


def test_results_replace_columns_of_any_case(spark, data, odd):
    n, columns = odd.count(), odd.columns
    labels = spark.read.parquet(f"{data}/labels.parquet")
    same(quality.score(odd, quality.fit(odd, labels)), n, "score", "predicted")
    same(langid.label(odd, langid.fit(odd), columns), n, "lang_pred", "score", "spans")
    same(secrets.scan(odd, columns), n, "spans")
    same(mixing.mix(odd, keep=columns), n, "size", "source_size", "target", "reps")
    same(runs.periodic_runs(odd, columns), n, "runs", "collapsed")
    same(bpe.encode(odd, columns), n, "ids", "decoded")


def test_text_is_found_in_any_case(spark, data, odd):
    plain = spark.read.parquet(f"{data}/documents.parquet")
    benchmark = spark.read.parquet(f"{data}/benchmark.parquet")
    ids = lambda d: sorted(r[0] for r in d.select("doc_id").collect())
    assert ids(decontaminate.clean(odd, benchmark)) == ids(decontaminate.clean(plain, benchmark))
    texts = lambda d: sorted(r[0] for r in d.select("text").collect())
    secret = lambda d: d.withColumn("Text", F.concat("text", F.lit(" password=abcdef123456")))
    out = secrets.redact(secret(odd))
    assert out.columns == odd.columns and texts(out) == texts(secrets.redact(secret(plain))) != texts(secret(plain))


def test_stages_take_columns_of_any_case(spark, data, odd):
    import corpus_pipeline as P

    d = odd
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, d, data)
        assert out.columns == odd.columns
        d = spark.createDataFrame(out.collect(), odd.schema)
    assert 0 < P.STAGES[-1][1](spark, d, data).count() <= d.count() < odd.count()


def test_rows_that_share_an_id_go_only_as_copies(spark, data):
    import corpus_pipeline as P

    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(1, text(1), {"a": 1}), (1, text(2), {"a": 1}), (1, text(2), {"a": 2}), (2, text(3), None), (3, text(3) + " more", None), (None, text(3), None), (None, text(3), None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, m map<string, int>")
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in P.near_copies_stage(spark, d, data).collect()))
    assert got == sorted([(1, text(1)), (1, text(2)), (2, text(3)), (0, text(3)), (0, text(3))])


def test_pipeline_of_an_empty_table(spark, data, tmp_path):
    import corpus_pipeline as P

    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{data}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.read.parquet(f"{data}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_parts_grow_with_inputs_of_unknown_size(spark):
    d = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 20_000).alias("text"))
    unknown = spark.createDataFrame(d.rdd, d.schema)
    sized = [common.parts_for(x, 1) for x in (unknown.where("doc_id < 40"), unknown)]
    assert sized[0] == int(spark.conf.get("spark.sql.shuffle.partitions")) < sized[1]


def test_secrets_of_an_empty_table(spark):
    assert secrets.scan(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"]).count() == 0
