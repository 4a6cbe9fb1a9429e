"""The pipeline stage by stage over a small table, each against what its operator says of the stage's own input."""

import corpus_pipeline
from pyspark.sql import functions as F
from tidewake.llm import neardup
from tidewake.llm.common import written


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        given, docs = docs, written(stage(spark, docs, data), f"test-{name}")
        if name != "packing":
            assert docs.columns == columns
            assert docs.select("doc_id").subtract(given.select("doc_id")).isEmpty()
        if name == "near_duplicates":
            kept = neardup.near_duplicates(given, 5, 80).where("kept").select("doc_id")
            assert sorted(r[0] for r in kept.collect()) == sorted(r[0] for r in docs.select("doc_id").collect())
        if name == "privacy":
            both = given.select("doc_id", F.col("text").alias("old")).join(docs, "doc_id")
            assert both.where("old rlike '[0-9]@mail' and old = text").isEmpty() and docs.count() == given.count()
        if name == "packing":
            packed = docs.select("doc_id").distinct()
            assert packed.count() == given.select("doc_id").distinct().count()
    labels = spark.read.parquet(f"{data}/labels.parquet")
    assert packed.count() < before
    good = labels.where("quality = 1 and toxic = 0").count()
    assert labels.where("quality = 1 and toxic = 0").join(packed, "doc_id").count() > 0.5 * good


def test_stages_on_odd_rows_and_of_none(spark, data, odd, none):
    for name, stage in corpus_pipeline.STAGES:
        out, empty = stage(spark, odd, data), stage(spark, none, data)
        assert empty.count() == 0
        if name == "packing":
            assert out.agg({"length": "sum"}).first()[0] > 0
        else:
            assert out.columns == odd.columns and out.count() <= odd.count() and (name != "privacy" or out.count() == odd.count())


def test_run_and_names(spark, data):
    import __spark_entry__

    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in __spark_entry__.queries() if q.startswith("op")}
    assert "pipeline" in __spark_entry__.queries() and len(corpus_pipeline.STAGES) == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
