"""The corpus pipeline: quality, toxicity, near duplicates, privacy, packing.

Each stage is one operator of tidewake.llm, works on all that its predecessor kept, and returns the columns of documents;
the last returns the pieces of the packed sequences. The classifiers learn from the labelled rows of documents.

In every stage: a null or empty text is a text without words, which the classifiers score by their bias (quality also by the
record), near-duplicate search links with nothing, privacy leaves as it is, and packing turns into its end mark. A null
lang, source or n_chars is a value of its own. Rows without doc_id are scored and packed like others and never go as copies.
Repeated rows get the same score; of those with one doc_id, near-duplicate search keeps all or none. Empty tables give empty
results; columns beside those of documents pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm import neardup, packing, quality, surrogates, toxicity
from tidewake.llm.common import written
from tidewake.llm.queries import SURROGATE_KEY


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained views reject go."""
    return quality.without_rejected(docs, quality.train(*_tables(spark, sf_dir)))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier flags go."""
    return toxicity.without_toxic(docs, toxicity.train(*_tables(spark, sf_dir)))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: shingles of five words, likeness of 0.8."""
    return neardup.without_copies(docs, size=5, percent=80)


def privacy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data get surrogates; n_chars follows the text."""
    report = (f"n_{uuid.uuid4().hex}", f"kinds_{uuid.uuid4().hex}")  # no column of docs has such a name
    new = surrogates.replace_entities(docs, SURROGATE_KEY, report=report)
    n_chars = F.when(F.col(report[0]) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return new.withColumn("n_chars", n_chars).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens, a row for each piece."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, length=2048).drop("ids")


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", neardup_stage),
    ("privacy", privacy_stage),
    ("packing", packing_stage),
]

#: Trained models and tokens are beyond SQL; tests hold each stage against a plain version of its rule (the classifiers' scores from the
#: trained weights), and what the classifiers learned by held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
