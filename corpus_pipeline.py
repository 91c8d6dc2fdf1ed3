"""A corpus pipeline: quality rules, near-duplicates, personal data, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. ``run`` writes each stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelwise.llm import jaccard, mixture, packing, pii, quality_forest
from panelwise.llm.common import small_batches, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the fixed rules and the isolation forest keep."""
    small_batches(spark)
    return quality_forest.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: SimHash fingerprints and MinHash bands of five-word shingles, Jaccard similarity 0.8 or more."""
    small_batches(spark)
    return jaccard.keep_one(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    small_batches(spark)
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights ask for: up to MAX_EPOCHS times, or not at all."""
    small_batches(spark)
    return mixture.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(bin, slot, doc_id, piece, n_words, text) of every piece of every document."""
    small_batches(spark)
    return packing.sequences(docs)


STAGES = [("quality", quality), ("dedup", dedup), ("pii", private), ("mix", mixed), ("pack", packed)]

#: The forest, the fitted span classifier and best-fit are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, one after the other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
