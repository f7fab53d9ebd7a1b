"""A training-data pipeline over ``documents``: quality, exact copies, near copies, secrets, packing.

Every stage takes (spark, docs, sf_dir) and gets all that its predecessor kept, read from Parquet; its
decisions take effect in what it returns. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorquery.llm import exact_dedup, ngram_join, packing, secrets, site_quality
from sensorquery.llm.components import written
from sensorquery.llm.queries import vocabulary
from sensorquery.llm.registry import documents, labels
from sensorquery.llm.text import small_batches


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; hosts are sources, paths their languages."""
    small_batches(spark)
    return site_quality.accepted(docs, labels(spark, sf_dir), F.col("source"), F.col("lang"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    small_batches(spark)
    return exact_dedup.distinct_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group linked by five-word shingles at 0.8 the document with the smallest id."""
    small_batches(spark)
    return ngram_join.one_of_each_group(docs, width=5, per_cent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    small_batches(spark)
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 2048 tokens."""
    small_batches(spark)
    return packing.pack_documents(docs, vocabulary())


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard", near_copies),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

# The classifier and the tokenizer cannot be said in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents, each written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
