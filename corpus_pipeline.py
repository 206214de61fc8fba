"""From raw documents to a training mix: quality, near duplicates, benchmark leaks, secrets, source weights.

Every stage takes documents with nulls in any column, empty and very long texts, repeated rows and further columns, and
empty tables; all but the last return the columns that they got. A null text is an empty text. What each stage does with
ties, repeated rows and missing ids is said in its operator's docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontam, mixing, quality, secrets, shingles
from millrace.llm.common import checkpointed, ship_package


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier keeps: those whose perplexity lies between the bounds of their language.
    Empty texts go; repeated rows are judged alike."""
    ship_package(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles of similarity 0.8 or more): the one with the least
    doc_id, nulls last. Different texts that share a doc_id all stay; of equal rows one does. Candidates come from operator 3's
    trees over fingerprints; similar texts beyond their radius come from min-hashes (README); all are confirmed exactly."""
    ship_package(spark)
    return shingles.one_of_each_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item. Repeated rows stay or go together."""
    ship_package(spark)
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    ship_package(spark)
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document with the words that the mix takes from it. A null source is a source of its own."""
    ship_package(spark)
    return mixing.mix(docs)


STAGES = [
    ("quality_filter", quality_filter),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; between stages the rows are kept in the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs
