"""The registered queries of the training-data operators, with SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from millrace.llm import decontam, flac, html, langid, licenses, mixing, quality, secrets, simhash, tokens
from millrace.llm.common import ship_package


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose texts take long: one of fewer partitions than there are cores (a row group isn't split, whatever it
    takes to read its texts) is dealt out first. So at most a partition for each core is shuffled."""
    rows, cores = _table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_texts(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_texts(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_texts(spark, sf_dir, "documents"))


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(_texts(spark, sf_dir, "pages"))


def op5_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.media_digests(_texts(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_texts(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_texts(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_texts(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaked_pairs(_texts(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_quality_classifier,
        op3_simhash_near_dedup,
        op4_html_main_text,
        op5_flac_media,
        op6_mix_sources,
        op7_secret_scan,
        op8_language_id,
        op9_token_counts,
        op10_benchmark_decontamination,
    )
}

ORACLE_SQL: dict[str, str] = {"op6_mix_sources": mixing.MIX_SQL.replace("{docs}", "documents")}
