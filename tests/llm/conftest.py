from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.llm.common import ship_package

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns that operators use inside."""
    long = " ".join(f"word{i % 977} and {i}" for i in range(20_000))
    prose = "the quick brown fox jumps over the lazy dog and runs away from it again"
    rows = [
        (1, prose, "en", "a", 70),
        (1, prose, "en", "a", 70),
        (2, prose, None, "b", 70),
        (3, None, "en", "a", None),
        (4, "", "en", None, 0),
        (5, " \n\t ", "en", "b", 4),
        (6, long, "en", "a", len(long)),
        (None, prose + " now", "en", "a", 74),
        (None, None, None, None, None),
        (7, "日本語のテキスト ééé \x00 ﷽", "xx", "é", 20),
        (8, "x", "en", "b", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({"fp": F.lit("clash"), "key": F.lit(None).cast("int"), "block": F.lit(1.5), "size": F.lit("s"), "at": F.lit(0), "_h": F.lit(1)})


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("false")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")
