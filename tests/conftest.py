from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
if str(ROOT) not in sys.path:
    sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from millrace.session import session

    folder = tmp_path_factory.mktemp("spark")
    s = session(
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__warehouse__dir=str(folder / "warehouse"),
        spark__checkpoint__dir=str(folder / "checkpoints"),
        spark__driver__memory="3g",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def db(spark):
    """A database of its own for tests that make tables."""
    spark.sql("CREATE DATABASE IF NOT EXISTS t")
    spark.sql("USE t")
    yield spark
    spark.sql("USE default")
    spark.sql("DROP DATABASE t CASCADE")
