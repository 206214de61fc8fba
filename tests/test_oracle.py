"""Every registered query that has oracle SQL gives the oracle's rows at the smallest scale."""

from __future__ import annotations

import math
from pathlib import Path

import pytest

from millrace import plans
from millrace.plans.registry import TABLES

from .oracle import connection

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no driver tables here")


@pytest.fixture(scope="module")
def oracle():
    return connection(DATA, TABLES)


def plain(v):
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        v = v.replace(tzinfo=None)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_same_rows(spark, oracle, name):
    df = plans.queries()[name](spark, str(DATA))
    expected = oracle.sql(plans.oracle_sql()[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows(df.columns, df.collect()) == rows(expected.columns, expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_rows_only(spark, name):
    assert plans.queries()[name](spark, str(DATA)).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
