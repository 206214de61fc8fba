"""Registered queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import aggregates, definitions, files, jsons, nested, relational, texts, times, tpch, windows

_MODULES = (tpch, relational, aggregates, windows, times, jsons, nested, texts, files, definitions)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for module in _MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
