"""The SQL engine that results are held against."""

from __future__ import annotations

import duckdb


def connection(folder=None, tables=()):
    """A connection in UTC, with the Parquet tables of a folder as views."""
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in tables:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c
