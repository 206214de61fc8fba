"""Tables, views, materialized views and constraints. A change of rows or of types rewrites the table as a whole:
the new rows are written beside the old ones, and the names are swapped at the end."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.checkpoints import checkpointed
from millrace.sql import outside_strings


class ConstraintViolation(ValueError):
    """Rows that a constraint doesn't allow."""


@dataclass
class Constraints:
    """What rows must keep to. Not-null, checks and unique keys are tested before rows are written."""

    not_null: list[str] = field(default_factory=list)
    checks: dict[str, str] = field(default_factory=dict)
    unique: list[list[str]] = field(default_factory=list)

    def validate(self, new: DataFrame, all_rows: DataFrame | None = None) -> None:
        tests = [F.count_if(F.col(c).isNull()).alias(f"null value in column {c}") for c in self.not_null]
        tests += [F.count_if(~F.coalesce(F.expr(e), F.lit(True))).alias(f"check constraint {n}") for n, e in self.checks.items()]
        if tests:
            for name, bad in new.agg(*tests).first().asDict().items():
                if bad:
                    raise ConstraintViolation(f"{name} is violated by {bad} rows")
        for keys in self.unique:
            rows = (new if all_rows is None else all_rows).where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
            if not rows.groupBy(*keys).count().where("count > 1").isEmpty():
                raise ConstraintViolation(f"duplicate key in ({', '.join(keys)})")


    def renamed(self, old: str, new: str) -> Constraints:
        swap = lambda c: new if c == old else c
        word = re.compile(rf"(?<![\w`.]){re.escape(old)}(?!\w)|`{re.escape(old)}`")
        return Constraints([*map(swap, self.not_null)], {n: outside_strings(e, lambda t: word.sub(f"`{new}`", t)) for n, e in self.checks.items()}, [[*map(swap, k)] for k in self.unique])

    def without(self, column: str) -> Constraints:
        """What is left when a column goes: a constraint that names it goes with it."""
        word = re.compile(rf"(?<![\w.]){re.escape(column)}(?!\w)")
        named = lambda e: bool(word.search(outside_strings(e, lambda t: t, "")))
        return Constraints([c for c in self.not_null if c != column], {n: e for n, e in self.checks.items() if not named(e)}, [k for k in self.unique if column not in k])


#: What the catalog keeps with a table: its constraints, its columns' defaults, and a materialized view's query.
_CONSTRAINTS, _DEFAULTS, _QUERY = "millrace.constraints", "millrace.defaults", "millrace.query"


def _property(spark: SparkSession, name: str, key: str):
    found = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    return json.loads(found[key]) if key in found else None


def _set_property(spark: SparkSession, name: str, key: str, value) -> None:
    text = json.dumps(value).replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{key}' = '{text}')")


def constraints(spark: SparkSession, name: str) -> Constraints:
    """The constraints that the catalog keeps with a table, by whatever name the table is called."""
    return Constraints(**(_property(spark, name, _CONSTRAINTS) or {}))


def _keep(spark: SparkSession, name: str, mine: Constraints) -> None:
    _set_property(spark, name, _CONSTRAINTS, asdict(mine))


def _partitions(spark: SparkSession, name: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(name) if c.isPartition]


def create_table(spark: SparkSession, name: str, schema: str, constraints: Constraints | None = None, partition_by: list[str] | None = None, defaults: dict[str, str] | None = None) -> None:
    """defaults: SQL expressions by column, which ``insert`` uses where a column isn't given."""
    parts = f" PARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet{parts}")
    if constraints is not None:
        _keep(spark, name, constraints)
    if defaults:
        _set_property(spark, name, _DEFAULTS, defaults)


def create_table_as(df: DataFrame, name: str, with_data: bool = True, partition_by: list[str] | None = None) -> None:
    writer = (df if with_data else df.limit(0)).write.format("parquet").mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(name)


def create_temporary_table_as(df: DataFrame, name: str) -> None:
    """A table of this session: its rows are kept in the checkpoint folder, its name goes with the session."""
    checkpointed(df).createOrReplaceTempView(name)


def insert(df: DataFrame, name: str, columns: list[str] | None = None, defaults: dict[str, Column] | None = None) -> None:
    """Append rows. Columns that aren't given take their default (of this call, or stored with the table), or null."""
    spark = df.sparkSession
    schema = spark.table(name).schema
    given = columns or df.columns
    named = df.toDF(*given) if columns else df
    stored = {c: F.expr(e) for c, e in (_property(spark, name, _DEFAULTS) or {}).items()} | (defaults or {})
    rows = named.select(*[(F.col(f"`{f.name}`") if f.name in given else stored.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in schema.fields])
    constraints(spark, name).validate(rows, spark.table(name).unionByName(rows))
    rows.write.insertInto(name)


def _rewrite(spark: SparkSession, name: str, change: Callable[[DataFrame], DataFrame], mine: Constraints | None = None, partition_by: list[str] | None = None, defaults: dict | None = None) -> None:
    """Write the changed rows beside the table, partitioned as it is, and swap the names. The old rows go last, so that
    they are there whatever stops on the way."""
    rows = change(spark.table(name))
    mine = constraints(spark, name) if mine is None else mine
    mine.validate(rows, rows)
    parts = _partitions(spark, name) if partition_by is None else partition_by
    defaults = (_property(spark, name, _DEFAULTS) or {}) if defaults is None else defaults
    query = _property(spark, name, _QUERY)
    fresh, old = (f"{name}_{uuid.uuid4().hex[:8]}" for _ in range(2))
    writer = rows.write.format("parquet")
    (writer.partitionBy(*parts) if parts else writer).saveAsTable(fresh)
    _keep(spark, fresh, mine)
    _set_property(spark, fresh, _DEFAULTS, defaults)
    if query is not None:
        _set_property(spark, fresh, _QUERY, query)
    rename_table(spark, name, old)
    rename_table(spark, fresh, name)
    spark.sql(f"DROP TABLE {old}")


def update(spark: SparkSession, name: str, values: dict[str, str], where: str = "true") -> None:
    """Set columns to SQL expressions of the old row, in rows for which the condition is true."""

    def change(old: DataFrame) -> DataFrame:
        hit = F.coalesce(F.expr(where), F.lit(False))
        return old.select(*[(F.when(hit, F.expr(values[f.name]).cast(f.dataType)).otherwise(F.col(f.name)) if f.name in values else F.col(f.name)).alias(f.name) for f in old.schema.fields])

    missing = set(values) - set(spark.table(name).columns)
    if missing:
        raise ValueError(f"no such column: {', '.join(sorted(missing))}")
    _rewrite(spark, name, change)


def delete(spark: SparkSession, name: str, where: str = "true") -> None:
    """Remove the rows for which the condition is true."""
    _rewrite(spark, name, lambda old: old.where(~F.coalesce(F.expr(where), F.lit(False))))


def truncate(spark: SparkSession, name: str) -> None:
    spark.sql(f"TRUNCATE TABLE {name}")


# ALTER TABLE


def add_column(spark: SparkSession, name: str, column: str, kind: str, default: str | None = None) -> None:
    _rewrite(spark, name, lambda old: old.withColumn(column, F.expr(default if default is not None else "NULL").cast(kind)))


def drop_column(spark: SparkSession, name: str, column: str) -> None:
    if column not in spark.table(name).columns:
        raise ValueError(f"no such column: {column}")
    parts = [c for c in _partitions(spark, name) if c != column]
    defaults = {c: e for c, e in (_property(spark, name, _DEFAULTS) or {}).items() if c != column}
    _rewrite(spark, name, lambda old: old.drop(column), constraints(spark, name).without(column), parts, defaults)


def rename_column(spark: SparkSession, name: str, old_name: str, new_name: str) -> None:
    swap = lambda c: new_name if c == old_name else c
    defaults = {swap(c): e for c, e in (_property(spark, name, _DEFAULTS) or {}).items()}
    _rewrite(spark, name, lambda old: old.withColumnRenamed(old_name, new_name), constraints(spark, name).renamed(old_name, new_name), [*map(swap, _partitions(spark, name))], defaults)


def set_default(spark: SparkSession, name: str, column: str, default: str | None) -> None:
    """The SQL expression that new rows without the column get; None: null."""
    found = {c: e for c, e in (_property(spark, name, _DEFAULTS) or {}).items() if c != column}
    _set_property(spark, name, _DEFAULTS, found | ({column: default} if default is not None else {}))


def alter_type(spark: SparkSession, name: str, column: str, kind: str, using: str | None = None) -> None:
    _rewrite(spark, name, lambda old: old.withColumn(column, F.expr(using or f"`{column}`").cast(kind)))


def add_constraint(spark: SparkSession, name: str, not_null: str | None = None, check: tuple[str, str] | None = None, unique: list[str] | None = None) -> None:
    """Add a constraint that the present rows keep to."""
    one = Constraints([not_null] if not_null else [], dict([check]) if check else {}, [unique] if unique else [])
    one.validate(spark.table(name))
    mine = constraints(spark, name)
    _keep(spark, name, Constraints([*mine.not_null, *one.not_null], mine.checks | one.checks, [*mine.unique, *one.unique]))


def drop_constraint(spark: SparkSession, name: str, not_null: str | None = None, check: str | None = None, unique: list[str] | None = None) -> None:
    mine = constraints(spark, name)
    mine = Constraints([c for c in mine.not_null if c != not_null], {n: e for n, e in mine.checks.items() if n != check}, [k for k in mine.unique if k != unique])
    _keep(spark, name, mine)


def rename_table(spark: SparkSession, name: str, new_name: str) -> None:
    """What the catalog keeps with the table goes along, partitions at their new places too."""
    spark.sql(f"ALTER TABLE {name} RENAME TO {new_name}")
    if _partitions(spark, new_name):
        place = next(r["data_type"] for r in spark.sql(f"DESCRIBE FORMATTED {new_name}").collect() if r["col_name"] == "Location")
        for (partition,) in spark.sql(f"SHOW PARTITIONS {new_name}").collect():
            pairs = [x.split("=", 1) for x in partition.split("/")]
            spec = ", ".join("`{}` = '{}'".format(c, unquote(v).replace("'", "\\'")) for c, v in pairs)
            spark.sql(f"ALTER TABLE {new_name} PARTITION ({spec}) SET LOCATION '{place}/{partition}'")
    spark.catalog.refreshTable(new_name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


# Views


def create_view(df: DataFrame, name: str) -> None:
    """A view of this session, with the columns and types that it has now."""
    df.createOrReplaceTempView(name)


def create_stored_view(spark: SparkSession, name: str, text: str, replace: bool = False) -> None:
    """A view that the catalog keeps, by its SQL text."""
    spark.sql(f"CREATE {'OR REPLACE ' if replace else ''}VIEW {name} AS {text}")


def drop_view(spark: SparkSession, name: str) -> bool:
    """Drop a view of the session, or else one that the catalog keeps; was there one?"""
    if spark.catalog.dropTempView(name):
        return True
    there = spark.catalog.tableExists(name)
    spark.sql(f"DROP VIEW IF EXISTS {name}")
    return there


def rename_view(spark: SparkSession, name: str, new_name: str) -> None:
    if spark.catalog.getTable(name).isTemporary:
        spark.table(name).createOrReplaceTempView(new_name)
        spark.catalog.dropTempView(name)
    else:
        spark.sql(f"ALTER VIEW {name} RENAME TO {new_name}")


def create_materialized_view(spark: SparkSession, name: str, text: str, with_data: bool = True) -> None:
    """A table with the result of a query, whose text the catalog keeps for refreshes."""
    create_table_as(spark.sql(text), name, with_data)
    _set_property(spark, name, _QUERY, text)


def refresh_materialized_view(spark: SparkSession, name: str) -> None:
    """Run the query again; names and types of the columns stay as they were."""
    text, schema = _property(spark, name, _QUERY), spark.table(name).schema
    if text is None:
        raise ValueError(f"{name} is not a materialized view")
    df = spark.sql(text)
    if df.columns != schema.names:
        raise ValueError("the query's columns have changed")
    typed = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])
    _rewrite(spark, name, lambda _: typed)
