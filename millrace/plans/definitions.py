"""Tables, views and changes of rows: each query makes a table below the warehouse, changes it and returns it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import sql, tables
from millrace.explain import explain
from millrace.plans.registry import Registry, Tables

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql


def _fresh(t: Tables, name: str, rows: DataFrame, **options) -> str:
    """A new table with these rows, in place of the one of an earlier run."""
    name = f"millrace_{name}"
    t.forget(name)
    tables.create_table_as(rows, name, **options)
    return name


@_r.add("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def create_table_as(t: Tables) -> DataFrame:
    name = _fresh(t, "ctas", t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n")))
    return t.spark.table(name)


@_r.add("SELECT c_custkey, c_name, 'new' AS state, 1.5 * c_custkey AS score FROM customer")
def insert_defaults(t: Tables) -> DataFrame:
    """Stored defaults, which may name other columns' rows only by value: an expression for each new row."""
    name = "millrace_defaults"
    t.forget(name)
    tables.create_table(t.spark, name, "c_custkey BIGINT, c_name STRING, state STRING, score DOUBLE", defaults={"state": "'new'"})
    tables.insert(t.customer.select("c_custkey", "c_name", F.col("c_custkey") * 1.5), name, ["c_custkey", "c_name", "score"])
    return t.spark.table(name)


@_r.add("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + o_custkey ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 3 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END AS o_orderstatus, o_custkey FROM orders")
def update_rows(t: Tables) -> DataFrame:
    name = _fresh(t, "update", t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus", "o_custkey"))
    tables.update(t.spark, name, {"o_totalprice": "o_totalprice + o_custkey", "o_orderstatus": "lower(o_orderstatus)"}, "o_orderkey % 3 = 0")
    return t.spark.table(name)


@_r.add("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE NOT (o_totalprice > 100000 AND o_orderkey % 2 = 0)")
def delete_rows(t: Tables) -> DataFrame:
    """The table is partitioned, and is so afterwards."""
    name = _fresh(t, "delete", t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus"), partition_by=["o_orderstatus"])
    tables.delete(t.spark, name, "o_totalprice > 100000 AND o_orderkey % 2 = 0")
    if [c.name for c in t.spark.catalog.listColumns(name) if c.isPartition] != ["o_orderstatus"]:
        raise AssertionError("partitions are gone")
    return t.spark.table(name)


@_r.add("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 3")
def truncate_table(t: Tables) -> DataFrame:
    name = _fresh(t, "truncate", t.nation.select("n_nationkey", "n_name"))
    tables.truncate(t.spark, name)
    tables.insert(t.nation.where("n_nationkey < 3").select("n_nationkey", "n_name"), name)
    return t.spark.table(name)


@_r.add("SELECT CAST(c_custkey AS VARCHAR) AS customer, c_acctbal, 5 AS extra FROM customer")
def alter_table(t: Tables) -> DataFrame:
    """Columns are added, dropped, renamed and changed in type; the table is renamed."""
    name = _fresh(t, "alter", t.customer.select("c_custkey", "c_name", "c_acctbal"))
    tables.add_column(t.spark, name, "extra", "int", "5")
    tables.drop_column(t.spark, name, "c_name")
    tables.alter_type(t.spark, name, "c_custkey", "string")
    tables.rename_column(t.spark, name, "c_custkey", "customer")
    t.forget("millrace_altered")
    tables.rename_table(t.spark, name, "millrace_altered")
    return t.spark.table("millrace_altered")


@_r.add("SELECT 'c' AS what, 3 AS refused, count(*) AS kept FROM customer")
def table_constraints(t: Tables) -> DataFrame:
    """Rows that break a constraint are refused as a whole insert."""
    name = "millrace_constraints"
    t.forget(name)
    rules = tables.Constraints(not_null=["c_custkey"], checks={"key": "c_custkey >= 0"}, unique=[["c_custkey"]])
    tables.create_table(t.spark, name, "c_custkey BIGINT, c_name STRING", rules)
    rows = t.customer.select("c_custkey", "c_name")
    tables.insert(rows, name)
    refused = 0
    for bad in (rows.select(F.lit(None).cast("bigint").alias("c_custkey"), "c_name"), rows.select((-1 - F.col("c_custkey")).alias("c_custkey"), "c_name"), rows):
        try:
            tables.insert(bad, f"default.{name}" if t.spark.catalog.currentDatabase() == "default" else name)
        except tables.ConstraintViolation:
            refused += 1
    return t.spark.table(name).agg(F.lit("c").alias("what"), F.lit(refused).alias("refused"), F.count("*").alias("kept"))


@_r.add("SELECT k, count(*) AS n FROM (SELECT n_regionkey AS k FROM nation UNION ALL SELECT n_regionkey FROM nation WHERE n_nationkey < 7) GROUP BY k")
def materialized_view(t: Tables) -> DataFrame:
    """The result is stored; a refresh sees the rows that came meanwhile."""
    source = _fresh(t, "mv_source", t.nation.select("n_nationkey", "n_regionkey"))
    t.forget("millrace_mv")
    tables.create_materialized_view(t.spark, "millrace_mv", f"SELECT n_regionkey AS k, count(*) AS n FROM {source} GROUP BY n_regionkey")
    tables.insert(t.nation.where("n_nationkey < 7").select("n_nationkey", "n_regionkey"), source)
    tables.refresh_materialized_view(t.spark, "millrace_mv")
    return t.spark.table("millrace_mv")


@_r.add("SELECT r_regionkey, count(n_nationkey) AS n FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey")
def stored_view(t: Tables) -> DataFrame:
    nations, regions = _fresh(t, "view_n", t.nation), _fresh(t, "view_r", t.region)
    tables.create_stored_view(t.spark, "millrace_view", f"SELECT r_regionkey, count(n_nationkey) AS n FROM {regions} LEFT JOIN {nations} ON r_regionkey = n_regionkey GROUP BY r_regionkey", replace=True)
    return t.spark.table("millrace_view")


@_r.add("SELECT o_orderkey, '$1' AS s FROM orders WHERE o_custkey = 7 OR o_orderstatus = 'P' AND o_orderkey < 500")
def prepared_statement(t: Tables) -> DataFrame:
    name = _fresh(t, "prepared", t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"))
    statement = sql.prepare(t.spark, f"SELECT o_orderkey, '$1' AS s FROM {name} WHERE o_custkey = $1 OR o_orderstatus = $2 AND o_orderkey < $3", ["bigint", "string", "bigint"])
    statement.execute(1, "F", 2)
    return statement.execute(7, "P", 500)


@_r.add("SELECT 'orders' AS what, true AS pruned, true AS pushed")
def explain_plan(t: Tables) -> DataFrame:
    """EXPLAIN of a query shows that a filter and two columns reach the scan."""
    text = explain(t.orders.where("o_custkey = 7").select("o_orderkey"))
    return t.spark.range(1).select(F.lit("orders").alias("what"), F.lit("o_totalprice" not in text).alias("pruned"), F.lit("EqualTo(o_custkey,7)" in text).alias("pushed"))


def _sql(t: Tables, text: str, **frames: DataFrame) -> DataFrame:
    return sql.sql(t.spark, text, **frames)


@_r.add(
    "SELECT event_id, time_bucket(INTERVAL '7 days', ts) AS w, time_bucket(INTERVAL '90 minutes', ts) AS m, time_bucket(INTERVAL '3 months', ts) AS q, epoch(ts) AS e, epoch_ms(ts) AS ms, epoch_us(ts) AS us, epoch_ns(ts) AS ns, CAST(isodow(ts) AS INTEGER) AS d FROM events"
)
def sql_time_functions(t: Tables) -> DataFrame:
    text = "SELECT event_id, time_bucket(INTERVAL '7' DAY, ts) AS w, time_bucket(INTERVAL '90' MINUTE, ts) AS m, time_bucket_months(3, ts) AS q, epoch(ts) AS e, epoch_ms(ts) AS ms, epoch_us(ts) AS us, epoch_ns(ts) AS ns, isodow(ts) AS d FROM {events}"
    return _sql(t, text, events=t.events)


@_r.add("SELECT event_id, json_valid(props) AS v, json_exists(props, '$.k') AS x, json_extract_string(props, '$.k') AS k, array_to_string(json_keys(props), ',') AS keys, json_type(props) AS kind, json_type(json_extract(props, '$.k')) AS inner_kind FROM events")
def sql_json_functions(t: Tables) -> DataFrame:
    text = "SELECT event_id, json_valid(props) AS v, json_exists(props, '$.k') AS x, json_extract_string(props, '$.k') AS k, array_join(json_keys(props), ',') AS keys, json_type(props) AS kind, json_type(json_extract_string(props, '$.k')) AS inner_kind FROM {events}"
    return _sql(t, text, events=t.events)


@_r.add(
    "SELECT c_custkey, prefix(c_name, 'Cust') AS p, suffix(c_name, '7') AS s, starts_with(c_mktsegment, 'B') AS st, regexp_matches(c_mktsegment, '^[A-H]') AS r, len(string_split(c_name, '#')) AS n, strpos(c_name, '#') AS at, "
    "replace(replace(url_encode(c_name || ' *'), '+', '%20'), '*', '%2A') AS u, CAST(c_acctbal / 2 AS INTEGER) AS half, map_extract_value(MAP {'a': c_name}, 'a') AS mv, array_to_string(map_extract(MAP {'a': c_name}, 'b'), ',') AS none, 'arbitrary(x)' AS text FROM customer"
)
def sql_text_functions(t: Tables) -> DataFrame:
    text = (
        "SELECT c_custkey, prefix(c_name, 'Cust') AS p, suffix(c_name, '7') AS s, starts_with(c_mktsegment, 'B') AS st, regexp_matches(c_mktsegment, '^[A-H]') AS r, CAST(array_length(string_split(c_name, '#')) AS BIGINT) AS n, CAST(strpos(c_name, '#') AS BIGINT) AS at, "
        "escape_uri(c_name || ' *') AS u, rounded_int(c_acctbal / 2) AS half, map_extract_value(map('a', c_name), 'a') AS mv, array_join(map_extract(map('a', c_name), 'b'), ',') AS none, 'arbitrary(x)' AS text FROM {customer} AS c WHERE c['c_custkey'] >= 0"
    )
    return _sql(t, text, customer=t.customer)


@_r.add("SELECT o_orderstatus, arg_max_null(o_orderkey, o_totalprice) AS hi, arg_min_null(o_orderkey, o_totalprice) AS lo, round(quantile_cont(o_totalprice, 0.5), 6) AS med, round(variance(o_totalprice), 2) AS v, arbitrary(o_orderstatus) AS a FROM orders GROUP BY o_orderstatus")
def sql_aggregates(t: Tables) -> DataFrame:
    text = "SELECT o_orderstatus, arg_max_null(o_orderkey, o_totalprice) AS hi, arg_min_null(o_orderkey, o_totalprice) AS lo, round(quantile_cont(o_totalprice, 0.5), 6) AS med, round(variance(o_totalprice), 2) AS v, arbitrary(o_orderstatus) AS a FROM {orders} GROUP BY o_orderstatus"
    return _sql(t, text, orders=t.orders)
