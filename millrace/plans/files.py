"""COPY to files and from them, and the readers: each query writes a table's rows below the warehouse and reads them back."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import sinks, sources, tables
from millrace.plans.registry import Registry, Tables

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql


def place(t: Tables, name: str) -> str:
    """A path below the warehouse, which the driver and all executors share; one for each query and folder of tables."""
    root = t.spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if "://" not in root:
        root = root.removeprefix("file:")
    return f"{root}/millrace_plans/{PurePosixPath(t.sf_dir).name}/{name}"


_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"


@_r.add("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def read_parquet(t: Tables) -> DataFrame:
    """The filter and the three columns reach the scan."""
    rows = sources.read_parquet(t.spark, f"{t.sf_dir}/lineitem.parquet")
    return rows.where("l_quantity > 45 AND l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_extendedprice")


@_r.add(_ORDERS)
def copy_parquet(t: Tables) -> DataFrame:
    path = place(t, "copy.parquet")
    sinks.copy_to(t.orders, path)
    return sources.read_parquet(t.spark, path)


@_r.add(_ORDERS)
def copy_csv(t: Tables) -> DataFrame:
    """Delimiter, header and types are found again by the reader."""
    path = place(t, "copy.csv")
    sinks.copy_to(t.orders, path, timestampformat="%Y-%m-%d %H:%M:%S")
    return sources.read_csv(t.spark, path)


@_r.add("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name || '|\"x\"' END AS name, c_acctbal FROM customer")
def copy_csv_options(t: Tables) -> DataFrame:
    """Values that hold the delimiter and the quote, nulls by a word, no header."""
    path = place(t, "options.csv.gz")
    name = F.when(F.col("c_custkey") % 3 != 0, F.concat("c_name", F.lit('|"x"'))).alias("name")
    sinks.copy_to(t.customer.select("c_custkey", name, "c_acctbal"), path, delimiter="|", header=False, nullstr="NA")
    return sources.read_csv(t.spark, path, delim="|", header=False, names=["c_custkey", "name", "c_acctbal"], nullstr="NA")


@_r.add("SELECT n_nationkey, n_name || chr(10) || 'second, line' AS name FROM nation")
def read_csv_quoted_newlines(t: Tables) -> DataFrame:
    path = place(t, "lines.csv")
    sinks.copy_to(t.nation.select("n_nationkey", F.concat("n_name", F.lit("\nsecond, line")).alias("name")), path)
    return sources.read_csv(t.spark, path).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "name")


@_r.add("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def copy_json_lines(t: Tables) -> DataFrame:
    path = place(t, "copy.jsonl")
    sinks.copy_to(t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus"), path)
    return sources.read_json(t.spark, path)


@_r.add("SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_name, p_size % 7 AS size FROM part")
def copy_json_array(t: Tables) -> DataFrame:
    path = place(t, "array.json")
    sinks.copy_to(t.part.select("p_partkey", "p_name", (F.col("p_size") % 7).alias("size")), path, array=True)
    return sources.read_json(t.spark, path).select("p_partkey", "p_name", F.col("size").cast("int").alias("size"))


@_r.add("SELECT o_orderkey, o_totalprice, o_orderstatus, 'copy' AS part FROM orders WHERE o_orderstatus = 'F'")
def copy_partitioned(t: Tables) -> DataFrame:
    """Folders by a column; the filter on it prunes folders."""
    path = place(t, "parts")
    sinks.copy_to(t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus"), path, format="parquet", partition_by=["o_orderstatus"], overwrite=True)
    return sources.read_parquet(t.spark, path).where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice", "o_orderstatus", F.lit("copy").alias("part"))


@_r.add("SELECT p_partkey, p_name, CASE WHEN p_size > 25 THEN p_size END AS big, p_partkey % 2 = 0 AS even FROM part")
def read_union_by_name(t: Tables) -> DataFrame:
    """Files with different columns."""
    one, two = place(t, "named_1.parquet"), place(t, "named_2.parquet")
    even = (F.col("p_partkey") % 2 == 0).alias("even")
    sinks.copy_to(t.part.where("p_size > 25").select("p_partkey", "p_name", F.col("p_size").alias("big"), even), one)
    sinks.copy_to(t.part.where("p_size <= 25").select(even, "p_partkey", "p_name"), two)
    return sources.read_parquet(t.spark, [one, two], union_by_name=True).select("p_partkey", "p_name", "big", "even")


@_r.add("SELECT string_agg(r_name || chr(10), '' ORDER BY r_regionkey) AS content, CAST(sum(strlen(r_name) + 1) AS BIGINT) AS size, 'text.csv' AS name FROM region")
def read_text(t: Tables) -> DataFrame:
    path = place(t, "text.csv")
    sinks.copy_to(t.region.orderBy("r_regionkey").select("r_name"), path, header=False)
    return sources.read_text(t.spark, path).select("content", "size", F.element_at(F.split("filename", "/"), -1).alias("name"))


@_r.add("SELECT md5(string_agg(r_name || chr(10), '' ORDER BY r_regionkey)) AS digest, CAST(sum(strlen(r_name) + 1) AS BIGINT) AS size FROM region")
def read_blob(t: Tables) -> DataFrame:
    path = place(t, "blob.csv")
    sinks.copy_to(t.region.orderBy("r_regionkey").select("r_name"), path, header=False)
    return sources.read_blob(t.spark, path).select(F.md5("content").alias("digest"), "size")


@_r.add("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders UNION ALL SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0")
def copy_from(t: Tables) -> DataFrame:
    """COPY FROM two files, of two formats, into one table."""
    rows, table = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus"), "millrace_copy_from"
    csv, parquet = place(t, "from.csv"), place(t, "from.parquet")
    sinks.copy_to(rows, csv)
    sinks.copy_to(rows.where("o_orderkey % 2 = 0"), parquet)
    t.forget(table)
    tables.create_table(t.spark, table, "o_orderkey BIGINT, o_totalprice DOUBLE, o_orderstatus STRING")
    sinks.copy_from(t.spark, table, csv)
    sinks.copy_from(t.spark, table, parquet)
    return t.spark.table(table)


@_r.add("SELECT string_agg(n_nationkey || chr(9) || CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE '\\N' END || chr(10), '' ORDER BY n_nationkey) AS printed FROM nation")
def copy_to_stdout(t: Tables) -> DataFrame:
    rows = t.nation.orderBy("n_nationkey").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")))
    return t.spark.createDataFrame([(sinks.copy_to_stdout(rows),)], "printed string")


@_r.add("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 9000")
def join_table_with_file(t: Tables) -> DataFrame:
    """A catalog table, a temporary table and a file in one query."""
    path = place(t, "joined.parquet")
    sinks.copy_to(t.orders.select("o_orderkey", "o_custkey"), path)
    t.forget("millrace_join")
    tables.create_table_as(t.customer.select("c_custkey", "c_name"), "millrace_join")
    tables.create_temporary_table_as(t.customer.where("c_acctbal > 9000").select(F.col("c_custkey").alias("rich")), "millrace_rich")
    rows = sources.read_parquet(t.spark, path).join(t.spark.table("millrace_join"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.join(t.spark.table("millrace_rich"), F.col("c_custkey") == F.col("rich")).select("o_orderkey", "c_name")


@_r.add("SELECT o_orderkey, o_totalprice, o_orderstatus AS status FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 5 <> 0")
def delta_scan(t: Tables) -> DataFrame:
    """A table of three versions: files are added by status, one is removed, one is replaced."""
    root = place(t, "delta")
    rows = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    schema = {"type": "struct", "fields": [{"name": n, "type": k, "nullable": True, "metadata": {}} for n, k in (("o_orderkey", "long"), ("o_totalprice", "double"), ("status", "string"))]}
    log = [[{"metaData": {"id": "x", "schemaString": json.dumps(schema), "partitionColumns": ["status"]}}], [], []]
    for version, status, keep in ((0, "F", "true"), (0, "O", "true"), (0, "P", "true"), (1, "F", "o_orderkey % 5 <> 0"), (2, "O", "o_orderkey % 5 <> 0")):
        name = f"status={status}/v{version}.parquet"
        sinks.copy_to(rows.where((F.col("o_orderstatus") == status) & F.expr(keep)).drop("o_orderstatus"), f"{root}/{name}")
        if version:
            log[version].append({"remove": {"path": f"status={status}/v0.parquet", "dataChange": True}})
        log[version].append({"add": {"path": name, "partitionValues": {"status": status}, "size": 1, "modificationTime": 0, "dataChange": True}})
    log[1].append({"remove": {"path": "status=P/v0.parquet", "dataChange": True}})
    for version, actions in enumerate(log):
        lines = t.spark.createDataFrame([("\n".join(map(json.dumps, actions)),)], "value string")
        sinks.copy_to(lines, f"{root}/_delta_log/{version:020d}.json", format="text")
    return sources.delta_scan(t.spark, root).select("o_orderkey", "o_totalprice", "status")
