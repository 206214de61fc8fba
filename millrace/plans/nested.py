"""Maps, unions, structs and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import maps
from millrace.plans.registry import Registry, Tables

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql

#: A map for each nation, with a key that only every second one has.
_MAPS = "(SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN MAP {'a': n_nationkey, 'b': n_regionkey, 'c': 7} ELSE MAP {'a': n_nationkey, 'b': n_regionkey} END AS m FROM nation) x"


def _maps(t: Tables) -> DataFrame:
    two = [F.lit("a"), F.col("n_nationkey"), F.lit("b"), F.col("n_regionkey")]
    return t.nation.select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.create_map(*two, F.lit("c"), F.lit(7))).otherwise(F.create_map(*two)).alias("m"))


@_r.add(f"SELECT n_nationkey, array_to_string(CASE WHEN map_contains(m, 'c') THEN [m['c']] ELSE [] END, ',') AS c, CAST(len(CASE WHEN map_contains(m, 'c') THEN [m['c']] ELSE [] END) AS INTEGER) AS n FROM {_MAPS}")
def map_extract(t: Tables) -> DataFrame:
    x = maps.map_extract(F.col("m"), F.lit("c"))
    return _maps(t).select("n_nationkey", F.array_join(x, ",").alias("c"), F.size(x).alias("n"))


@_r.add(f"SELECT n_nationkey, map_extract_value(m, 'c') AS c, map_extract_value(m, 'a') AS a FROM {_MAPS}")
def map_extract_value(t: Tables) -> DataFrame:
    return _maps(t).select("n_nationkey", maps.map_extract_value(F.col("m"), F.lit("c")).alias("c"), maps.map_extract_value(F.col("m"), F.lit("a")).alias("a"))


@_r.add(f"SELECT n_nationkey, array_to_string(list_sort(map_keys(m)), ',') AS k, array_to_string(map_values(m), ',') AS v FROM {_MAPS}")
def map_keys_values(t: Tables) -> DataFrame:
    return _maps(t).select("n_nationkey", F.array_join(F.array_sort(maps.map_keys(F.col("m"))), ",").alias("k"), F.array_join(maps.map_values(F.col("m")), ",").alias("v"))


@_r.add(f"SELECT n_nationkey, c['a'] AS a, c['b'] AS b, c['z'] AS z, CAST(cardinality(c) AS INTEGER) AS n FROM (SELECT n_nationkey, map_concat(m, MAP {{'b': 100, 'z': 1}}) AS c FROM {_MAPS})")
def map_concat(t: Tables) -> DataFrame:
    other = F.create_map(F.lit("b"), F.lit(100), F.lit("z"), F.lit(1))
    c = F.col("c")
    return _maps(t).select("n_nationkey", maps.map_concat(F.col("m"), other).alias("c")).select("n_nationkey", c["a"].alias("a"), c["b"].alias("b"), c["z"].alias("z"), maps.cardinality(c).alias("n"))


@_r.add(f"SELECT n_nationkey, map_contains(m, 'c') AS k, map_contains_entry(m, 'b', 2) AS e, map_contains_value(m, 7) AS v FROM {_MAPS}")
def map_contains_all3(t: Tables) -> DataFrame:
    m = F.col("m")
    return _maps(t).select("n_nationkey", maps.map_contains(m, F.lit("c")).alias("k"), maps.map_contains_entry(m, F.lit("b"), F.lit(2)).alias("e"), maps.map_contains_value(m, F.lit(7)).alias("v"))


@_r.add(f"SELECT n_nationkey, array_to_string(list_transform(map_entries(map_from_entries(map_entries(m))), lambda e: e.key || '=' || e.value), ',') AS e FROM {_MAPS}")
def map_entries_roundtrip(t: Tables) -> DataFrame:
    again = maps.map_entries(maps.map_from_entries(maps.map_entries(F.col("m"))))
    return _maps(t).select("n_nationkey", F.array_join(F.transform(again, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("e"))


@_r.add(f"SELECT n_nationkey, CAST(cardinality(m) AS INTEGER) AS n FROM {_MAPS}")
def map_cardinality(t: Tables) -> DataFrame:
    return _maps(t).select("n_nationkey", maps.cardinality(F.col("m")).alias("n"))


@_r.add("SELECT n_nationkey, CAST(union_tag(u) AS VARCHAR) AS tag, union_extract(u, 'num') AS num, union_extract(u, 'str') AS str FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN CAST(union_value(num := n_nationkey) AS UNION(num INTEGER, str VARCHAR)) ELSE CAST(union_value(str := n_name) AS UNION(num INTEGER, str VARCHAR)) END AS u FROM nation)")
def union_tag_extract(t: Tables) -> DataFrame:
    members = {"num": "int", "str": "string"}
    u = F.when(F.col("n_nationkey") % 2 == 0, maps.union_value(members, "num", F.col("n_nationkey"))).otherwise(maps.union_value(members, "str", F.col("n_name")))
    rows = t.nation.select("n_nationkey", u.alias("u"))
    return rows.select("n_nationkey", maps.union_tag(F.col("u")).alias("tag"), maps.union_extract(F.col("u"), "num").alias("num"), maps.union_extract(F.col("u"), "str").alias("str"))


_r.both("struct_field", "SELECT n_nationkey, s.a AS a, s.b.c AS c FROM (SELECT n_nationkey, named_struct('a', n_name, 'b', named_struct('c', n_regionkey + 1)) AS s FROM {nation}) x", "SELECT n_nationkey, s.a AS a, s.b.c AS c FROM (SELECT n_nationkey, {'a': n_name, 'b': {'c': n_regionkey + 1}} AS s FROM nation) x")


@_r.add("SELECT n_nationkey, array_to_string(a[2:3], ',') AS sl, a[1] AS f, a[9] AS none FROM (SELECT n_nationkey, [n_nationkey, n_regionkey, 5, 6] AS a FROM nation)")
def array_slice_index(t: Tables) -> DataFrame:
    rows = t.nation.select("n_nationkey", F.array("n_nationkey", "n_regionkey", F.lit(5), F.lit(6)).alias("a"))
    a = F.col("a")
    return rows.select("n_nationkey", F.array_join(maps.list_slice(a, 2, 3), ",").alias("sl"), maps.list_element(a, 1).alias("f"), maps.list_element(a, 9).alias("none"))


@_r.add("SELECT n_nationkey, list_has_all([n_nationkey, n_regionkey, 5], [1, 5]) AS has FROM nation")
def array_contains_all(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", maps.contains_all(F.array("n_nationkey", "n_regionkey", F.lit(5)), F.array(F.lit(1), F.lit(5))).alias("has"))


_r.both("unnest_ordinality", "SELECT n_nationkey, pos + 1 AS ord, w FROM (SELECT n_nationkey, posexplode(array(n_name, 'x', 'y')) AS (pos, w) FROM {nation}) x", "SELECT n_nationkey, CAST(unnest([1, 2, 3]) AS INTEGER) AS ord, unnest([n_name, 'x', 'y']) AS w FROM nation")
_r.both("list_functions", "SELECT vec_id, size(embedding) AS n, round(array_max(embedding), 5) AS hi FROM {embeddings}", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, round(list_max(embedding), 5) AS hi FROM embeddings")
