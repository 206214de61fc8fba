"""JSON functions over events.props and over documents made from other columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import json as js
from millrace.plans.registry import Registry, Tables

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql

#: A document for each order: a scalar of each kind, an array and an object.
_DOC_SQL = """(SELECT o_orderkey, '{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '","neg":-' || (o_orderkey % 9 + 1) || ',"half":' || (o_orderkey % 7) || '.5,"ok":' || CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END || ',"no":null,"tags":["a",' || (o_orderkey % 5) || '],"sub":{"k":"' || o_orderpriority || '","n":' || (o_orderkey % 3) || '}}' AS j FROM orders) d"""


def _docs(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    parts = [
        '{"id":', key, ',"status":"', F.col("o_orderstatus"), '","neg":-', key % 9 + 1, ',"half":', key % 7, '.5,"ok":', F.when(key % 2 == 0, "true").otherwise("false"),
        ',"no":null,"tags":["a",', key % 5, '],"sub":{"k":"', F.col("o_orderpriority"), '","n":', key % 3, "}}",
    ]
    return t.orders.select("o_orderkey", F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).alias("j"))


def _j() -> Column:
    return F.col("j")


@_r.add("SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, CAST(json_extract(props, '$.none') AS VARCHAR) AS missing FROM events")
def json_extract(t: Tables) -> DataFrame:
    p = F.col("props")
    return t.events.select("event_id", js.json_extract(p, "$.k").alias("k"), js.json_extract(p, "$.none").alias("missing"))


@_r.add(f"SELECT o_orderkey, CAST(json_extract(j, '$.status') AS VARCHAR) AS s, CAST(json_extract(j, '$.tags[1]') AS VARCHAR) AS e, CAST(json_extract(j, '$.sub.n') AS VARCHAR) AS n FROM {_DOC_SQL}")
def json_extract_paths(t: Tables) -> DataFrame:
    x = js.json_extract(_j(), ["$.status", "$.tags[1]", "$.sub.n"])
    return _docs(t).select("o_orderkey", x[0].alias("s"), x[1].alias("e"), x[2].alias("n"))


#: Arrays, objects, repeated keys, numbers as they are written, and places from the end.
_ODD_SQL = """(SELECT o_orderkey, '{ "z": [' || o_orderkey % 7 || ', 1e3, {"b":1.50, "a":"x\\"y"}], "k":' || o_orderkey % 5 || ', "a": {"y":"' || o_orderstatus || '","x":[[1,2],[3]]}, "k":"again", "n": null }' AS j FROM orders) d"""
_ODD_PATHS = ("$", "$.z", "$.z[2]", "$.z[2].a", "$.z[-1]", "$.z[#-2]", "$.z[-9]", "$.k", "$.a", "/a/x/0", "/z/2/b", "$.n", "$.none")
_ODD_LISTS = ("$.z[*]", "$.a.*", "$.a.x[*][*]", "$.a.x[*][0]", "$.k[*]", "$.none.*")


@_r.add(f"SELECT o_orderkey, {', '.join(f'CAST(json_extract(j, {p!r}) AS VARCHAR) AS p{i}' for i, p in enumerate(_ODD_PATHS))}, {', '.join(f'array_to_string(CAST(json_extract(j, {p!r}) AS VARCHAR[]), chr(124)) AS l{i}' for i, p in enumerate(_ODD_LISTS))}, json_valid(j) AS v FROM {_ODD_SQL}")
def json_extract_whole(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    parts = ['{ "z": [', key % 7, ', 1e3, {"b":1.50, "a":"x\\"y"}], "k":', key % 5, ', "a": {"y":"', F.col("o_orderstatus"), '","x":[[1,2],[3]]}, "k":"again", "n": null }']
    docs = t.orders.select("o_orderkey", F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).alias("j"))
    lists = [F.array_join(js.json_extract(_j(), p), "|").alias(f"l{i}") for i, p in enumerate(_ODD_LISTS)]
    return docs.select("o_orderkey", *[js.json_extract(_j(), p).alias(f"p{i}") for i, p in enumerate(_ODD_PATHS)], *lists, js.json_valid(_j()).alias("v"))


@_r.add(f"SELECT o_orderkey, json_extract_string(j, '$.status') AS s, json_extract_string(j, 'id') AS i, json_extract_string(j, '$.sub') AS o FROM {_DOC_SQL}")
def json_extract_string(t: Tables) -> DataFrame:
    return _docs(t).select("o_orderkey", js.json_extract_string(_j(), "$.status").alias("s"), js.json_extract_string(_j(), "id").alias("i"), js.json_extract_string(_j(), "$.sub").alias("o"))


@_r.add(f"SELECT o_orderkey, CAST(json_value(j, '$.status') AS VARCHAR) AS s, CAST(json_value(j, '$.tags') AS VARCHAR) AS a, CAST(json_value(j, '$.ok') AS VARCHAR) AS b FROM {_DOC_SQL}")
def json_value(t: Tables) -> DataFrame:
    return _docs(t).select("o_orderkey", js.json_value(_j(), "$.status").alias("s"), js.json_value(_j(), "$.tags").alias("a"), js.json_value(_j(), "$.ok").alias("b"))


@_r.add(f"SELECT o_orderkey, json_exists(j, '$.sub.k') AS a, json_exists(j, '$.nothing') AS b FROM {_DOC_SQL}")
def json_exists(t: Tables) -> DataFrame:
    return _docs(t).select("o_orderkey", js.json_exists(_j(), "$.sub.k").alias("a"), js.json_exists(_j(), "$.nothing").alias("b"))


_KINDS = ("id", "status", "neg", "half", "ok", "no", "tags", "sub")


@_r.add(f"SELECT o_orderkey, json_type(j) AS root, {', '.join(f'json_type(j, {k!r}) AS t_{k}' for k in _KINDS)} FROM {_DOC_SQL}")
def json_type(t: Tables) -> DataFrame:
    return _docs(t).select("o_orderkey", js.json_type(_j()).alias("root"), *[js.json_type(_j(), k).alias(f"t_{k}") for k in _KINDS])


@_r.add(f"SELECT o_orderkey, array_to_string(json_keys(j), ',') AS root, array_to_string(json_keys(j, 'sub'), ',') AS sub FROM {_DOC_SQL}")
def json_keys(t: Tables) -> DataFrame:
    return _docs(t).select("o_orderkey", F.array_join(js.json_keys(_j()), ",").alias("root"), F.array_join(js.json_keys(_j(), "sub"), ",").alias("sub"))


@_r.add(f"SELECT o_orderkey, CAST(json_array_length(j, '$.tags') AS BIGINT) AS n, CAST(json_array_length(j, '$.sub') AS BIGINT) AS z FROM {_DOC_SQL}")
def json_array_length(t: Tables) -> DataFrame:
    return _docs(t).select("o_orderkey", js.json_array_length(_j(), "$.tags").alias("n"), js.json_array_length(_j(), "$.sub").alias("z"))


@_r.add("SELECT event_id, json_valid(props) AS good, json_valid(substr(props, 1, 4)) AS bad FROM events")
def json_valid(t: Tables) -> DataFrame:
    return t.events.select("event_id", js.json_valid(F.col("props")).alias("good"), js.json_valid(F.substring("props", 1, 4)).alias("bad"))


@_r.add(f"SELECT o_orderkey, json_contains(j, '\"a\"') AS tag, json_contains(j, '2') AS two, json_contains(j, '{{\"n\":1}}') AS obj FROM {_DOC_SQL}")
def json_contains(t: Tables) -> DataFrame:
    return _docs(t).select("o_orderkey", js.json_contains(_j(), F.lit('"a"')).alias("tag"), js.json_contains(_j(), F.lit("2")).alias("two"), js.json_contains(_j(), F.lit('{"n":1}')).alias("obj"))


@_r.add(f"SELECT o_orderkey, CAST(json_structure(j) AS VARCHAR) AS s FROM {_DOC_SQL}")
def json_structure(t: Tables) -> DataFrame:
    return _docs(t).select("o_orderkey", js.json_structure(_j()).alias("s"))


@_r.add(f"SELECT o_orderkey, x.id AS id, x.status AS status, CAST(x.half AS DOUBLE) AS half, x.sub.n AS n, x.nope AS nope FROM (SELECT o_orderkey, json_transform(j, '{{\"id\":\"BIGINT\",\"status\":\"VARCHAR\",\"half\":\"DOUBLE\",\"sub\":{{\"n\":\"INTEGER\"}},\"nope\":\"VARCHAR\"}}') AS x FROM {_DOC_SQL})")
def json_transform(t: Tables) -> DataFrame:
    x = js.json_transform(_j(), '{"id":"BIGINT","status":"VARCHAR","half":"DOUBLE","sub":{"n":"INTEGER"},"nope":"VARCHAR"}')
    return _docs(t).select("o_orderkey", x.alias("x")).select("o_orderkey", "x.id", "x.status", "x.half", "x.sub.n", "x.nope")


@_r.add("SELECT n_regionkey, CAST(json_group_array(n_name) AS VARCHAR) AS a FROM (SELECT * FROM nation ORDER BY n_nationkey) GROUP BY n_regionkey")
def json_group_array(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(js.json_group_array(F.col("n_name"), F.col("n_nationkey")).alias("a"))


@_r.add("SELECT n_regionkey, CAST(json_group_object(k, v) AS VARCHAR) AS o FROM (SELECT n_regionkey, substr(n_name, 1, 1) AS k, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_name END AS v FROM nation ORDER BY k, v NULLS FIRST) GROUP BY n_regionkey")
def json_group_object(t: Tables) -> DataFrame:
    """Keys repeat, values are null in part."""
    name = F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name"))
    return t.nation.groupBy("n_regionkey").agg(js.json_group_object(F.substring("n_name", 1, 1), name).alias("o"))


@_r.add(f"SELECT o_orderkey % 4 AS g, CAST(json_group_structure(CAST(j AS JSON)) AS VARCHAR) AS s FROM {_DOC_SQL} GROUP BY 1")
def json_group_structure(t: Tables) -> DataFrame:
    return _docs(t).groupBy((F.col("o_orderkey") % 4).alias("g")).agg(js.json_group_structure(_j()).alias("s"))


@_r.add("SELECT event_id, CAST(json('{ \"z\" : ' || event_id || ', \"a\": [1, 2 ] }') AS VARCHAR) AS m FROM events")
def json_minify(t: Tables) -> DataFrame:
    return t.events.select("event_id", js.json_minify(F.concat(F.lit('{ "z" : '), F.col("event_id").cast("string"), F.lit(', "a": [1, 2 ] }'))).alias("m"))
