"""Aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import aggregates as agg
from millrace.operators import relational as ops
from millrace.plans.registry import Registry, Tables

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql

_r.both("agg_basic", "SELECT l_returnflag, count(*) AS n, count(l_tax) AS nt, round(sum(l_quantity), 2) AS s, round(avg(l_discount), 8) AS a, min(l_shipdate) AS lo, max(l_extendedprice) AS hi FROM {lineitem} GROUP BY l_returnflag")
_r.both("agg_global", "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s FROM {orders}")
_r.both("agg_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n, count(DISTINCT o_orderpriority) AS p FROM {orders} GROUP BY o_orderstatus")
_r.both("agg_filter", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS big, round(sum(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT'), 2) AS urgent FROM {orders} GROUP BY o_orderstatus")
_r.both("agg_having", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 12")
_r.both("agg_expression_ordinal", "SELECT o_custkey % 10 AS k, count(*) AS n FROM {orders} GROUP BY 1")
_r.both("grouping_sets", "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
_r.both("rollup", "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
_r.both("cube", "SELECT o_orderstatus AS s, o_orderpriority AS p, CAST(grouping(o_orderstatus) AS INT) AS gs, CAST(grouping(o_orderpriority) AS INT) AS gp, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)")
_r.both(
    "agg_stats",
    "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sp, round(var_samp(l_tax), 8) AS vs, round(var_pop(l_tax), 8) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS c, "
    "round(covar_pop(l_quantity, l_tax), 6) AS cp, round(covar_samp(l_quantity, l_tax), 6) AS cs, round(regr_slope(l_extendedprice, l_quantity), 4) AS rs, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM {lineitem} GROUP BY l_returnflag",
)
_r.both(
    "agg_percentile",
    "SELECT l_returnflag, percentile_cont(0.5) WITHIN GROUP (ORDER BY l_extendedprice) AS med, percentile_disc(0.9) WITHIN GROUP (ORDER BY l_quantity) AS p90 FROM {lineitem} GROUP BY l_returnflag",
)
_r.both("agg_bool_bit", "SELECT o_orderstatus, bool_and(o_totalprice > 1000) AS ba, bool_or(o_totalprice > 200000) AS bo, bit_and(o_custkey) AS xa, bit_or(o_custkey) AS xo, bit_xor(o_custkey) AS xx FROM {orders} GROUP BY o_orderstatus")


@_r.add("SELECT o_custkey, arg_max(o_orderkey, struct_pack(p := o_totalprice, k := o_orderkey)) AS hi, arg_min(o_orderkey, struct_pack(p := o_totalprice, k := o_orderkey)) AS lo FROM orders GROUP BY o_custkey")
def arg_max(t: Tables) -> DataFrame:
    key = F.struct("o_totalprice", "o_orderkey")
    return t.orders.groupBy("o_custkey").agg(agg.arg_max(F.col("o_orderkey"), key).alias("hi"), agg.arg_min(F.col("o_orderkey"), key).alias("lo"))


@_r.add("SELECT k, arg_max(v, o_orderkey) AS plain, arg_max_null(v, o_orderkey) AS with_null, arg_min_null(v, o_orderkey) AS low_null FROM (SELECT o_custkey % 20 AS k, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders) GROUP BY k")
def arg_max_null(t: Tables) -> DataFrame:
    rows = t.orders.select((F.col("o_custkey") % 20).alias("k"), "o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("v"))
    v, key = F.col("v"), F.col("o_orderkey")
    return rows.groupBy("k").agg(agg.arg_max(v, key).alias("plain"), agg.arg_max_null(v, key).alias("with_null"), agg.arg_min_null(v, key).alias("low_null"))


@_r.add("SELECT o_orderstatus, array_to_string(arg_max(o_custkey, o_orderkey, 3), ',') AS top, array_to_string(arg_min(o_custkey, o_orderkey, 3), ',') AS low FROM orders GROUP BY o_orderstatus")
def arg_max_n(t: Tables) -> DataFrame:
    v, key = F.col("o_custkey"), F.col("o_orderkey")
    return t.orders.groupBy("o_orderstatus").agg(F.array_join(agg.arg_max_n(v, key, 3), ",").alias("top"), F.array_join(agg.arg_min_n(v, key, 3), ",").alias("low"))


@_r.add("SELECT o_orderstatus, array_to_string(arg_max(o_custkey, o_orderkey, 3), ',') AS top, array_to_string(arg_min(o_custkey, o_orderkey, 3), ',') AS low FROM orders GROUP BY o_orderstatus")
def arg_max_n_grouped(t: Tables) -> DataFrame:
    """The same with ranks that are limited before the shuffle."""
    v, key = F.col("o_custkey"), F.col("o_orderkey")
    top = agg.grouped_top_n(t.orders, ["o_orderstatus"], v, key, 3, "top")
    low = agg.grouped_top_n(t.orders, ["o_orderstatus"], v, key, 3, "low", descending=False)
    return top.join(low, "o_orderstatus").select("o_orderstatus", F.array_join("top", ",").alias("top"), F.array_join("low", ",").alias("low"))


@_r.add("SELECT o_orderstatus, array_to_string(max(o_orderkey, 4), ',') AS hi, array_to_string(min(o_orderkey, 4), ',') AS lo FROM orders GROUP BY o_orderstatus")
def min_n_max_n(t: Tables) -> DataFrame:
    x = F.col("o_orderkey")
    return t.orders.groupBy("o_orderstatus").agg(F.array_join(agg.max_n(x, 4), ",").alias("hi"), F.array_join(agg.min_n(x, 4), ",").alias("lo"))


@_r.add("SELECT o_custkey, first(o_totalprice ORDER BY o_orderkey) AS f, last(o_totalprice ORDER BY o_orderkey) AS l FROM orders GROUP BY o_custkey")
def first_last_ordered(t: Tables) -> DataFrame:
    x, order = F.col("o_totalprice"), F.col("o_orderkey")
    return t.orders.groupBy("o_custkey").agg(agg.first(x, order).alias("f"), agg.last(x, order).alias("l"))


@_r.add("SELECT o_custkey, array_to_string(list(coalesce(CAST(v AS VARCHAR), 'NULL') ORDER BY o_orderkey), ',') AS items, len(list(v)) AS n FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey END AS v FROM orders) GROUP BY o_custkey")
def list_ordered(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey")).alias("v"))
    items = agg.array_agg(F.col("v"), F.col("o_orderkey"))
    return rows.groupBy("o_custkey").agg(F.array_join(items, ",", "NULL").alias("items"), F.size(items).cast("bigint").alias("n"))


@_r.add("SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def string_agg_ordered(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(agg.string_agg(F.col("n_name"), "|").alias("names"))


@_r.add("SELECT o_orderstatus, k, CAST(v AS BIGINT) AS v FROM (SELECT o_orderstatus, unnest(map_keys(h)) AS k, unnest(map_values(h)) AS v FROM (SELECT o_orderstatus, histogram(o_orderpriority) AS h FROM orders GROUP BY o_orderstatus))")
def histogram(t: Tables) -> DataFrame:
    grouped = agg.grouped_histogram(t.orders, ["o_orderstatus"], F.col("o_orderpriority"), "h")
    return grouped.select("o_orderstatus", F.explode("h").alias("k", "v"))


_ENTRIES = "SELECT g, unnest(map_keys(h)) AS k, CAST(unnest(map_values(h)) AS BIGINT) AS v FROM ({})"


@_r.add(_ENTRIES.format("SELECT o_custkey % 5 AS g, histogram(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 11 END) AS h FROM orders GROUP BY 1"))
def histogram_column(t: Tables) -> DataFrame:
    x = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 11)
    return t.orders.groupBy((F.col("o_custkey") % 5).alias("g")).agg(agg.histogram(x).alias("h")).select("g", F.explode("h").alias("k", "v"))


@_r.add(_ENTRIES.format("SELECT l_returnflag AS g, histogram(l_quantity, [10, 25, 50]) AS h FROM lineitem GROUP BY 1 UNION ALL SELECT l_linestatus, histogram(l_quantity, [7, 30]) FROM lineitem GROUP BY 1"))
def histogram_bins(t: Tables) -> DataFrame:
    q = F.col("l_quantity")
    both = t.lineitem.groupBy(F.col("l_returnflag").alias("g")).agg(agg.histogram_bins(q, [10, 25, 50]).alias("h"))
    both = both.unionByName(t.lineitem.groupBy(F.col("l_linestatus").alias("g")).agg(agg.histogram_bins(q, [7, 30]).alias("h")))
    return both.select("g", F.explode("h").alias("k", "v"))


@_r.add(_ENTRIES.format("SELECT l_returnflag AS g, histogram_exact(l_linenumber, [1, 3]) AS h FROM lineitem GROUP BY 1"))
def histogram_exact(t: Tables) -> DataFrame:
    found = t.lineitem.groupBy(F.col("l_returnflag").alias("g")).agg(agg.histogram_exact(F.col("l_linenumber"), [1, 3], "int").alias("h"))
    return found.select("g", F.explode("h").alias("k", "v"))


@_r.add("SELECT n_regionkey, round(product(1 + n_nationkey / 100.0), 9) AS p FROM nation GROUP BY n_regionkey")
def product(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(F.round(agg.product(1 + F.col("n_nationkey") / 100.0), 9).alias("p"))


@_r.add("SELECT l_returnflag, round(geomean(l_extendedprice), 4) AS g FROM lineitem GROUP BY l_returnflag")
def geomean(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.round(agg.geomean(F.col("l_extendedprice")), 4).alias("g"))


@_r.add("SELECT l_returnflag, round(fsum(l_discount), 9) AS s, round(favg(l_discount), 12) AS a, round(fsum(CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE -1 END * l_extendedprice * l_partkey), 4) AS c FROM lineitem GROUP BY l_returnflag")
def fsum_favg(t: Tables) -> DataFrame:
    signed = F.when(F.col("l_orderkey") % 2 == 0, 1).otherwise(-1) * F.col("l_extendedprice") * F.col("l_partkey")
    return t.lineitem.groupBy("l_returnflag").agg(F.round(agg.fsum(F.col("l_discount")), 9).alias("s"), F.round(agg.favg(F.col("l_discount")), 12).alias("a"), F.round(agg.fsum(signed), 4).alias("c"))


@_r.add("SELECT n_regionkey, CAST(bitstring_agg(n_nationkey, 0, 24) AS VARCHAR) AS bits FROM nation GROUP BY n_regionkey")
def bitstring_agg(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(agg.bitstring_agg(F.col("n_nationkey"), 0, 24).alias("bits"))


@_r.add("SELECT o_orderstatus, count(DISTINCT o_custkey) > 0 AS within FROM orders GROUP BY o_orderstatus")
def approx_count_distinct(t: Tables) -> DataFrame:
    """Is the estimate within four of its standard errors of the count?"""
    near = F.abs(agg.approx_count_distinct(F.col("o_custkey")) - F.count_distinct("o_custkey")) <= 0.2 * F.count_distinct("o_custkey")
    return t.orders.groupBy("o_orderstatus").agg(near.alias("within"))


@_r.add("SELECT o_orderstatus, CAST(sum(o_orderkey * 1000000000) AS DECIMAL(38,0)) AS s FROM orders GROUP BY o_orderstatus")
def sum_wide(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(agg.wide_sum(F.col("o_orderkey").cast("decimal(38,0)") * 1000000000).cast("decimal(38,0)").alias("s"))


@_r.add("SELECT * FROM (PIVOT orders ON o_orderstatus IN ('F', 'O', 'P') USING count(*) GROUP BY o_orderpriority)")
def pivot(t: Tables) -> DataFrame:
    return ops.pivot(t.orders, ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"], F.count(F.lit(1))).na.fill(0)


_r.both("agg_mode_moments", "SELECT n_regionkey, round(skewness(n_nationkey), 6) AS sk FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, round((sum(pow(n_nationkey - m, 3)) / count(*)) / pow(sum(pow(n_nationkey - m, 2)) / count(*), 1.5), 6) AS sk FROM nation JOIN (SELECT n_regionkey, avg(n_nationkey) AS m FROM nation GROUP BY 1) USING (n_regionkey) GROUP BY n_regionkey")
_r.both("agg_kurtosis", "SELECT n_regionkey, round(kurtosis(n_nationkey), 6) AS k FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, round(kurtosis_pop(n_nationkey), 6) AS k FROM nation GROUP BY n_regionkey")
_r.both("agg_mode", "SELECT o_custkey % 3 AS g, mode(CASE WHEN o_orderkey % 2 = 0 THEN 'even' WHEN o_orderkey % 5 = 0 THEN 'five' ELSE 'odd' END) AS m FROM {orders} GROUP BY 1")
_r.both("agg_first_any", "SELECT o_custkey, any_value(o_custkey * 2) AS a, CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS f, max(DISTINCT o_orderpriority) AS mx FROM {orders} GROUP BY o_custkey")
