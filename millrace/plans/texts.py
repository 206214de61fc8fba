"""String, math and conditional functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import math, strings
from millrace.plans.registry import Registry, Tables

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql


@_r.add(r"SELECT p_partkey, regexp_replace(p_name, '[aeiou]', 'Z') AS one, regexp_replace(p_type, '(\w)(\w)', '\2\1') AS swap FROM part")
def regexp_replace_first(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", strings.regexp_replace(F.col("p_name"), "[aeiou]", "Z").alias("one"), strings.regexp_replace(F.col("p_type"), r"(\w)(\w)", r"\2\1").alias("swap"))


@_r.add("SELECT p_partkey, regexp_replace(p_name, '[AEIOU]', '*', 'gi') AS gi, regexp_replace(p_brand, 'BRAND', 'b', 'i') AS i, regexp_replace(p_name, 'a', 'A', 'g') AS g FROM part")
def regexp_replace_flags(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", strings.regexp_replace(F.col("p_name"), "[AEIOU]", "*", "gi").alias("gi"), strings.regexp_replace(F.col("p_brand"), "BRAND", "b", "i").alias("i"), strings.regexp_replace(F.col("p_name"), "a", "A", "g").alias("g"))


_r.both(
    "string_basics",
    "SELECT c_custkey, lower(c_name) AS lo, upper(c_mktsegment) AS up, length(c_name) AS n, substr(c_name, 2, 3) AS sub, c_name || '-' || c_mktsegment AS cat, replace(c_name, '0', '') AS rep, reverse(c_name) AS rev, "
    "trim('  x ') AS tr, lpad(c_mktsegment, 12, '*') AS lp, rpad(c_mktsegment, 12, '*') AS rp, left(c_name, 4) AS le, right(c_name, 4) AS ri, md5(c_name) AS md, repeat('ab', 3) AS rept, ascii(c_name) AS asc1, translate(c_mktsegment, 'AE', 'ae') AS trn FROM {customer}",
    "SELECT c_custkey, lower(c_name) AS lo, upper(c_mktsegment) AS up, CAST(length(c_name) AS INTEGER) AS n, substr(c_name, 2, 3) AS sub, c_name || '-' || c_mktsegment AS cat, replace(c_name, '0', '') AS rep, reverse(c_name) AS rev, "
    "trim('  x ') AS tr, lpad(c_mktsegment, 12, '*') AS lp, rpad(c_mktsegment, 12, '*') AS rp, left(c_name, 4) AS le, right(c_name, 4) AS ri, md5(c_name) AS md, repeat('ab', 3) AS rept, ascii(c_name) AS asc1, translate(c_mktsegment, 'AE', 'ae') AS trn FROM customer",
)
_r.both(
    "string_more",
    "SELECT c_custkey, concat_ws(',', c_name, c_mktsegment) AS cw, split_part(c_name, '#', 2) AS sp, locate('#', c_name) AS pos, sha2(c_name, 256) AS sha, octet_length(c_name) AS ol, bit_length(c_name) AS bl, startswith(c_name, 'C') AS sw, chr(65 + c_nationkey) AS ch FROM {customer}",
    "SELECT c_custkey, concat_ws(',', c_name, c_mktsegment) AS cw, split_part(c_name, '#', 2) AS sp, CAST(position('#' IN c_name) AS INTEGER) AS pos, sha256(c_name) AS sha, CAST(strlen(c_name) AS INTEGER) AS ol, CAST(bit_length(c_name) AS INTEGER) AS bl, starts_with(c_name, 'C') AS sw, chr(65 + c_nationkey) AS ch FROM customer",
)
_r.both(
    "math_basics",
    "SELECT l_orderkey, l_linenumber, abs(l_tax - 0.05) AS a, sign(l_discount - 0.05) AS s, ceil(l_quantity / 3) AS c, floor(l_quantity / 3) AS f, round(sqrt(l_quantity), 9) AS q, round(power(l_tax, 2), 9) AS p, round(ln(l_quantity), 9) AS l, round(log10(l_quantity), 9) AS lt, round(exp(l_tax), 9) AS e, "
    "mod(l_orderkey, 7) AS m, round(sin(l_tax), 9) AS si, round(atan2(l_tax, 2), 9) AS at, round(degrees(l_tax), 6) AS dg, round(cbrt(l_quantity), 9) AS cb, l_linenumber & 3 AS ba, l_linenumber | 8 AS bo FROM {lineitem}",
    "SELECT l_orderkey, l_linenumber, abs(l_tax - 0.05) AS a, CAST(sign(l_discount - 0.05) AS DOUBLE) AS s, CAST(ceil(l_quantity / 3) AS BIGINT) AS c, CAST(floor(l_quantity / 3) AS BIGINT) AS f, round(sqrt(l_quantity), 9) AS q, round(power(l_tax, 2), 9) AS p, round(ln(l_quantity), 9) AS l, round(log10(l_quantity), 9) AS lt, round(exp(l_tax), 9) AS e, "
    "mod(l_orderkey, 7) AS m, round(sin(l_tax), 9) AS si, round(atan2(l_tax, 2), 9) AS at, round(degrees(l_tax), 6) AS dg, round(cbrt(l_quantity), 9) AS cb, l_linenumber & 3 AS ba, l_linenumber | 8 AS bo FROM lineitem",
)
_r.both("case_coalesce", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END AS s, coalesce(nullif(o_orderpriority, '5-LOW'), 'low') AS p, greatest(o_custkey, o_orderkey) AS g, least(o_custkey, o_orderkey) AS l FROM {orders}")


@_r.add("SELECT l_orderkey, l_linenumber, CAST(l_quantity / 4 AS INTEGER) AS rounded, TRY_CAST(l_returnflag AS INTEGER) AS tried, CAST(l_orderkey AS VARCHAR) AS txt, CAST(l_shipdate AS DATE) AS d FROM lineitem")
def casts(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", strings.rounded_int(F.col("l_quantity") / 4).alias("rounded"), F.col("l_returnflag").try_cast("int").alias("tried"), F.col("l_orderkey").cast("string").alias("txt"), F.col("l_shipdate").cast("date").alias("d"))


@_r.add("SELECT p_partkey, array_to_string(string_split(p_name, ' '), '.') AS parts, CAST(len(string_split(p_type, 'A')) AS INTEGER) AS n FROM part")
def string_arrays(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(strings.string_to_array(F.col("p_name"), " "), ".").alias("parts"), F.size(strings.string_to_array(F.col("p_type"), "A")).alias("n"))


@_r.add("SELECT c_custkey, replace(replace(url_encode(c_name || ' ä~*'), '+', '%20'), '*', '%2A') AS u FROM customer")
def escape_uri(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", strings.escape_uri(F.concat("c_name", F.lit(" ä~*"))).alias("u"))


@_r.add("SELECT o_orderkey, gcd(o_orderkey, o_custkey) AS g, lcm(o_orderkey, o_custkey) AS l, CAST(trunc(o_totalprice / 7) AS DOUBLE) AS t, log10(o_totalprice) AS lg, CAST(trunc(o_orderkey / 7.0) AS BIGINT) AS d FROM orders")
def math_more(t: Tables) -> DataFrame:
    key, cust, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    return t.orders.select("o_orderkey", math.gcd(key, cust).alias("g"), math.lcm(key, cust).alias("l"), math.trunc(price / 7).alias("t"), math.log(price).alias("lg"), math.div(key, F.lit(7)).alias("d"))


@_r.add("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS c, CAST(datediff('day', DATE '2023-12-01', CAST(ts AS DATE)) AS INTEGER) AS dd FROM events")
def to_char(t: Tables) -> DataFrame:
    return t.events.select("event_id", math.to_char(F.col("ts"), "YYYY-MM-DD HH24:MI:SS").alias("c"), F.datediff(F.col("ts").cast("date"), F.lit("2023-12-01").cast("date")).alias("dd"))


@_r.add("SELECT n_nationkey, array_to_string(list_prepend(n_nationkey, [1, 2]), ',') AS p, n_nationkey IN (1, 2, 3) AS a, list_position([5, n_regionkey, 7], 7) AS pos, array_to_string(list_sort(list_distinct([n_regionkey, 1, 1])), ',') AS u, array_to_string(regexp_split_to_array(n_name, '[AEIOU]'), '.') AS s FROM nation")
def array_more(t: Tables) -> DataFrame:
    key = F.col("n_nationkey")
    two = F.array(F.lit(1), F.lit(2))
    return t.nation.select(
        "n_nationkey",
        F.array_join(math.array_prepend(two, key), ",").alias("p"),
        math.any_equal(key, F.array(F.lit(1), F.lit(2), F.lit(3))).alias("a"),
        F.array_position(F.array(F.lit(5), F.col("n_regionkey"), F.lit(7)), F.lit(7)).cast("int").alias("pos"),
        F.array_join(F.array_sort(F.array_distinct(F.array(F.col("n_regionkey"), F.lit(1), F.lit(1)))), ",").alias("u"),
        F.array_join(math.regexp_split_to_array(F.col("n_name"), "[AEIOU]"), ".").alias("s"),
    )
