"""Scans, filters, joins, set operations, sorting and subqueries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import strings
from millrace.operators import relational as ops
from millrace.plans.registry import Registry, Tables
from millrace.sources import read_parquet

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql

# ------------------------------------------------------------------------------------------- scans and filters

_r.both("scan_project", "SELECT o_orderkey, o_custkey AS cust, o_totalprice * 2 AS twice, upper(o_orderstatus) AS status FROM {orders}")
_r.both("filter_compare", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice >= 50000.0 AND o_totalprice < 150000.0 AND o_orderstatus <> 'F'")
_r.both("filter_between_null", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_quantity BETWEEN 10 AND 20 AND l_discount IS NOT NULL AND NOT (l_tax IS NULL)")
_r.both("filter_in_notin", "SELECT o_orderkey FROM {orders} WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('P', 'X')")
_r.both("is_distinct_from", "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') IS DISTINCT FROM 'MACHINERY' AS differs, nullif(c_nationkey, 3) IS NOT DISTINCT FROM nullif(3, 3) AS same FROM {customer}")
_r.both("predicates_logic", "SELECT p_partkey FROM {part} WHERE (p_size > 10 OR p_brand = 'Brand#13') AND NOT (p_size = 20) AND p_retailprice IS NOT NULL")
_r.both("arithmetic", "SELECT l_orderkey, l_linenumber, l_linenumber % 3 AS md, -l_linenumber AS neg, l_extendedprice / l_quantity AS unit, l_quantity * l_tax - l_discount + 1 AS x FROM {lineitem}")


@_r.add(r"SELECT p_partkey, p_name LIKE '%e\_%' ESCAPE '\' AS under, p_type LIKE '%A%' ESCAPE '\' AS has_a, p_brand LIKE 'Brand$#1%' ESCAPE '$' AS brand_one, p_name NOT LIKE '%a%' ESCAPE '\' AS no_a FROM part")
def filter_like_escape(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", strings.like(F.col("p_name"), r"%e\_%").alias("under"), strings.like(F.col("p_type"), "%A%").alias("has_a"), strings.like(F.col("p_brand"), "Brand$#1%", "$").alias("brand_one"), (~strings.like(F.col("p_name"), "%a%")).alias("no_a"))


@_r.add(r"SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'bUiL%' ESCAPE '\' AND c_name NOT ILIKE '%CUSTOMER#00000000_' ESCAPE '\'")
def filter_ilike(t: Tables) -> DataFrame:
    return t.customer.where(strings.ilike(F.col("c_mktsegment"), "bUiL%") & ~strings.ilike(F.col("c_name"), "%CUSTOMER#00000000_")).select("c_custkey")


@_r.add("SELECT p_partkey, regexp_matches(p_type, 'ST[A-E]') AS st, NOT regexp_matches(p_name, '[0-3]+$') AS no_tail FROM part")
def filter_regex(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", strings.regexp_matches(F.col("p_type"), "ST[A-E]").alias("st"), (~strings.regexp_matches(F.col("p_name"), "[0-3]+$")).alias("no_tail"))


@_r.add("SELECT p_partkey FROM part WHERE regexp_full_match(p_brand, 'Brand#(1|2).')")
def filter_similar_to(t: Tables) -> DataFrame:
    return t.part.where(strings.similar_to(F.col("p_brand"), "Brand#(1|2)_")).select("p_partkey")


_r.both("filter_contains_prefix_suffix", "SELECT c_custkey, contains(c_name, '99') AS c, startswith(c_name, 'Cust') AS p, endswith(c_name, '7') AS s FROM {customer}", "SELECT c_custkey, contains(c_name, '99') AS c, prefix(c_name, 'Cust') AS p, suffix(c_name, '7') AS s FROM customer")


@_r.add("SELECT * FROM nation")
def sample_full(t: Tables) -> DataFrame:
    return ops.sample(t.nation, 100)


@_r.add("SELECT * FROM nation WHERE false")
def sample_none(t: Tables) -> DataFrame:
    return ops.sample(t.nation, 0, seed=1)


@_r.add("SELECT l_linestatus, true AS near, true AS there FROM lineitem GROUP BY l_linestatus")
def sample_bernoulli(t: Tables) -> DataFrame:
    """Is a sample of a tenth within six of its standard deviations of a tenth, and are all its rows rows of the table?"""
    line = lambda df: df.select("l_linestatus", F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("r"))
    whole = line(t.lineitem).groupBy("l_linestatus").agg(F.count("*").alias("n"))
    part = line(ops.sample(t.lineitem, 10, seed=42))
    known = line(t.lineitem).select(F.col("r").alias("known")).distinct()
    part = part.join(known, F.col("r") == F.col("known"), "left").groupBy(F.col("l_linestatus").alias("s")).agg(F.count("*").alias("k"), F.every(F.col("known").isNotNull()).alias("there"))
    near = F.abs(F.col("k") - F.col("n") / 10) <= 6 * F.sqrt(F.col("n") * 0.09)
    return whole.join(part, F.col("l_linestatus") == F.col("s")).select("l_linestatus", near.alias("near"), "there")


@_r.add("SELECT CAST(100 AS BIGINT) AS n, CAST(100 AS BIGINT) AS n_distinct, true AS there")
def sample_rows(t: Tables) -> DataFrame:
    chosen = ops.sample_rows(t.orders.select("o_orderkey"), 100, seed=7)
    known = t.orders.select(F.col("o_orderkey").alias("known"))
    return chosen.join(known, F.col("o_orderkey") == F.col("known"), "left").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("n_distinct"), F.every(F.col("known").isNotNull()).alias("there"))


@_r.add("SELECT o_orderkey, 'orders.parquet' AS filename, true AS sized, row_number() OVER () - 1 AS file_row_number FROM orders")
def file_metadata_cols(t: Tables) -> DataFrame:
    rows = read_parquet(t.spark, f"{t.sf_dir}/orders.parquet", filename=True, file_row_number=True)
    return rows.select("o_orderkey", F.element_at(F.split("filename", "/"), -1).alias("filename"), (F.col("_metadata.file_size") > 0).alias("sized"), "file_row_number")


_r.both("generate_series", "SELECT id AS n, id * id AS sq FROM range(1, 101)", "SELECT generate_series AS n, generate_series * generate_series AS sq FROM generate_series(1, 100)")
_r.both("values_list", "SELECT a, b FROM VALUES (1, 'x'), (2, 'y'), (3, NULL) AS t(a, b)", "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS t(a, b)")
_r.both("star_except", "SELECT * EXCEPT (c_name, c_acctbal) FROM {customer}", "SELECT * EXCLUDE (c_name, c_acctbal) FROM customer")

# ------------------------------------------------------------------------------------------- joins

_r.both("join_inner", "SELECT o_orderkey, c_name, o_totalprice FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE c_acctbal > 0")
_r.both("join_comma", "SELECT n_name, r_name FROM {nation}, {region} WHERE n_regionkey = r_regionkey")
_r.both("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
_r.both("join_right", "SELECT n_nationkey, s_suppkey FROM {supplier} RIGHT JOIN {nation} ON s_nationkey = n_nationkey AND s_acctbal > 5000")
_r.both("join_full", "SELECT s.s_suppkey AS sk, c.c_custkey AS ck FROM (SELECT * FROM {supplier} WHERE s_suppkey <= 60) s FULL OUTER JOIN (SELECT * FROM {customer} WHERE c_custkey BETWEEN 30 AND 90) c ON s.s_suppkey = c.c_custkey")
_r.both("join_cross", "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}")
_r.both("join_semi_in", "SELECT c_custkey FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 100000)")
_r.both("join_semi_exists", "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
_r.both("join_anti_not_exists", "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 80000)")
_r.both("join_not_in_null_aware", "SELECT count(*) AS n FROM {customer} WHERE c_nationkey NOT IN (SELECT nullif(n_nationkey, 5) FROM {nation} WHERE n_nationkey > 3)")
_r.both("join_self", "SELECT a.n_name AS a_name, b.n_name AS b_name FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < 10 AND b.n_nationkey >= 10")
_r.both("join_using", "SELECT o_orderkey, cust_n FROM {orders} JOIN (SELECT o_orderkey, count(*) AS cust_n FROM {orders} GROUP BY o_orderkey) x USING (o_orderkey)")
_r.both("join_natural", "SELECT n_name, k FROM {nation} NATURAL JOIN (SELECT n_nationkey, n_nationkey * 2 AS k FROM {nation} WHERE n_nationkey < 7) x")
_r.both("join_lateral", "SELECT c_custkey, k FROM {customer}, LATERAL (SELECT c_custkey + c_nationkey AS k) x WHERE k % 2 = 0")
_r.both("join_generate_series", "SELECT n_nationkey, id FROM {nation} JOIN range(0, 10) ON n_nationkey = id", "SELECT n_nationkey, g AS id FROM nation JOIN (SELECT unnest(generate_series(0, 9)) AS g) x ON n_nationkey = g")
_r.both(
    "join_multiway_star",
    "SELECT r_name, n_name, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey "
    "JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY r_name, n_name",
)


@_r.add("SELECT p_partkey, s_suppkey FROM part JOIN (SELECT s_suppkey, s_acctbal AS lo, s_acctbal + 20 AS hi FROM supplier) s ON p_retailprice BETWEEN lo AND hi")
def join_theta_range(t: Tables) -> DataFrame:
    ranges = t.supplier.select("s_suppkey", F.col("s_acctbal").alias("lo"), (F.col("s_acctbal") + 20).alias("hi"))
    return ops.range_join(t.part.select("p_partkey", "p_retailprice"), ranges, "p_retailprice", "lo", "hi", 50).select("p_partkey", "s_suppkey")


_ASOF = "SELECT event_id, p.pid FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT user_id, ts AS vts, max(event_id) AS pid FROM events WHERE event_type = 'view' GROUP BY user_id, ts) p ON e.user_id = p.user_id AND e.ts >= p.vts"


@_r.add(_ASOF)
def join_asof(t: Tables) -> DataFrame:
    left = t.events.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    right = t.events.where("event_type = 'view'").groupBy("user_id", F.col("ts").alias("vts")).agg(F.max("event_id").alias("pid"))
    return ops.asof_join(left, right, ["user_id"], "ts", "vts").select("event_id", "pid")


@_r.add(_ASOF)
def join_asof_hot_keys(t: Tables) -> DataFrame:
    """The same with every key's times cut into ranges."""
    left = t.events.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    right = t.events.where("event_type = 'view'").groupBy("user_id", F.col("ts").alias("vts")).agg(F.max("event_id").alias("pid"))
    return ops.asof_join(left, right, ["user_id"], "ts", "vts", slices=8).select("event_id", "pid")


@_r.add("SELECT n_name, r_name FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS p FROM nation) FULL JOIN (SELECT *, row_number() OVER (ORDER BY r_regionkey DESC) AS p FROM region) USING (p)")
def join_positional(t: Tables) -> DataFrame:
    return ops.positional_join(t.nation, t.region, [F.col("n_nationkey").asc()], [F.col("r_regionkey").desc()]).select("n_name", "r_name")


# ------------------------------------------------------------------------------------------- sets, sorting, subqueries

_r.both("union_all", "SELECT n_nationkey AS k, 'n' AS src FROM {nation} UNION ALL SELECT r_regionkey, 'r' FROM {region}")
_r.both("union_distinct", "SELECT n_regionkey AS k FROM {nation} UNION SELECT r_regionkey + 2 FROM {region}")
_r.both("intersect", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}")
_r.both("intersect_all", "SELECT n_regionkey AS k FROM {nation} INTERSECT ALL SELECT s_nationkey FROM {supplier} WHERE s_nationkey < 5")
_r.both("except", "SELECT p_size AS k FROM {part} EXCEPT SELECT n_nationkey FROM {nation}")
_r.both("except_all", "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}")


@_r.add("SELECT id, o_orderkey FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderkey % 97 END AS id FROM orders) ORDER BY id DESC NULLS FIRST, o_orderkey LIMIT 500")
def topk_nulls(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderkey") % 97).alias("id"))
    return ops.order_by(rows, "-id", "o_orderkey").limit(500).select("id", "o_orderkey")


_r.both("limit_offset", "SELECT c_custkey FROM {customer} ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 10")


@_r.add("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(t: Tables) -> DataFrame:
    return ops.distinct_on(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "-o_totalprice", "o_orderkey")


@_r.add("SELECT p_partkey, p_size FROM (SELECT *, rank() OVER (ORDER BY p_size DESC) AS r FROM part) WHERE r <= 10")
def fetch_with_ties(t: Tables) -> DataFrame:
    return ops.with_ties(t.part.select("p_partkey", "p_size"), 10, "-p_size")


_r.both("distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM {orders}")
_r.both("cte", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM {orders} GROUP BY o_custkey), top AS (SELECT * FROM big WHERE total > 200000) SELECT c_name, round(total, 2) AS total FROM top JOIN {customer} ON o_custkey = c_custkey")
_r.both("cte_recursive", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")


@_r.add("WITH RECURSIVE reach(k) AS (SELECT 0 UNION SELECT (k * 7 + d) % 25 FROM reach, (VALUES (1), (3)) v(d)) SELECT CAST(k AS INTEGER) AS k FROM reach")
def cte_recursive_union(t: Tables) -> DataFrame:
    seed = t.spark.sql("SELECT 0 AS k")
    return ops.recursive_distinct(seed, lambda new: new.select(F.explode(F.array((F.col("k") * 7 + 1) % 25, (F.col("k") * 7 + 3) % 25)).alias("k")))


_r.both("subquery_scalar", "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM {orders})")
_r.both("subquery_correlated", "SELECT o_orderkey FROM {orders} o WHERE o_totalprice = (SELECT max(o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)")
_r.both("derived_table_star", "SELECT * FROM (SELECT *, n_nationkey + 1 AS k FROM (SELECT n_nationkey, n_name FROM {nation}) a) b WHERE k > 3")


@_r.add("SELECT o_orderkey, n FROM (SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n > 12")
def win_qualify(t: Tables) -> DataFrame:
    return ops.qualify(t.orders.select("o_orderkey", "o_custkey"), "n", F.count("*").over(Window.partitionBy("o_custkey")), "n > 12").select("o_orderkey", "n")


_r.both("row_comparison", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE struct(l_quantity, l_linenumber) < struct(CAST(5 AS DOUBLE), 3)", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity, l_linenumber) < (CAST(5 AS DOUBLE), 3)")
_r.both("subquery_all_any", "SELECT p_partkey FROM {part} WHERE p_retailprice > (SELECT max(s_acctbal) / 8 FROM {supplier}) OR p_size IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 1)", "SELECT p_partkey FROM part WHERE p_retailprice > ALL (SELECT s_acctbal / 8 FROM supplier) OR p_size = ANY (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
_r.both("collation", "SELECT c_custkey FROM {customer} WHERE c_mktsegment COLLATE UTF8_LCASE = 'building'", "SELECT c_custkey FROM customer WHERE c_mktsegment COLLATE NOCASE = 'building'")


@_r.add("SELECT n_name AS name, n_nationkey AS k, NULL::VARCHAR AS extra FROM nation UNION ALL SELECT r_name, NULL, 'r' FROM region")
def union_by_name(t: Tables) -> DataFrame:
    a = t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return ops.union_by_name(a, t.region.select(F.col("r_name").alias("name"), F.lit("r").alias("extra")))


@_r.add("SELECT n_nationkey, name, value FROM (UNPIVOT (SELECT n_nationkey, CAST(n_regionkey AS BIGINT) AS a, CAST(n_nationkey * 2 AS BIGINT) AS b FROM nation) ON a, b INTO NAME name VALUE value)")
def unpivot(t: Tables) -> DataFrame:
    rows = t.nation.selectExpr("n_nationkey", "CAST(n_regionkey AS BIGINT) AS a", "CAST(n_nationkey * 2 AS BIGINT) AS b")
    return ops.unpivot(rows, ["n_nationkey"], ["a", "b"])


_SETS = {"some": "c_custkey % 7 = 0", "none": "c_custkey < 0", "nulls": "c_custkey % 5 = 0"}
_SET_SQL = {"some": "SELECT c_acctbal * 20 FROM customer WHERE c_custkey % 7 = 0", "none": "SELECT c_acctbal FROM customer WHERE c_custkey < 0", "nulls": "SELECT CASE WHEN c_custkey % 2 = 0 THEN c_acctbal * 20 END FROM customer WHERE c_custkey % 5 = 0"}


@_r.add("SELECT o_orderkey, " + ", ".join(f"x {op} {q} ({_SET_SQL[k]}) AS {k}_{q}_{i}" for k in _SETS for q in ("ALL", "ANY") for i, op in enumerate((">", "<="))) + " FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS x FROM orders)")
def compare_all_any(t: Tables) -> DataFrame:
    """Comparisons with ALL and ANY of a set with values, an empty one and one with nulls."""
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice")).alias("x"))
    for k, condition in _SETS.items():
        value = F.col("c_acctbal") * 20
        values = t.customer.where(condition).select((F.when(F.col("c_custkey") % 2 == 0, value) if k == "nulls" else value).alias("v"))
        for q in ("ALL", "ANY"):
            for i, op in enumerate((">", "<=")):
                rows = ops.compare_subquery(rows, F.col("x"), op, q, values, f"{k}_{q}_{i}")
    return rows.drop("x")
