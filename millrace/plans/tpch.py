"""Decision-support queries over the star schema (the columns that the driver's tables have)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.registry import Registry, Tables

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql


def _revenue() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


@_r.add("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
  round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty,
  round(avg(l_extendedprice), 6) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus
""")
def q1(t: Tables) -> DataFrame:
    return (
        t.lineitem.where("l_shipdate <= timestamp_ntz'1998-09-02'")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
            F.round(F.sum(_revenue()), 2).alias("sum_disc_price"),
            F.round(F.sum(_revenue() * (1 + F.col("l_tax"))), 2).alias("sum_charge"),
            F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
            F.round(F.avg("l_extendedprice"), 6).alias("avg_price"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"),
            F.count("*").alias("count_order"),
        )
    )


_r.both(
    "q3",
    "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey "
    "WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP_NTZ'1998-03-15' AND l_shipdate > TIMESTAMP_NTZ'1998-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10",
    "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey "
    "WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10",
)
_r.both(
    "q5",
    "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {supplier} ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey "
    "JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name",
)
_r.both("q6", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM {lineitem} WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
_r.both(
    "q10",
    "SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, c_acctbal, n_name FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {nation} ON c_nationkey = n_nationkey "
    "WHERE l_returnflag = 'R' GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20",
)
_r.both("q13", "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_orderpriority <> '1-URGENT' GROUP BY c_custkey) x GROUP BY c_count")
_r.both(
    "q18",
    "SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, sum(l_quantity) AS qty FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON o_orderkey = l_orderkey "
    "WHERE o_orderkey IN (SELECT l_orderkey FROM {lineitem} GROUP BY l_orderkey HAVING sum(l_quantity) > 180) GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
)


# The shapes of the further queries, over the columns that there are: dates of receipt, ship modes, containers, phones and
# part suppliers are missing, so conditions on them are left out or stand on the ship date, the line status or a brand.
_REVENUE = "sum(l_extendedprice * (1 - l_discount))"  # has four digits after the point, and is rounded to those
_r.both(
    "q4",
    "SELECT o_orderpriority, count(*) AS order_count FROM {orders} WHERE o_orderdate >= DATE '1997-07-01' AND o_orderdate < DATE '1997-10-01' "
    "AND EXISTS (SELECT * FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY o_orderpriority",
)
_r.both(
    "q7",
    f"SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, year(l_shipdate) AS l_year, round({_REVENUE}, 4) AS revenue FROM {{supplier}} JOIN {{lineitem}} ON s_suppkey = l_suppkey JOIN {{orders}} ON o_orderkey = l_orderkey "
    "JOIN {customer} ON c_custkey = o_custkey JOIN {nation} n1 ON s_nationkey = n1.n_nationkey JOIN {nation} n2 ON c_nationkey = n2.n_nationkey "
    "WHERE n1.n_regionkey <> n2.n_regionkey AND l_shipdate BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' GROUP BY n1.n_name, n2.n_name, year(l_shipdate)",
    f"SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(year(l_shipdate) AS INTEGER) AS l_year, round({_REVENUE}, 4) AS revenue FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey "
    "JOIN customer ON c_custkey = o_custkey JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey "
    "WHERE n1.n_regionkey <> n2.n_regionkey AND l_shipdate BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' GROUP BY ALL",
)
_Q8 = (
    "SELECT o_year, round(sum(CASE WHEN n_name = 'NATION_2' THEN volume ELSE 0 END) / sum(volume), 8) AS mkt_share FROM (SELECT {year} AS o_year, l_extendedprice * (1 - l_discount) AS volume, n2.n_name AS n_name "
    "FROM {{part}} JOIN {{lineitem}} ON p_partkey = l_partkey JOIN {{supplier}} ON s_suppkey = l_suppkey JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} n1 ON c_nationkey = n1.n_nationkey "
    "JOIN {{region}} ON n1.n_regionkey = r_regionkey JOIN {{nation}} n2 ON s_nationkey = n2.n_nationkey WHERE r_name = 'AMERICA' AND p_type = 'ECONOMY') x GROUP BY o_year"
)
_r.both("q8", _Q8.format(year="year(o_orderdate)"), _Q8.format(year="CAST(year(o_orderdate) AS INTEGER)").replace("{", "").replace("}", ""))
_r.both(
    "q12",
    "SELECT l_linestatus, sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS high_line_count, sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS low_line_count "
    "FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey WHERE l_shipdate > o_orderdate AND l_shipdate >= DATE '1998-01-01' AND l_shipdate < DATE '1999-01-01' GROUP BY l_linestatus",
    "SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count, CAST(sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count "
    "FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate > o_orderdate AND l_shipdate >= DATE '1998-01-01' AND l_shipdate < DATE '1999-01-01' GROUP BY l_linestatus",
)
_r.both("q14", f"SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / {_REVENUE}, 8) AS promo_revenue FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey WHERE l_shipdate >= DATE '1997-09-01' AND l_shipdate < DATE '1997-10-01'")
_r.both(
    "q15",
    f"WITH revenue AS (SELECT l_suppkey AS supplier_no, round({_REVENUE}, 4) AS total_revenue FROM {{lineitem}} WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1997-04-01' GROUP BY l_suppkey) "
    "SELECT s_suppkey, s_name, total_revenue FROM {supplier} JOIN revenue ON s_suppkey = supplier_no WHERE total_revenue = (SELECT max(total_revenue) FROM revenue)",
)
_r.both("q17", "SELECT round(sum(l_extendedprice) / 7.0, 6) AS avg_yearly FROM {lineitem} l JOIN {part} ON p_partkey = l_partkey WHERE p_size < 10 AND l_quantity < (SELECT 0.4 * avg(l_quantity) FROM {lineitem} i WHERE i.l_partkey = p_partkey)")
_r.both(
    "q19",
    f"SELECT round({_REVENUE}, 4) AS revenue FROM {{lineitem}} JOIN {{part}} ON p_partkey = l_partkey WHERE (p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 21 AND p_size BETWEEN 1 AND 25) "
    "OR (p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 30 AND p_size BETWEEN 1 AND 40) OR (p_brand = 'Brand#4' AND l_quantity BETWEEN 20 AND 50 AND p_size BETWEEN 1 AND 50)",
)
_r.both(
    "q21",
    "SELECT s_name, count(*) AS numwait FROM {supplier} JOIN {lineitem} l1 ON s_suppkey = l1.l_suppkey JOIN {orders} ON o_orderkey = l1.l_orderkey WHERE o_orderstatus = 'F' AND l1.l_returnflag = 'R' "
    "AND EXISTS (SELECT * FROM {lineitem} l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey) "
    "AND NOT EXISTS (SELECT * FROM {lineitem} l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R') GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100",
)
_r.both(
    "q22",
    "SELECT c_nationkey, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM {customer} WHERE c_nationkey IN (1, 3, 5, 7, 9, 11, 13) AND c_acctbal > (SELECT avg(c_acctbal) FROM {customer} WHERE c_acctbal > 0.0) "
    "AND NOT EXISTS (SELECT * FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'P') GROUP BY c_nationkey",
)
