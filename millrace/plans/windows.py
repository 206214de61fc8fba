"""Window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import aggregates as agg
from millrace.operators import relational as ops
from millrace.plans.registry import Registry, Tables

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql

_r.both("win_agg", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, max(o_totalprice) OVER (PARTITION BY o_custkey) AS m FROM {orders}")
_r.both("win_rank", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS rn, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS rk, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS dr FROM {part}", "SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS INTEGER) AS rn, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS INTEGER) AS rk, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS INTEGER) AS dr FROM part")
_r.both("win_lag_lead", "SELECT event_id, lag(value, 1) OVER w AS prev, lead(event_type, 2, 'none') OVER w AS ahead FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
_r.both("win_moving", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS s FROM {events}")
_r.both("win_range", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n FROM {orders}")
_r.both("win_first_last_nth", "SELECT event_id, first_value(event_id) OVER w AS f, last_value(event_id) OVER w AS l, nth_value(event_id, 2) OVER w AS n2 FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
_r.both("win_ntile_cume", "SELECT p_partkey, ntile(4) OVER w AS q, round(cume_dist() OVER w, 9) AS cd, round(percent_rank() OVER w, 9) AS pr FROM {part} WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey)", "SELECT p_partkey, CAST(ntile(4) OVER w AS INTEGER) AS q, round(cume_dist() OVER w, 9) AS cd, round(percent_rank() OVER w, 9) AS pr FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey)")


@_r.add("SELECT o_orderkey, count(DISTINCT o_orderpriority) OVER (PARTITION BY o_custkey) AS n FROM orders")
def win_count_distinct(t: Tables) -> DataFrame:
    return ops.count_distinct_over(t.orders.select("o_orderkey", "o_custkey", "o_orderpriority"), ["o_custkey"], F.col("o_orderpriority"), "n").select("o_orderkey", "n")


@_r.add("SELECT event_id, count(DISTINCT CASE WHEN event_type <> 'view' THEN event_type END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events")
def win_count_distinct_frame(t: Tables) -> DataFrame:
    x = F.when(F.col("event_type") != "view", F.col("event_type"))
    return t.events.select("event_id", agg.count_distinct_over(x, Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("n"))


@_r.add("SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s FROM part")
def win_groups(t: Tables) -> DataFrame:
    return ops.groups_frame_sum(t.part.select("p_partkey", "p_brand", "p_size"), ["p_brand"], "p_size", "p_size", 1, 1, "s").select("p_partkey", "s")


@_r.add("SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW) AS BIGINT) AS s FROM part")
def win_exclude_current(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", ops.sum_excluding_current("p_size", Window.partitionBy("p_brand")).alias("s"))
