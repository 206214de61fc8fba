"""Date and time functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import time as tm
from millrace.plans.registry import Registry, Tables

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql


def _buckets(name: str, width: str, oracle: str, **how: str) -> None:
    def run(t: Tables) -> DataFrame:
        return t.events.groupBy(tm.time_bucket(width, F.col("ts"), **how).alias("b")).agg(F.count("*").alias("n"))

    _r.add(f"SELECT {oracle} AS b, count(*) AS n FROM events GROUP BY 1", name)(run)


_buckets("time_bucket_minutes", "10 minutes", "time_bucket(INTERVAL '10 minutes', ts)")
_buckets("time_bucket_week", "7 days", "time_bucket(INTERVAL '7 days', ts)")
_buckets("time_bucket_offset", "7 days", "time_bucket(INTERVAL '7 days', ts, INTERVAL '2 days')", offset="2 days")
_buckets("time_bucket_origin", "1 day", "time_bucket(INTERVAL '1 day', ts, TIMESTAMP '2022-12-25 06:00:00')", origin="2022-12-25 06:00:00")
_buckets("time_bucket_tz", "1 day", "timezone('UTC', time_bucket(INTERVAL '1 day', timezone('UTC', ts), 'America/New_York'))", timezone="America/New_York")


def _months(name: str, width: str, oracle: str, **how: str) -> None:
    def run(t: Tables) -> DataFrame:
        return t.orders.groupBy(tm.time_bucket(width, F.col("o_orderdate"), **how).alias("b")).agg(F.count("*").alias("n"))

    _r.add(f"SELECT CAST({oracle} AS TIMESTAMP) AS b, count(*) AS n FROM orders GROUP BY 1", name)(run)


_months("time_bucket_month", "1 month", "time_bucket(INTERVAL '1 month', o_orderdate)")
_months("time_bucket_5_months", "5 months", "time_bucket(INTERVAL '5 months', o_orderdate)")
_months("time_bucket_year", "1 year", "time_bucket(INTERVAL '1 year', o_orderdate)")
_months("time_bucket_month_origin", "5 months", "time_bucket(INTERVAL '5 months', o_orderdate, TIMESTAMP '2022-12-25')", origin="2022-12-25")


def _columns(name: str, oracle: str, *columns: tuple[str, object]) -> None:
    def run(t: Tables) -> DataFrame:
        return t.events.select("event_id", *[make().alias(n) for n, make in columns])

    _r.add(f"SELECT event_id, {oracle} FROM events", name)(run)


def _ts() -> Column:
    return F.col("ts")


_columns(
    "strftime",
    "strftime(ts, '%a, %-d %B %Y - %I:%M:%S %p') AS long, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso, strftime(ts, '%j/%y %b %%') AS odd",
    ("long", lambda: tm.strftime(_ts(), "%a, %-d %B %Y - %I:%M:%S %p")),
    ("iso", lambda: tm.strftime(_ts(), "%Y-%m-%dT%H:%M:%S.%f")),
    ("odd", lambda: tm.strftime(_ts(), "%j/%y %b %%")),
)
_columns(
    "strptime",
    "strptime(strftime(ts, '%a, %d %B %Y %H:%M:%S'), '%a, %d %B %Y %H:%M:%S') AS a, strptime(CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%d/%m/%Y') ELSE strftime(ts, '%Y-%m-%d') END, ['%d/%m/%Y', '%Y-%m-%d']) AS b",
    ("a", lambda: tm.strptime(tm.strftime(_ts(), "%a, %d %B %Y %H:%M:%S"), "%a, %d %B %Y %H:%M:%S")),
    ("b", lambda: tm.strptime(F.when(F.col("event_id") % 2 == 0, tm.strftime(_ts(), "%d/%m/%Y")).otherwise(tm.strftime(_ts(), "%Y-%m-%d")), ["%d/%m/%Y", "%Y-%m-%d"])),
)
_columns("epoch", "epoch(ts) AS e", ("e", lambda: tm.epoch(_ts())))
_columns("epoch_ms", "CAST(round(epoch_us(ts) / 1000.0) AS BIGINT) AS e, epoch_ms(1700000000000 + event_id) AS back", ("e", lambda: tm.epoch_ms(_ts())), ("back", lambda: tm.from_epoch_ms(F.lit(1700000000000) + F.col("event_id"))))
_columns("epoch_us_ns", "epoch_us(ts) AS u, epoch_ns(ts) AS n", ("u", lambda: tm.epoch_us(_ts())), ("n", lambda: tm.epoch_ns(_ts())))
_columns("make_timestamp", "make_timestamp(1700000000000000 + event_id * 1000003) AS m, make_timestamp(2024, 2, CAST(1 + event_id % 28 AS BIGINT), 3, 4, 5.5) AS p", ("m", lambda: tm.make_timestamp(F.lit(1700000000000000) + F.col("event_id") * 1000003)), ("p", lambda: F.make_timestamp_ntz(F.lit(2024), F.lit(2), (1 + F.col("event_id") % 28).cast("int"), F.lit(3), F.lit(4), F.lit(5.5).cast("decimal(8,6)"))))
_columns("date_trunc", "CAST(date_trunc('month', ts) AS TIMESTAMP) AS m, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS h, CAST(date_trunc('week', ts) AS TIMESTAMP) AS w", ("m", lambda: tm.date_trunc("month", _ts())), ("h", lambda: tm.date_trunc("hour", _ts())), ("w", lambda: tm.date_trunc("week", _ts())))
_columns(
    "interval_arith",
    "ts + INTERVAL '1 month' AS a, ts - INTERVAL '36 hours' AS b, CAST(CAST(ts AS DATE) + INTERVAL '2 days' AS TIMESTAMP) AS c",
    ("a", lambda: tm.add_interval(_ts(), "1 month")),
    ("b", lambda: tm.add_interval(_ts(), "-36 hours")),
    ("c", lambda: tm.add_interval(_ts().cast("date"), "2 days")),
)
_columns("extract", "CAST(extract(year FROM ts) AS INTEGER) AS y, CAST(extract(doy FROM ts) AS INTEGER) AS d, CAST(extract(isodow FROM ts) AS INTEGER) AS w, CAST(extract(hour FROM ts) AS INTEGER) AS h", ("y", lambda: F.year("ts")), ("d", lambda: F.dayofyear("ts")), ("w", lambda: tm.isodow(_ts())), ("h", lambda: F.hour("ts")))
_columns("interval_epoch", "epoch(to_months(CAST(event_id % 7 AS INTEGER)) + to_days(CAST(event_id % 11 AS INTEGER)) + to_microseconds(event_id * 1000)) AS e", ("e", lambda: tm.interval_epoch(F.col("event_id") % 7, F.col("event_id") % 11, F.col("event_id") * 1000)))


@_r.add("SELECT o_orderkey, make_timestamp(2000 + o_orderkey % 20, 1 + o_orderkey % 12, 1 + o_orderkey % 28, o_orderkey % 24, o_orderkey % 60, o_orderkey % 60 + 0.25) AS ts FROM orders")
def make_timestamp_parts(t: Tables) -> DataFrame:
    k = lambda n: (F.col("o_orderkey") % n).cast("int")
    return t.orders.select("o_orderkey", tm.make_timestamp_of(k(20) + 2000, k(12) + 1, k(28) + 1, k(24), k(60), k(60) + F.lit(0.25)).alias("ts"))


@_r.add("SELECT event_id, CAST(CAST(ts AS TIME) AS VARCHAR) AS t, CAST(CAST(ts + INTERVAL '250 milliseconds' AS TIME) AS VARCHAR) AS f, CAST(ts AS TIME) < TIME '12:00:00' AS morning FROM events")
def times_of_day(t: Tables) -> DataFrame:
    now = tm.time_of(F.col("ts"))
    later = tm.time_of(tm.add_interval(F.col("ts"), "250 milliseconds"))
    return t.events.select("event_id", tm.time_text(now).alias("t"), tm.time_text(later).alias("f"), (now < F.expr("INTERVAL '12' HOUR")).alias("morning"))
