"""Time buckets over streams: counts and sums in event time, late rows up to a delay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.time import MICROS, ORIGIN, parse_interval


def _start(width: str) -> str:
    """The offset that makes the session's windows begin where time buckets do."""
    months, micros = parse_interval(width)
    if months:
        raise ValueError("streams are bucketed by widths without months")
    return f"{(ORIGIN % micros) // MICROS['millisecond']} milliseconds"


def bucketed(stream: DataFrame, ts: str, width: str, delay: str, by: list[str], **aggregates: Column) -> DataFrame:
    """(bucket, by..., aggregates) of a stream or a batch; on a stream, buckets that end before the latest time minus
    ``delay`` are final. ``ts`` is a timestamp with or without time zone."""
    rows = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    grouped = rows.groupBy(F.window("_ts", width, width, _start(width)).alias("_w"), *by).agg(*[c.alias(n) for n, c in aggregates.items()])
    return grouped.select(F.col("_w.start").cast("timestamp_ntz").alias("bucket"), *by, *aggregates)


def sessions(stream: DataFrame, ts: str, gap: str, delay: str, by: list[str], **aggregates: Column) -> DataFrame:
    """(start, end, by..., aggregates) of sessions: rows of a key that are at most ``gap`` apart."""
    rows = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    grouped = rows.groupBy(F.session_window("_ts", gap).alias("_w"), *by).agg(*[c.alias(n) for n, c in aggregates.items()])
    return grouped.select(F.col("_w.start").cast("timestamp_ntz").alias("start"), F.col("_w.end").cast("timestamp_ntz").alias("end"), *by, *aggregates)
