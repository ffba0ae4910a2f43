"""Streams of events as period axes: counts by window with a watermark, and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_window(events: DataFrame, time: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Count and sum of value by window and keys; windows close once the watermark has passed."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    out = e.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *keys, "events", "total")


def sessions(events: DataFrame, time: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """Sessions of keys that end after a gap."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    out = e.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("events"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *keys, "events")
