"""Event-time windows, alike for tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """start, event_type, n, total by hour. On a stream, events later than `late` behind the latest are dropped, which bounds the state."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    each = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return each.select(F.col("w.start").alias("start"), "event_type", "n", "total")
