"""Degrees kept up to date over a stream of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interaction_degrees(events: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """(window, user_id, event_type, events) of a stream or table of events; rows later than `late` are left out.

    Users and event types are the two sides of a graph; the count is the weight of an edge in a window.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).where(F.col("ts").isNotNull())
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window).alias("window"), "user_id", "event_type").agg(F.count(F.lit(1)).alias("events"))
