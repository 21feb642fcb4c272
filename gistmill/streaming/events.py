"""Streaming forms of the log operators over an events stream (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def error_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling counts per event type."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    counts = timed.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user: start and events."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    found = timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
