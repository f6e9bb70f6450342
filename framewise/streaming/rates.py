"""Structured Streaming forms: tumbling rates and banding-like sessions with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, interval: str = "1 day", late: str = "1 day") -> DataFrame:
    """Bytes and events by video in tumbling windows of ``ts``; later events than the watermark are dropped by Spark."""
    w = F.window("ts", interval)
    return events.withWatermark("ts", late).groupBy("video_id", w).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).select("video_id", F.col("window.start").alias("start"), "bytes", "n")


def sessions(events: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("video_id", w).agg(F.count("*").alias("n")).select("video_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
