"""Event-time aggregates over a stream; they go beyond what record files need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, late: str) -> DataFrame:
    """``events`` with a watermark on ``ts``, which may be a timestamp without a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their value per type and window, closed by the watermark."""
    grouped = timed(events, late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("starts"), "event_type", "n", "value")


def sliding(events: DataFrame, size: str = "1 hour", slide: str = "15 minutes", late: str = "2 hours") -> DataFrame:
    grouped = timed(events, late).groupBy(F.window("ts", size, slide).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("starts"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Per user the stretches of events with less than ``gap`` between two."""
    grouped = timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("starts"), F.col("w.end").alias("ends"), "n")


def deduplicated(events: DataFrame, late: str = "2 hours") -> DataFrame:
    return timed(events, late).dropDuplicatesWithinWatermark(["event_id"])
