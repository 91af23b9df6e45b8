"""Bars and sessions by event time, for batches and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bars(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str | None = None) -> DataFrame:
    """Open, high, low, close and count of value by event_type and window; late (a delay) sets the watermark of a stream."""
    rows = events.withWatermark("ts", late) if late else events
    when = F.struct("ts", "event_id")
    return rows.groupBy(F.window("ts", size, slide), F.col("event_type").alias("ticker")).agg(
        F.min_by("value", when).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", when).alias("close"), F.count("*").alias("n")
    ).select("ticker", F.col("window.start").alias("start"), "open", "high", "low", "close", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """user_id, start, end and count of events with no gap so long."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def append_only(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """A stream of bars without repeats of (ticker, ts) inside the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["ticker", "ts"])
