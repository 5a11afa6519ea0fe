"""Streaming forms (P1, P2, P7): the same columns over a stream or a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_counts(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "5 minutes") -> DataFrame:
    """Events by kind and window; on a stream, rows later than the watermark are dropped and counted by its progress."""
    w = F.window("created_at", size, slide) if slide else F.window("created_at", size)
    rows = events.withWatermark("created_at", late) if events.isStreaming else events
    return rows.groupBy(w, "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def idempotent(events: DataFrame, key: str = "event_id", within: str = "5 minutes") -> DataFrame:
    """The first sighting of each id; on a stream, repeats within the watermark go."""
    return events.withWatermark("created_at", within).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def sessions(events: DataFrame, user: str = "chunk_id", gap: str = "24 hours") -> DataFrame:
    """Activity sessions of each user, closed by a gap."""
    rows = events.withWatermark("created_at", gap) if events.isStreaming else events
    return rows.groupBy(F.session_window("created_at", gap).alias("s"), user).agg(F.count("*").alias("n")).select(user, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
