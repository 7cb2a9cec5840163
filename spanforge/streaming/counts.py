"""Micro-batch counterparts of the push programs: running statistics over a stream of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per event-time window and type; works on batch and streaming frames."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))


def windowed_counts_batch(events: DataFrame) -> DataFrame:
    out = windowed_counts(events)
    return out.select(F.unix_timestamp(F.col("window.start")).alias("start_s"), "event_type", "n")


def session_clusters(events: DataFrame, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Clusters in time with a tolerance: sessions per key."""
    s = events.withWatermark("ts", late).groupBy(*keys, F.session_window("ts", gap).alias("session")).agg(F.count("*").alias("n"))
    return s.select(*keys, "session.start", "session.end", "n")


def running_statistic(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Intermediate totals per key: write in complete or update mode with a processing-time trigger."""
    return rows.groupBy(*keys).agg(F.sum(value).alias("total"), F.count("*").alias("n"))
