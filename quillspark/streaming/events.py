"""The tumbling-window operators on unbounded event streams (``ts, entity`` and others), with watermarks for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_windows(stream: DataFrame, seconds: int = 10, late: str = "1 minute", least: int = 2) -> DataFrame:
    """Windows with at least ``least`` entities; the state holds a window's distinct entities until the watermark passes it."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", f"{seconds} seconds")).agg(F.count("*").alias("event_count"), F.size(F.collect_set("entity")).alias("unique_entities"))
    return w.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "event_count", "unique_entities").where(F.col("unique_entities") >= least)


def shared_tokens(stream: DataFrame, token: str, seconds: int = 300, late: str = "5 minutes", least: int = 3) -> DataFrame:
    """Tokens that several entities share within a window."""
    w = stream.withWatermark("ts", late).groupBy(token, F.window("ts", f"{seconds} seconds")).agg(F.size(F.collect_set("entity")).alias("distinct_entities"), F.count("*").alias("total_shares"))
    return w.select(token, F.col("window.start").alias("window_start"), "distinct_entities", "total_shares").where(F.col("distinct_entities") >= least)


def volume(stream: DataFrame, seconds: int = 60, late: str = "1 minute") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", f"{seconds} seconds")).agg(F.count("*").alias("count")).select(F.col("window.start").alias("window_start"), "count")
