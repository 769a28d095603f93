"""Structured Streaming forms of two batch operators (extensions)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_intervals_stream(events: DataFrame, key: str, late: str = "10 minutes", gap_ms: int = 1000) -> DataFrame:
    """Intervals (key, start, end as timestamps) merged within a gap, by dynamic session windows."""
    length = F.concat(((F.unix_millis("end") - F.unix_millis("start")) + gap_ms).cast("string"), F.lit(" milliseconds"))
    return (
        events.withWatermark("start", late)
        .groupBy(key, F.session_window("start", length))
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_parts"))
        .drop("session_window")
    )


def run_counters_stream(runs: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and seconds by window and status."""
    return (
        runs.withWatermark("ts", late)
        .groupBy(F.window("ts", width), "status")
        .agg(F.count("*").alias("n"), F.sum("seconds").alias("seconds"))
        .select(F.col("window.start").alias("start"), "status", "n", "seconds")
    )
