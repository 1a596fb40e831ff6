"""Windowed counts over event time, for streams and tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, time: str = "ts") -> DataFrame:
    """Event time as a timestamp with a zone, which watermarks need."""
    return events.withColumn(time, F.col(time).cast("timestamp"))


def counts(events: DataFrame, length: str, slide: str | None = None, keys: tuple[str, ...] = ("event_type",), late: str | None = None) -> DataFrame:
    """Counts and sums per tumbling or sliding window and key; with ``late`` rows later than that are left out of a stream."""
    rows = timed(events)
    if late:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", length, slide or length).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", *keys, "n", "total")


def sessions(events: DataFrame, gap: str, key: str = "user_id", late: str | None = None) -> DataFrame:
    """Sessions of a key that end after ``gap`` without events."""
    rows = timed(events)
    if late:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, "w.start", "w.end", "n")
