"""Activity counts and sessions in event time. The same functions take batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def activity_windows(events: DataFrame, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """`user_id, window_start, n` per window of `length`. A stream drops what is later than `late`."""
    counted = events.withWatermark("ts", late).groupBy("user_id", F.window("ts", length).alias("w"))
    return counted.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """`user_id, session_start, session_end, n`: runs of events less than `gap` apart. A session ends `gap`
    after its last event."""
    counted = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return counted.agg(F.count("*").alias("n")).select(
        "user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n"
    )
