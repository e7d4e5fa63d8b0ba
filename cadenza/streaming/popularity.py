"""Popularity over event time: the batch operator on a stream, an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_popularity(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window start, event_type, events, users) of ``events(ts, user_id, event_type)``.

    Works on batch and streaming frames; on a stream, state older than the watermark is
    dropped. Users are counted by a sketch, since exact distinct sets would grow without end.
    """
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events  # watermarks need a zoned type
    grouped = marked.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("events"), F.approx_count_distinct("user_id").alias("users"))
    return grouped.select(F.col("window.start").alias("start"), "event_type", "events", "users")
