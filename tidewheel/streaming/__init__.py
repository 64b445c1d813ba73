"""Event streams: windowed counts with late data, as batch and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def late(events: DataFrame, watermark: str | None) -> DataFrame:
    """With a watermark; it needs instants, so local times are taken as times of the session's zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark) if watermark else events


def local(time: str, watermark: str | None) -> Column:
    return F.col(time).cast("timestamp_ntz") if watermark else F.col(time)


def tumbling_counts(events: DataFrame, width: str = "1 day", watermark: str | None = None, slide: str | None = None) -> DataFrame:
    """Events by window and type; with `slide` windows begin that far apart and overlap. With a watermark the same plan runs on a stream and drops state of closed windows."""
    events = late(events, watermark)
    counted = events.groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(local("w.start", watermark).alias("window_start"), "event_type", "n")


def session_counts(events: DataFrame, gap: str = "30 minutes", watermark: str | None = None) -> DataFrame:
    """Sessions of each user: runs of events no further apart than `gap`."""
    events = late(events, watermark)
    counted = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return counted.select("user_id", local("w.start", watermark).alias("session_start"), local("w.end", watermark).alias("session_end"), "n")
