"""Structured Streaming: the changefeed as a stream, event-time windows, sessions, duplicates.

Each function takes a streaming or a batch DataFrame and returns one of the same kind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tail_changefeed(spark: SparkSession, path: str, schema, after_sequence: int = 0, max_files: int = 100) -> DataFrame:
    """The changefeed folder as a stream of events; resuming is the checkpoint's work."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path).filter(F.col("sequence") > after_sequence)


def tumbling_counts(events: DataFrame, time: str, size: str, *keys: str, watermark: str | None = None) -> DataFrame:
    rows = events.withWatermark(time, watermark) if watermark else events
    return rows.groupBy(F.window(time, size).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def sliding_counts(events: DataFrame, time: str, size: str, slide: str, *keys: str, watermark: str | None = None) -> DataFrame:
    rows = events.withWatermark(time, watermark) if watermark else events
    return rows.groupBy(F.window(time, size, slide).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def sessions(events: DataFrame, time: str, gap: str, *keys: str, watermark: str | None = None) -> DataFrame:
    rows = events.withWatermark(time, watermark) if watermark else events
    return rows.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), *keys, "n")


def first_of_each(events: DataFrame, time: str, watermark: str, *keys: str) -> DataFrame:
    """One event for each value of keys; state is dropped behind the watermark."""
    rows = events.withWatermark(time, watermark)
    return rows.dropDuplicatesWithinWatermark(list(keys)) if events.isStreaming else rows.dropDuplicates(list(keys))
