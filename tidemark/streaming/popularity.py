"""Popularity and long tail of a stream of interactions, for serving between two batch runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_interactions(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """The first arrival of each (user_id, item_id) within the watermark of ts; works on a stream or a table."""
    if events.isStreaming:
        return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["user_id", "item_id"])
    return events.dropDuplicates(["user_id", "item_id"])


def running_popularity(events: DataFrame) -> DataFrame:
    """item_id, its interactions, and whether it is in the long tail; for output modes update and complete."""
    counts = events.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("long_tail", F.col("n") == 1)


def windowed_popularity(events: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Interactions of each item in each window of ts; late events within the delay still count."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window), "item_id").agg(F.count(F.lit(1)).alias("n"))
