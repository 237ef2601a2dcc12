"""Streams of events as daily bars, and a gate in front of each batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def daily_bars(events: DataFrame, lateness: str = "2 days") -> DataFrame:
    """event_type, day, n, total, low, high per day; on a stream a day closes when the watermark passes it."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", lateness) if events.isStreaming else rows
    bars = rows.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"))
    return bars.select("event_type", F.to_date("window.start").alias("day"), "n", "total", "low", "high")


def gated_append(stream: DataFrame, accepted: Callable[[DataFrame], bool], path: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch to path if it passes; a batch that is tried again overwrites its own folder."""

    def take(batch: DataFrame, number: int) -> None:
        if accepted(batch):
            batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(take).trigger(availableNow=True).start()
