"""The event log as a stream: windowed counts with a watermark, and keyed state as an upsert of each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, event_type, n): events in windows of event time. Works on a stream, where late rows are waited for, and on a table."""
    stamped = events.withColumn("at", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("at", late)
    counted = stamped.groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def latest_by_user(events: DataFrame) -> DataFrame:
    """(user_id, event_id, event_type): each user's last event, by time, then id."""
    return events.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("e")).select("user_id", "e.*")


def keep_latest(events: DataFrame, folder: str, checkpoint: str):
    """Start a stream that keeps each user's last event as a table under ``folder``: an upsert of each micro-batch. Returns the stream's query.

    A batch writes the next version, ``v<batch>``, from the one before; a batch that is done again writes the same one.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        columns = ["user_id", "ts", "event_id", "event_type"]
        rows = batch.select(*columns)
        if number:
            rows = rows.unionByName(batch.sparkSession.read.parquet(f"{folder}/v{number - 1}").select(*columns))
        last = rows.groupBy("user_id").agg(F.max_by(F.struct("ts", "event_id", "event_type"), F.struct("ts", "event_id")).alias("e"))
        last.select("user_id", "e.*").write.mode("overwrite").parquet(f"{folder}/v{number}")

    return events.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
