"""Scoring of streamed locations, and windowed summaries of streamed events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def score_stream(fit, stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Predict each micro-batch of new locations with a fitted model and append to Parquet.

    A batch replayed after a failure overwrites its own folder, so each
    location is scored once.
    """

    def one(batch: DataFrame, number: int) -> None:
        fit.predict(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed(events: DataFrame, length: str = "1 hour", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Count, mean and extremes of ``value`` per tumbling window; state beyond the watermark is dropped."""
    w = F.window("ts", length)
    # watermarks need an instant; files may hold local times
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value")).select(F.col("w.start").alias("window_start"), by, "n", "mean_value", "min_value", "max_value")
