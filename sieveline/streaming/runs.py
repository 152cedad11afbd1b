"""Run events: the latest state of every stage, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_stage(events: DataFrame) -> DataFrame:
    """(request_id, stage, seq, value, events): each stage's last event. One aggregation with a map-side part."""
    last = F.max_by(F.struct("seq", "value"), F.col("seq"))
    return events.groupBy("request_id", "stage").agg(last.alias("l"), F.count("*").alias("events")).select("request_id", "stage", "l.*", "events")


def stage_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by stage and time window, with a watermark; for streams and batches alike."""
    df = events.withWatermark("ts", late) if events.isStreaming else events
    return df.groupBy(F.window("ts", width).alias("w"), "stage").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value")).select(F.col("w.start").alias("start"), "stage", "events", "value")


def stream_latest(events: DataFrame, path: str, checkpoint: str):
    """Start a stream that keeps the latest state of every stage in Parquet, a folder a batch; each batch holds changed stages."""
    changed = latest_stage(events)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
