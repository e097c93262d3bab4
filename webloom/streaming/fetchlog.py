"""Structured Streaming over a fetch log: windowed counts, idempotent arrival, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """(day, event_type, n, total) by tumbling window; ``late`` sets the watermark of a stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if late else rows
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


def arrivals(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each key once, whatever is delivered again within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def progress(batch: DataFrame, number: int) -> dict:
    """Figures of one micro-batch, for foreachBatch."""
    row = batch.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors")).first()
    return {"batch": number, "rows": row["n"], "errors": row["errors"]}
