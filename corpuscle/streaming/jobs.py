"""Structured Streaming: resumable work over arriving files, and event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def resumable(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], to: str, checkpoint: str, files: int = 100) -> None:
    """Process each arrived file once and stop; a rerun goes on where the last commit ended.

    The checkpoint folder is the progress record and the file sink's log makes output exactly-once.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    query = transform(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(to)
    query.awaitTermination()


def tumbling(events: DataFrame, every: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums by type and event-time window; works on streams and tables alike."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", every, slide) if slide else F.window("ts", every)
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("w_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions by user: start, end of the last event's gap and events."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("s_start"), F.col("w.end").alias("s_end"), "n")
