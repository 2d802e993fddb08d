"""Windowed counts that hold for a batch and for a stream, and a stream that runs a batch of files to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """start, end, event_type, n. On a stream `late` is how long a window stays open for late events."""
    rows = events.withWatermark("ts", late) if late else events
    out = rows.groupBy(F.window("ts", width, slide) if slide else F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n")


def running_site_counts(detections: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Captures over time: detections (ts, site, score) by site and window."""
    rows = detections.withWatermark("ts", late).groupBy(F.window("ts", width), "site").agg(F.count("*").alias("n"), F.max("score").alias("top_score"))
    return rows.select(F.col("window.start").alias("start"), "site", "n", "top_score")


def run_to_end(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Write everything that is there as Parquet, exactly once over restarts with the same checkpoint, and read it."""
    query = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
