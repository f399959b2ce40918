"""Counts and sums of events in time windows, for batch and streaming DataFrames alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files that come to a folder, with the schema of those there."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_counts(events: DataFrame, every: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """For each window and event_type: n and the sum of value. On a stream, events later than `late` are dropped and
    only the windows still open are kept as state."""
    kind = events.schema["ts"].dataType
    source = events.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs an instant
    source = source.withWatermark("ts", late) if events.isStreaming else source
    window = F.window("ts", every, slide) if slide else F.window("ts", every)
    out = source.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,6)")).cast("double").alias("total"))
    return out.select(F.col("w.start").cast(kind).alias("start"), "event_type", "n", "total")
