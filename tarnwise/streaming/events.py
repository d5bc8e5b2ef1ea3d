"""Streaming metrics over event files; an extension, the reference design has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, folder: str, files_a_batch: int = 8) -> DataFrame:
    """Stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def windowed(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and totals by window and type; events later than `late` are dropped, so state stays bounded."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return e.groupBy(F.window("at", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def distinct_events(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Events without those sent again within the watermark."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> None:
    """Process what is there, into an in-memory table."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
