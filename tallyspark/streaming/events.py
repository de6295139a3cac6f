"""Extension: the daily sums as a stream over event files (the batch pipelines have no stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_at_once: int = 8) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def windowed_values(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Value and events by type and window, with a watermark for late data."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return e.groupBy(F.window("at", window).alias("w"), "event_type").agg(F.sum("value").alias("value"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "value", "n")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return e.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_once(df: DataFrame, path: str, checkpoint: str) -> None:
    """Processes what has arrived, then stops."""
    df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
