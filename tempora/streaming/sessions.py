"""Streaming forms of the interval operators (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Parquet files of events as a stream; timestamps without zone become instants for the watermark."""
    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events and their value per window and type; later data than ``late`` is dropped."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    out = grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of each user's events; events at most ``gap`` apart belong together."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    out = grouped.agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def drain(df: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream over all that is there now, appending finished groups to ``path``."""
    df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
