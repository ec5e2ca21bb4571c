"""Loading the star-schema tables, and the interval view of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.runtime import ship

MINUTE_US = 60_000_000
DAY_US = 1440 * MINUTE_US


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"unix_micros(from_utc_timestamp(CAST({ts} AS TIMESTAMP), current_timezone()))")


def event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as intervals [s, e) in microseconds: from ts for ``value`` minutes."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value")
    s = micros("ts")
    return events.select("event_id", "user_id", "event_type", s.alias("s"), (s + F.round(F.col("value") * MINUTE_US).cast("long")).alias("e"))
