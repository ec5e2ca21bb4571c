"""A Spark session with the settings that the engine is tested with."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tempora", **conf: str) -> SparkSession:
    """An existing or new session; ``conf`` entries use ``__`` for dots."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
