"""Choosing by ranked preference, and skylines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.text import col


def preference_rank(c: Column | str, preferred: Sequence[str]) -> Column:
    """Place of a value in a preference list; values outside it come last."""
    found = F.array_position(F.array(*[F.lit(p) for p in preferred]), col(c)).cast("int") if preferred else F.lit(0)
    return F.when(F.coalesce(found, F.lit(0)) > 0, found - 1).otherwise(len(preferred))


def with_preference(df: DataFrame, preferences: DataFrame, on: str, default: int) -> DataFrame:
    """``rank`` from a preference table (Catalyst broadcasts a small one), ``default`` where it has none."""
    return df.join(preferences.select(on, "rank"), on, "left").withColumn("rank", F.coalesce("rank", F.lit(default)))


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """A key's first row in order.

    An aggregate, not a window: rows are reduced before the shuffle, so a key
    of any size costs one row per task.  Order columns must ascend.
    """
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    row = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(F.min_by(row, rank).alias("__row")).select(*keys, "__row.*").select(*df.columns)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "position") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def smallest_per(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Duplicate keys reduced to the smallest value."""
    return df.groupBy(*keys).agg(F.min(value).alias(value))


def skyline(df: DataFrame, low: str, other: str, keep: Sequence[str]) -> DataFrame:
    """Rows that no other row beats: none is at most as large in both columns and smaller in one.

    Only the smallest ``other`` of each ``low`` can matter, and it must be
    below all those of smaller ``low``: one aggregate, then a running minimum
    over distinct values in ranges of ``low``, whose minima come first.
    """
    best = df.groupBy(low).agg(F.min(other).alias("__best"))
    # Running minimum without one ordered partition: ranges of values, then within each.
    ranged = best.withColumn("__range", F.floor(F.log2(F.greatest(F.abs(F.col(low)).cast("double"), F.lit(1.0)))) * F.signum(F.col(low).cast("double")))
    minima = ranged.groupBy("__range").agg(F.min("__best").alias("__m"))
    upto = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = minima.select("__range", F.min("__m").over(upto).alias("__outside"))  # a few hundred ranges at most
    inner = Window.partitionBy("__range").orderBy(low).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(F.broadcast(before), "__range").withColumn("__inside", F.min("__best").over(inner))
    floor_ = F.least("__outside", "__inside")
    front = joined.where(floor_.isNull() | (F.col("__best") < floor_)).select(low, F.col("__best").alias(other))
    return df.join(front, [low, other]).select(*keep)
