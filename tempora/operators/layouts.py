"""Closed-form layouts: all speech, or none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def balanced_boundaries(n: Column, k: Column) -> Column:
    """k chunks of sizes that differ by one at most, the shorter ones first."""
    size, longer = F.floor(n / k), n % k
    return F.transform(F.sequence(F.lit(0).cast("long"), k), lambda i: i * size + F.greatest(F.lit(0).cast("long"), i - (k - longer)))


def earliest_boundaries(n: Column, k: Column, shortest: int, longest: int) -> Column:
    """Each boundary as early as the bounds allow."""
    inner = F.transform(F.sequence(F.lit(0).cast("long"), k), lambda i: F.greatest(i * shortest, n - (k - i) * longest))
    return F.transform(inner, lambda x, i: F.when(i == 0, F.lit(0).cast("long")).otherwise(x))
