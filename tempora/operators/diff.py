"""Versioned differences: a corrected copy may change the text and nothing else."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.operators.contracts import first_broken


def correction_diff(baseline: DataFrame, edited: DataFrame, keys: Sequence[str], fixed: Sequence[str], text: str = "text") -> DataFrame:
    """keys, changed, violation for every row of either side.

    A violation is a row that only one side has, or a changed ``fixed`` column.
    """
    a = baseline.select(*keys, *[F.col(c).alias(f"a_{c}") for c in [*fixed, text]], F.lit(1).alias("in_a"))
    b = edited.select(*keys, *[F.col(c).alias(f"b_{c}") for c in [*fixed, text]], F.lit(1).alias("in_b"))
    rules = [(F.col("in_b").isNull(), "row_removed"), (F.col("in_a").isNull(), "row_added")]
    rules += [(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), f"{c}_changed") for c in fixed]
    joined = a.join(b, list(keys), "full_outer")
    changed = F.col("in_a").isNotNull() & F.col("in_b").isNotNull() & ~F.col(f"a_{text}").eqNullSafe(F.col(f"b_{text}"))
    return joined.select(*keys, changed.alias("changed"), first_broken(*rules).alias("violation"))


def changed_ids(diff: DataFrame, keys: Sequence[str], ident: str) -> DataFrame:
    """The sorted ids of changed rows per key."""
    return diff.where("changed").groupBy(*keys).agg(F.array_sort(F.collect_list(ident)).alias("changed_ids"))
