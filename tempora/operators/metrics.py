"""Load balance and run metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def load_metrics(df: DataFrame, keys: Sequence[str], load: str, hard: Column | None = None) -> DataFrame:
    """chunks, total, max_load, and the squared relative error as an exact ratio.

    The mean squared relative error is (k * sum of squares - total^2) / total^2,
    given as numerator and denominator; it is 0 over 1 where the total is 0.
    """
    aggs = [
        F.count(F.lit(1)).alias("chunks"),
        F.sum(load).cast("long").alias("total"),
        F.max(load).cast("long").alias("max_load"),
        F.sum(F.col(load) * F.col(load)).cast("long").alias("squares"),
    ]
    if hard is not None:
        aggs.append(F.count_if(hard).alias("hard_cuts"))
    out = df.groupBy(*keys).agg(*aggs)
    zero = F.col("total") == 0
    numerator = F.when(zero, F.lit(0)).otherwise(F.col("chunks") * F.col("squares") - F.col("total") * F.col("total"))
    denominator = F.when(zero, F.lit(1)).otherwise(F.col("total") * F.col("total"))
    return out.withColumns({"msre_numerator": numerator.cast("long"), "msre_denominator": denominator.cast("long")})


def elapsed_in_order(df: DataFrame, keys: Sequence[str], index: str, elapsed: str) -> DataFrame:
    """Elapsed times of a key's chunks in order of their index."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(elapsed).alias("t"))))
    return df.groupBy(*keys).agg(F.transform(rows, lambda r: r["t"]).alias("elapsed"))


def batches(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int = 4, name: str = "batch", *, bucket: int | None = None) -> DataFrame:
    """Batch numbers from 1, ``size`` rows each, in order.

    With ``bucket``, rows are numbered within buckets of the first (numeric)
    order column and only one count per bucket is ordered per key, so a key of
    any size is dealt over many tasks; keys must then not be null.
    """
    number = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    if bucket is None:
        return df.withColumn(name, F.floor((number(keys) - 1) / size) + 1)
    cell = [*keys, "__b"]
    cut = df.withColumn("__b", F.floor(F.col(order[0]) / bucket))
    earlier = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    cells = cut.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n")).withColumn("__earlier", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    numbered = cut.withColumn("__nth", number(cell)).join(cells, cell)
    return numbered.select(*df.columns, (F.floor((F.col("__nth") + F.col("__earlier") - 1) / size) + 1).alias(name))


def status_rollup(checks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The overall status of checks (status pass or fail, core, provider).

    not_ready if a core check failed or no provider is ready, ready if all
    providers are, else degraded.  A provider is ready if none of its checks
    failed.
    """
    fails = F.col("status") == "fail"
    per = checks.groupBy(*keys, "provider").agg(F.bool_or(fails).alias("failed"), F.bool_or(fails & F.col("core")).alias("core_failed"))
    provider = F.col("provider").isNotNull()
    out = per.groupBy(*keys).agg(
        F.bool_or("core_failed").alias("core_failed"),
        F.count_if(provider).alias("providers"),
        F.count_if(provider & ~F.col("failed")).alias("ready"),
    )
    overall = F.when(F.col("core_failed") | (F.col("ready") == 0), "not_ready").when(F.col("ready") == F.col("providers"), "ready").otherwise("degraded")
    return out.withColumn("overall", overall)


def legal_chunk_range(n: Column, shortest: Column, longest: Column) -> tuple[Column, Column]:
    """Smallest and largest legal number of chunks; (1, 1) for short audio, nulls where none is legal."""
    low, high = F.ceil(n / longest), F.floor(n / shortest)
    short, none = n < shortest, low > high
    at = lambda x: F.when(n <= 0, F.lit(None)).when(short, F.lit(1)).when(none, F.lit(None)).otherwise(x).cast("long")
    return at(low), at(high)


def chunk_counts(n: Column, shortest: Column, longest: Column, group: int, strategy: str = "full") -> Column:
    """Legal chunk counts that are multiples of ``group``; ``full`` falls back to the largest, ``divisible`` to none.

    Short audio has the count 1; null where no count is legal.
    """
    if strategy not in ("full", "divisible"):
        raise ValueError(f"unknown strategy {strategy!r}")
    low, high = legal_chunk_range(n, shortest, longest)
    # Only the multiples are generated, so a wide range costs no more than its result.
    first, last = F.ceil(low / group).cast("long"), F.floor(high / group).cast("long")
    found = F.when(first <= last, F.transform(F.sequence(F.least(first, last), last), lambda i: i * group)).otherwise(F.array().cast("array<bigint>"))
    if strategy == "full":
        found = F.when(F.size(found) == 0, F.array(high)).otherwise(found)
    return F.when(low.isNull(), F.lit(None)).when(n < shortest, F.array(F.lit(1).cast("long"))).otherwise(found)


def cpu_budget(cpus: int) -> int:
    """Three quarters of the logical CPUs, at least one."""
    return max(1, cpus * 3 // 4)


def largest_worker_count(cpus: int, jobs: int, threads: int) -> int:
    """The most workers of ``threads`` threads within the budget and the number of jobs, at least one."""
    return max(1, min(jobs, cpu_budget(cpus) // max(1, threads)))
