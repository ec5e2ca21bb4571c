"""Content-addressed incremental runs: compute only what is missing.

Identities are digests of content and of every parameter that affects the
output; a result is reused only if its whole identity matches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Which status may follow which.
SUBTITLE_MOVES = {None: ["needs_transcription"], "needs_transcription": ["editable"], "editable": ["editable"]}
SUMMARY_MOVES = {
    None: ["preparing"],
    "preparing": ["needs_transcription", "prompt_ready", "failed"],
    "needs_transcription": ["prompt_ready"],
    "prompt_ready": ["complete", "prompt_ready"],
    "complete": ["complete", "prompt_ready"],
    "failed": ["preparing"],
}


def pending(plan: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Planned rows without a result."""
    return plan.join(done.select(*keys).distinct(), list(keys), "left_anti")


def progress(plan: DataFrame, done: DataFrame, failed: DataFrame, keys: Sequence[str], error: str = "error") -> DataFrame:
    """Every planned row as succeeded, failed (with its error) or pending; a result wins over a failure."""
    keys = list(keys)
    ok = done.select(*keys).distinct().withColumn("__ok", F.lit(True))
    bad = failed.groupBy(*keys).agg(F.max(error).alias("__error"))
    joined = plan.join(ok, keys, "left").join(bad, keys, "left")
    status = F.when(F.col("__ok"), "succeeded").when(F.col("__error").isNotNull(), "failed").otherwise("pending")
    return joined.select(*plan.columns, status.alias("status"), F.when(status == "failed", F.col("__error")).alias("error"))


def failure_summary(rows: DataFrame, keys: Sequence[str], item: str, error: str) -> DataFrame:
    """One line per key: its items and errors in order, joined by semicolons."""
    lines = F.array_sort(F.collect_list(F.concat(F.col(item).cast("string"), F.lit(": "), F.col(error))))
    return rows.groupBy(*keys).agg(F.array_join(lines, "; ").alias("errors"), F.count(F.lit(1)).alias("failures"))


def complete(plan: DataFrame, results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Planned rows with their results; raises if one is missing."""
    missing = pending(plan, results, keys).limit(1).count()
    if missing:
        raise ValueError("results are missing")
    return plan.join(results, list(keys))


def run_missing(plan: DataFrame, store: str, keys: Sequence[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run ``work`` on the planned rows that the store lacks, append its results, and return the plan's results.

    ``work`` returns the keys, ``payload`` and ``error``.  Good rows are stored
    although others failed; then the failures are raised.  An append writes
    new files only, so a crash leaves whole results or none.
    """
    spark = plan.sparkSession
    schema = f"{', '.join(f'`{k}` {plan.schema[k].dataType.simpleString()}' for k in keys)}, payload string, error string"
    try:
        stored = spark.read.schema(schema).parquet(store)
        todo = pending(plan, stored.where("error IS NULL"), keys)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        todo = plan
    if not todo.isEmpty():
        work(todo).select(*keys, F.col("payload").cast("string"), F.col("error").cast("string")).write.mode("append").parquet(store)
    stored = spark.read.schema(schema).parquet(store).join(plan.select(*keys), list(keys), "left_semi")
    good = stored.where("error IS NULL").groupBy(*keys).agg(F.min("payload").alias("payload"))
    failed = pending(plan, good, keys).join(stored.where("error IS NOT NULL"), list(keys))
    bad = failed.limit(5).collect()
    if bad:
        raise RuntimeError("; ".join(sorted(f"{[r[k] for k in keys]}: {r['error']}" for r in bad)))
    return good


def publish(artifacts: dict[str, DataFrame], folder: str) -> DataFrame:
    """Write all artifacts, then the manifest with their digests; the manifest's presence means all is there.

    A digest is over the rows as canonical JSON, summed without regard to order.
    """
    if not artifacts:
        raise ValueError("nothing to publish")
    rows = None
    for name, df in sorted(artifacts.items()):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        one = digest(df.sparkSession.read.parquet(f"{folder}/{name}"), name)
        rows = one if rows is None else rows.unionByName(one)
    rows.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    return verify(next(iter(artifacts.values())).sparkSession, folder)


def digest(df: DataFrame, name: str) -> DataFrame:
    """artifact, rows, and an order-free digest of all rows."""
    h = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
    out = df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("total"))
    return out.select(F.lit(name).alias("artifact"), "rows", F.sha2(F.concat_ws(":", "rows", F.col("total").cast("string")), 256).alias("sha256"))


def verify(spark, folder: str) -> DataFrame:
    """The manifest with ``valid``: whether each artifact still gives its digest."""
    declared = spark.read.schema("artifact string, rows bigint, sha256 string").json(f"{folder}/manifest")
    now = None
    for r in declared.select("artifact").collect():
        one = digest(spark.read.parquet(f"{folder}/{r['artifact']}"), r["artifact"])
        now = one if now is None else now.unionByName(one)
    if now is None:
        return declared.withColumn("valid", F.lit(False))
    now = now.select("artifact", F.col("sha256").alias("__now"))
    return declared.join(now, "artifact", "left").withColumn("valid", F.col("sha256").eqNullSafe(F.col("__now"))).drop("__now")


def recover(spark, folder: str, name: str, recompute: Callable[[], DataFrame]) -> bool:
    """Rebuild an artifact if its recomputation gives the declared digest; otherwise leave all as it is."""
    declared = spark.read.schema("artifact string, rows bigint, sha256 string").json(f"{folder}/manifest").where(F.col("artifact") == name).collect()
    new = recompute()
    if not declared or digest(new, name).first()["sha256"] != declared[0]["sha256"]:
        return False
    new.write.mode("overwrite").parquet(f"{folder}/{name}")
    return True


def illegal_moves(df: DataFrame, before: str, after: str, moves: dict) -> DataFrame:
    """``legal``: whether a status may follow the one before (null: none)."""
    pairs = [(b, a) for b, nexts in moves.items() for a in nexts]
    legal = F.lit(False)
    for b, a in pairs:
        legal = legal | (F.col(before).eqNullSafe(F.lit(b)) & (F.col(after) == a))
    return df.withColumn("legal", F.coalesce(legal, F.lit(False)))


def not_finished(jobs: DataFrame, existing: DataFrame, key: str, finished: Sequence[str]) -> DataFrame:
    """Jobs that may be started: those that are not there in a finished status."""
    return jobs.join(existing.where(F.col("status").isin(*finished)).select(key), key, "left_anti")
