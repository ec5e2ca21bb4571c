"""Sealed results: a manifest with its transcript and raw timestamps, read as one checked snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions.canonical import canonical_sha256
from tempora.operators import contracts

IDENTITY = ("audio_id", "variant_id", "provider", "language", "duration")


def with_variant(manifests: DataFrame, parameters: list[str]) -> DataFrame:
    """Manifests with ``recomputed_variant_id``, the digest of every parameter that affects the output."""
    return manifests.withColumn("recomputed_variant_id", canonical_sha256(**{p: F.col(p) for p in parameters}))


def load(manifests: DataFrame, transcripts: DataFrame, raw: DataFrame, parameters: list[str]) -> DataFrame:
    """One row per manifest: its identity, segments and items, and the first rule that any part breaks.

    ``transcripts`` and ``raw`` have the identity columns and arrays
    ``segments`` (id, start, end, text) and ``items`` (text, start, end,
    probability).
    """
    key = "variant_id"
    head = contracts.manifest(with_variant(manifests, parameters))
    parts = head
    for name, side in (("transcript", transcripts), ("raw", raw)):
        checked = contracts.same_identity(side, manifests, key, [c for c in IDENTITY if c != key])
        payload = "segments" if name == "transcript" else "items"
        parts = parts.join(checked.select(key, payload, F.col("violation").alias(f"__{name}")), key, "left")
    rows = transcripts.select(key, F.col("duration").alias("__d"), F.inline("segments"))
    segments = contracts.transcript(rows, [key], F.col("__d")).where("violation IS NOT NULL").groupBy(key).agg(F.min_by("violation", "id").alias("__segments"))
    words = raw.select(key, F.col("duration").alias("__d"), "provider", F.posexplode("items").alias("pos", "i")).select(key, "__d", "provider", "pos", "i.*")
    bad = contracts.raw_timestamps(words, [key], ["pos"], F.col("__d"), F.col("provider")).where("violation IS NOT NULL").groupBy(key).agg(F.min_by("violation", "pos").alias("__items"))
    out = parts.join(segments, key, "left").join(bad, key, "left")
    missing = F.when(F.col("segments").isNull(), "transcript_missing").when(F.col("items").isNull(), "raw_timestamps_missing")
    first = F.coalesce("violation", missing, "__transcript", "__raw", "__segments", "__items")
    return out.select(*IDENTITY, "segments", "items", first.alias("violation"))


SCHEMA_VERSION = 1


def _json(**fields: Column) -> Column:
    """One JSON object with the schema version first; null fields are written."""
    return F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), *[c.alias(name) for name, c in fields.items()]), {"ignoreNullFields": "false"})


def interval_payloads(intervals: DataFrame, keys: list[str], source: Column, parameters: Column, name: str = "payload") -> DataFrame:
    """What is stored of a recording's intervals (s, e): source and parameters as structs, intervals in order."""
    spans = F.array_sort(F.collect_list(F.struct(F.col("s").alias("start_sample"), F.col("e").alias("end_sample"))))
    grouped = intervals.groupBy(*keys).agg(spans.alias("__spans"), F.any_value(source).alias("__source"), F.any_value(parameters).alias("__parameters"))
    return grouped.select(*keys, _json(source=F.col("__source"), parameters=F.col("__parameters"), speech_intervals=F.col("__spans")).alias(name))


def chunk_payloads(chunks: DataFrame, keys: list[str], plan: Column, fields: list[str], name: str = "payload") -> DataFrame:
    """What is stored of each chunk: the whole plan, which tells whether it may be reused, then the transcript's fields."""
    return chunks.select(*keys, _json(plan=plan, **{f: F.col(f) for f in fields}).alias(name))


def merged_payloads(chunks: DataFrame, keys: list[str], plan: Column, order: str, text: str, words: str, name: str = "payload") -> DataFrame:
    """What is stored of a merged result: the plan, the chunks' texts joined in order, their words in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"), F.col(words).alias("w"))))
    grouped = chunks.groupBy(*keys).agg(rows.alias("__rows"), F.any_value(plan).alias("__plan"))
    joined = F.array_join(F.transform("__rows", lambda r: r["t"]), "")
    return grouped.select(*keys, _json(plan=F.col("__plan"), text=joined, words=F.flatten(F.transform("__rows", lambda r: r["w"]))).alias(name))
