"""Data contracts: each validator adds ``violation``, the first rule broken, or null.

``enforce`` turns violations into an error, for callers that want the strict mode.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.canonical import contained_path, is_sha256
from tempora.functions.text import col

# Fixed values.
BOUNDARIES = ("silence", "hard", "audio_end")
PROVIDERS = ("faster-whisper", "qwen3-asr")
WITHOUT_PROBABILITY = "qwen3-asr"
TIME_EPSILON = 0.001
SUMMARY_STATUSES = ("preparing", "needs_transcription", "prompt_ready", "complete", "failed")
SUBTITLE_STATUSES = ("needs_transcription", "editable")


class ContractError(ValueError):
    """Rows that break a contract."""


def first_broken(*rules: tuple[Column, str]) -> Column:
    """The reason of the first rule whose condition holds, in order; a null condition does not hold."""
    out = F.lit(None).cast("string")
    for condition, reason in reversed(rules):
        out = F.when(condition, F.lit(reason)).otherwise(out)
    return out


def enforce(df: DataFrame, name: str = "violation") -> DataFrame:
    """``df`` without its violation column; raises if any row has one."""
    bad = df.where(F.col(name).isNotNull()).groupBy(name).count().orderBy(F.desc("count"), name).limit(5).collect()
    if bad:
        raise ContractError("; ".join(f"{r[name]}: {r['count']} rows" for r in bad))
    return df.drop(name)


def finite_nonnegative(c: Column | str) -> Column:
    x = col(c).cast("double")
    return F.coalesce(~F.isnan(x) & (x >= 0) & (x < float("inf")), F.lit(False))


def exact_keys(map_column: Column | str, keys: Sequence[str]) -> Column:
    """Whether a map has exactly these keys."""
    return F.coalesce(F.array_sort(F.map_keys(col(map_column))) == F.array(*[F.lit(k) for k in sorted(keys)]), F.lit(False))


def unique(array: Column | str) -> Column:
    return F.size(F.array_distinct(col(array))) == F.size(col(array))


def _order(keys: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def transcript(df: DataFrame, keys: Sequence[str], duration: Column | None = None) -> DataFrame:
    """Segments (id, start, end, text): ids from 0, text, previous end <= start < end <= duration."""
    w = _order(keys, ["id"])
    rules = [
        (F.col("id").isNull() | (F.col("id") != F.row_number().over(w) - 1), "id_not_continuous"),
        (F.coalesce(F.trim("text"), F.lit("")) == "", "empty_text"),
        (~finite_nonnegative("start") | ~finite_nonnegative("end"), "time_not_finite"),
        (F.col("start") < F.lag("end", 1, 0).over(w), "starts_before_previous_end"),
        (F.col("end") <= F.col("start"), "not_positive_length"),
    ]
    if duration is not None:
        rules.append((F.col("end") > duration, "past_duration"))
    return df.withColumn("violation", first_broken(*rules))


def raw_timestamps(df: DataFrame, keys: Sequence[str], order: Sequence[str], duration: Column, provider: Column | None = None) -> DataFrame:
    """Words (text, start, end, probability): previous end <= start <= end <= duration; zero length is allowed."""
    w = _order(keys, order)
    rules = [
        (F.coalesce(F.col("text"), F.lit("")) == "", "empty_text"),
        (~finite_nonnegative("start") | ~finite_nonnegative("end"), "time_not_finite"),
        (F.col("start") < F.lag("end", 1, 0).over(w), "starts_before_previous_end"),
        (F.col("end") < F.col("start"), "negative_length"),
        (F.col("end") > duration, "past_duration"),
        (F.col("probability").isNotNull() & (F.isnan("probability") | ~F.col("probability").between(0.0, 1.0)), "probability_out_of_range"),
    ]
    if provider is not None:
        rules.append(((provider == WITHOUT_PROBABILITY) & F.col("probability").isNotNull(), "unexpected_probability"))
    return df.withColumn("violation", first_broken(*rules))


def alignment_times(df: DataFrame, keys: Sequence[str], order: Sequence[str], duration: Column, epsilon: float = TIME_EPSILON) -> DataFrame:
    """Token times as in ``raw_timestamps``, each within ``epsilon``."""
    w = _order(keys, order)
    return df.withColumn("violation", first_broken(
        (F.isnan("start") | F.isnan("end") | F.col("start").isNull() | F.col("end").isNull(), "time_not_finite"),
        (F.col("start") < 0, "negative_start"),
        (F.col("start") + epsilon < F.lag("end", 1, 0).over(w), "starts_before_previous_end"),
        (F.col("end") + epsilon < F.col("start"), "negative_length"),
        (F.col("end") > duration + epsilon, "past_duration"),
    ))


def layout(df: DataFrame, keys: Sequence[str], *, shortest: Column, longest: Column, length: Column) -> DataFrame:
    """Chunks (idx, s, e, boundary, speech): a gapless cover of [0, length) with lengths in bounds."""
    w = _order(keys, ["idx"])
    size = F.col("e") - F.col("s")
    final = F.lead(F.lit(1)).over(w).isNull()
    return df.withColumn("violation", first_broken(
        (F.col("idx") != F.row_number().over(w) - 1, "index_not_continuous"),
        (F.col("s") != F.lag("e", 1, 0).over(w), "not_contiguous"),
        ((size <= 0) | (size > longest), "length_out_of_bounds"),
        ((length >= shortest) & (size < shortest), "length_out_of_bounds"),
        ((F.col("speech") < 0) | (F.col("speech") > size), "speech_out_of_bounds"),
        (~F.col("boundary").isin(*BOUNDARIES), "unknown_boundary"),
        ((F.col("boundary") == "audio_end") != final, "audio_end_not_last"),
        (final & (F.col("e") != length), "does_not_reach_end"),
    ))


def manifest(df: DataFrame) -> DataFrame:
    """A result manifest, flat: schema_version, status, audio and request fields, digests, variant_id and its recomputation."""
    return df.withColumn("violation", first_broken(
        (~F.col("schema_version").eqNullSafe(F.lit(1)), "schema_version"),
        (~F.col("status").eqNullSafe(F.lit("complete")), "status"),
        (~is_sha256("audio_id"), "audio_id"),
        (~finite_nonnegative("duration"), "duration"),
        (F.coalesce(F.col("sample_count") <= 0, F.lit(True)) | F.coalesce(F.col("sample_rate") <= 0, F.lit(True)), "audio_shape"),
        (~F.coalesce(F.col("provider").isin(*PROVIDERS), F.lit(False)), "provider"),
        (F.coalesce(F.col("language"), F.lit("")) == "", "language"),
        (~is_sha256("variant_id") | ~F.col("variant_id").eqNullSafe(F.col("recomputed_variant_id")), "variant_id"),
        (~is_sha256("transcript_sha256") | ~is_sha256("raw_timestamps_sha256"), "artifact_sha256"),
        (~contained_path("transcript_path") | ~contained_path("raw_timestamps_path"), "artifact_path"),
    ))


def same_identity(df: DataFrame, other: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Rows of ``df`` with the first field that differs from the row of ``other`` with the same key."""
    theirs = other.select(key, *[F.col(f).alias(f"__{f}") for f in fields], F.lit(1).alias("__there"))
    joined = df.join(theirs, key, "left")
    rules = [(F.col("__there").isNull(), "missing"), *[(~F.col(f).eqNullSafe(F.col(f"__{f}")), f) for f in fields]]
    return joined.withColumn("violation", first_broken(*rules)).select(*df.columns, "violation")


def summary_job(df: DataFrame, from_subtitle: str = "subtitle", from_audio: str = "audio") -> DataFrame:
    """The nullability matrix of a summary job by status.

    ``from_subtitle`` and ``from_audio`` are the values of transcript_source.
    Columns: status, bvid, title, url, fetch_manifest, subtitle, audio,
    subtitle_skipped, transcript_source, transcript_path,
    transcription_manifest, prompt_path, summary_path, error_stage,
    error_type, error_message.
    """
    has = lambda *cs: F.greatest(*[F.col(c).isNotNull() for c in cs]) if len(cs) > 1 else F.col(cs[0]).isNotNull()
    produced = has("transcript_source", "transcript_path", "transcription_manifest", "prompt_path", "summary_path")
    error = has("error_stage", "error_type", "error_message")
    early, ready = F.col("status").isin("preparing", "needs_transcription"), F.col("status").isin("prompt_ready", "complete")
    subtitle, audio = F.col("transcript_source") == from_subtitle, F.col("transcript_source") == from_audio
    absolute = lambda c: F.coalesce(F.col(c).startswith("/"), F.lit(False))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return df.withColumn("violation", first_broken(
        (~F.coalesce(F.col("status").isin(*SUMMARY_STATUSES), F.lit(False)), "status"),
        (empty("bvid") | empty("title") | empty("url"), "video"),
        (F.col("subtitle_skipped").isNull(), "subtitle_skipped"),
        (~contained_path("fetch_manifest"), "fetch_manifest"),
        (F.col("subtitle").isNotNull() & ~contained_path("subtitle") | F.col("audio").isNotNull() & ~contained_path("audio"), "resource_path"),
        (early & produced, "early_job_has_results"),
        (early & error, "early_job_has_error"),
        ((F.col("status") == "needs_transcription") & F.col("audio").isNull(), "audio_missing"),
        (ready & ~F.coalesce(subtitle | audio, F.lit(False)), "transcript_source"),
        (ready & subtitle & ~contained_path("transcript_path"), "transcript_path"),
        (ready & subtitle & F.col("transcription_manifest").isNotNull(), "unexpected_manifest"),
        (ready & audio & (~absolute("transcript_path") | ~absolute("transcription_manifest")), "path_not_absolute"),
        (ready & (~contained_path("prompt_path") | ~contained_path("summary_path")), "prompt"),
        (ready & error, "ready_job_has_error"),
        ((F.col("status") == "failed") & produced, "failed_job_has_results"),
        ((F.col("status") == "failed") & ~(F.col("error_stage").isNotNull() & F.col("error_type").isNotNull() & F.col("error_message").isNotNull()), "error_shape"),
    ))


def subtitle_job(df: DataFrame) -> DataFrame:
    """The contract of a subtitle job.

    Columns: schema_version, job_id, audio_id, audio_path, status,
    changed_ids, manifest_path, variant_id, baseline_sha256 and its
    recomputation baseline_digest, normalized_sha256 and normalized_digest,
    subtitle, subtitle_sha256 and subtitle_digest, expected_changed_ids.
    """
    editable = F.col("status") == "editable"
    derived = [F.col(c).isNotNull() for c in ("normalized_sha256", "subtitle", "subtitle_sha256")]
    any_set, all_set = derived[0] | derived[1] | derived[2], derived[0] & derived[1] & derived[2]
    ids = F.col("changed_ids")
    absolute = lambda c: F.coalesce(F.col(c).startswith("/"), F.lit(False))
    return df.withColumn("violation", first_broken(
        (~F.col("schema_version").eqNullSafe(F.lit(1)), "schema_version"),
        (~is_sha256("job_id"), "job_id"),
        (~F.col("audio_id").eqNullSafe(F.col("job_id")), "audio_id"),
        (~absolute("audio_path"), "audio_path"),
        (ids.isNull() | F.exists(ids, lambda i: i.isNull() | (i < 0)) | ~unique(ids), "changed_ids"),
        (~F.coalesce(F.col("status").isin(*SUBTITLE_STATUSES), F.lit(False)), "status"),
        (~editable & (F.col("manifest_path").isNotNull() | F.col("variant_id").isNotNull() | F.col("baseline_sha256").isNotNull() | any_set | (F.size(ids) > 0)), "untranscribed_job_has_results"),
        (editable & (~absolute("manifest_path") | ~is_sha256("variant_id")), "transcription"),
        (editable & (~is_sha256("baseline_sha256") | ~F.col("baseline_sha256").eqNullSafe(F.col("baseline_digest"))), "baseline_digest"),
        (editable & ~any_set & (F.size(ids) > 0), "unfinalized_job_has_changes"),
        (editable & any_set & ~all_set, "derived_fields"),
        (editable & any_set & ~F.col("normalized_sha256").eqNullSafe(F.col("normalized_digest")), "normalized_digest"),
        (editable & any_set & ~F.col("subtitle_sha256").eqNullSafe(F.col("subtitle_digest")), "subtitle_digest"),
        (editable & any_set & ~ids.eqNullSafe(F.col("expected_changed_ids")), "changed_ids_differ"),
    ))


def planner_input(df: DataFrame) -> DataFrame:
    """n, k, shortest, longest: positive and k * shortest <= n <= k * longest (short audio: one chunk)."""
    short = F.col("n") < F.col("shortest")
    return df.withColumn("violation", first_broken(
        (F.col("n").isNull() | (F.col("n") <= 0), "sample_count"),
        (F.col("k").isNull() | (F.col("k") <= 0), "chunk_count"),
        ((F.col("shortest") <= 0) | (F.col("longest") < F.col("shortest")), "bounds"),
        (short & (F.col("k") != 1), "infeasible"),
        (~short & ~F.col("n").between(F.col("k") * F.col("shortest"), F.col("k") * F.col("longest")), "infeasible"),
    ))


def cached_chunk(chunks: DataFrame, layouts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cached chunks (idx, s, e, text) held against the current layout; the violation says what differs."""
    now = layouts.select(*keys, "idx", F.col("s").alias("__s"), F.col("e").alias("__e"), F.lit(1).alias("__there"))
    joined = chunks.join(now, [*keys, "idx"], "left")
    bad = first_broken(
        (F.col("__there").isNull(), "not_in_plan"),
        ((F.col("s") != F.col("__s")) | (F.col("e") != F.col("__e")), "other_range"),
        (F.col("text").isNull(), "no_text"),
    )
    return joined.withColumn("violation", bad).select(*chunks.columns, "violation")


def chunk_transcript(df: DataFrame) -> DataFrame:
    """A chunk's result: text, language, and non-negative elapsed time."""
    return df.withColumn("violation", first_broken(
        (F.col("text").isNull(), "text"),
        (F.coalesce(F.col("language"), F.lit("")) == "", "language"),
        (~finite_nonnegative("elapsed"), "elapsed"),
    ))


def missing_files(required: DataFrame, listing: DataFrame, keys: Sequence[str], name: str = "file") -> DataFrame:
    """Required files that the listing lacks; a model is complete where this is empty."""
    return required.select(*keys, name).distinct().join(listing.select(*keys, name), [*keys, name], "left_anti")


def missing_shards(index: DataFrame, listing: DataFrame, keys: Sequence[str], weights: str = "weight_map", name: str = "file") -> DataFrame:
    """Shard files named by an index map that the listing lacks."""
    shards = index.select(*keys, F.explode(F.map_values(weights)).alias(name))
    return missing_files(shards, listing, keys, name)


def differs_from_recomputation(cached: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Rows that only one side has, as often as it has them more; empty where the cache is valid."""
    recomputed = recomputed.select(*cached.columns)
    return cached.exceptAll(recomputed).withColumn("side", F.lit("cached")).union(recomputed.exceptAll(cached).withColumn("side", F.lit("recomputed")))


def thread_options(df: DataFrame) -> DataFrame:
    """beam_size, workers, threads, cpus: positive, and workers * threads within three quarters of the CPUs."""
    budget = F.greatest(F.floor(F.col("cpus") * 0.75), F.lit(1))
    return df.withColumn("violation", first_broken(
        (F.coalesce(F.col("beam_size") < 1, F.lit(True)), "beam_size"),
        (F.coalesce((F.col("workers") < 1) | (F.col("threads") < 1), F.lit(True)), "workers"),
        (F.col("workers") * F.col("threads") > budget, "cpu_budget"),
    ))
