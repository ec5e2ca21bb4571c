"""Files and JSON as sources, and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions.canonical import strict_json
from tempora.functions.text import chunk_key, subtitle_language
from tempora.operators.contracts import first_broken
from tempora.operators.ranking import first_by, preference_rank

TEMPORARY = (".part", ".ytdl", ".tmp")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, name, bytes and modified time of files, without their contents."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.try_element_at(F.split("path", "/"), F.lit(-1)).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def media(files: DataFrame) -> DataFrame:
    """Files without those that are still being written, newest first."""
    unfinished = F.lit(False)
    for suffix in TEMPORARY:
        unfinished = unfinished | F.lower("name").endswith(suffix)
    return files.where(~unfinished).orderBy(F.desc("modified"), "name")


def of_id(files: DataFrame, ident: str) -> DataFrame:
    """Files named by an id: the id itself, or the id and anything after a dot."""
    return files.where((F.col("name") == ident) | F.col("name").startswith(f"{ident}."))


def is_usable_subtitle(name: Column | str) -> Column:
    return F.lower(name).endswith(".srt")


def subtitles(files: DataFrame, languages: Sequence[str]) -> DataFrame:
    """Subtitle files in the wanted languages with their preference rank."""
    tagged = files.where(is_usable_subtitle("name")).withColumn("language", subtitle_language("name"))
    return tagged.where(F.col("language").isin(list(languages))).withColumn("rank", preference_rank(F.col("language"), languages))


def best_subtitle(files: DataFrame, probes: DataFrame, keys: Sequence[str], languages: Sequence[str]) -> DataFrame:
    """The first valid subtitle per key: by language preference, then the newest, then by name."""
    valid = subtitles(files, languages).join(probes.where("error IS NULL").select("path"), "path", "left_semi")
    return first_by(valid, keys, ["rank", -F.unix_micros("modified"), "name"])


def strict_objects(rows: DataFrame, raw: str, name: str = "object") -> DataFrame:
    """Rows with the canonical JSON of strictly valid objects, null for any other text."""
    return rows.withColumn(name, strict_json(F.col(raw)))


def lenient_objects(rows: DataFrame, raw: str, schema: str, name: str = "object") -> DataFrame:
    """Rows with JSON parsed by Spark; unreadable text gives nulls."""
    return rows.withColumn(name, F.from_json(raw, schema, {"mode": "PERMISSIVE"}))


def vad_status(rows: DataFrame) -> DataFrame:
    """``reason`` for cached interval files; null where they may be used.

    Columns: found, readable, schema_version, source, wanted_source,
    parameters, wanted_parameters, structure (a violation or null).
    """
    return rows.withColumn("reason", first_broken(
        (~F.coalesce("found", F.lit(False)), "missing"),
        (~F.coalesce("readable", F.lit(False)), "unreadable"),
        (~F.col("schema_version").eqNullSafe(F.lit(1)), "schema_mismatch"),
        (~F.col("source").eqNullSafe(F.col("wanted_source")), "source_mismatch"),
        (~F.col("parameters").eqNullSafe(F.col("wanted_parameters")), "parameters_mismatch"),
        (F.col("structure").isNotNull(), "invalid_structure"),
    ))


def matching_plan(wanted: DataFrame, cached: DataFrame, key: str, identity: Sequence[str]) -> DataFrame:
    """Cached plans whose whole identity equals the wanted one."""
    return wanted.select(key, *identity).join(cached, [key, *identity])


def chunk_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON results of chunks (with ``index``) whose file is named by their chunk, ``chunk_<index>.json``."""
    rows = spark.read.schema(schema).json(path).select("*", F.col("_metadata.file_name").alias("__name"))
    return rows.where(F.col("__name") == F.concat(chunk_key("index"), F.lit(".json"))).drop("__name")


def with_optional(rows: DataFrame, side: DataFrame, key: str, defaults: dict) -> DataFrame:
    """Rows with the fields of a side table, or their defaults."""
    out = rows.join(side, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line; the committer publishes whole files only."""
    df.write.mode("overwrite").json(path)


def workspace_rows(df: DataFrame) -> DataFrame:
    """Results that may be stored: with a text and at least one item."""
    return df.withColumn("violation", first_broken(
        (F.trim(F.coalesce("text", F.lit(""))) == "", "empty_text"),
        (F.coalesce(F.size("items"), F.lit(0)) <= 0, "no_items"),
    ))
