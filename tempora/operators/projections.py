"""Small record projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions.text import col

FAILURE_MESSAGES = {"fetch": "Resource preparation failed."}
OTHER_FAILURE = "Summary preparation failed."


def compact(map_column: Column | str, keys: Sequence[str]) -> Column:
    """A map's listed keys that are there and not null."""
    return F.map_filter(col(map_column), lambda k, v: k.isin(list(keys)) & v.isNotNull())


def zip_exact(a: Column | str, b: Column | str) -> Column:
    """Two arrays by position; an error if their sizes differ."""
    both = F.arrays_zip(col(a).alias("a"), col(b).alias("b"))
    return F.when(F.size(col(a)) == F.size(col(b)), both).otherwise(F.raise_error(F.lit("sizes differ")))


def nested(df: DataFrame, name: str, fields: Sequence[str]) -> DataFrame:
    """Columns moved into a struct."""
    return df.withColumn(name, F.struct(*fields)).drop(*fields)


def flat(df: DataFrame, name: str) -> DataFrame:
    """A struct's fields as columns."""
    return df.select(*[c for c in df.columns if c != name], f"{name}.*")


def failed_job(df: DataFrame, stage: Column, kind: Column, message: Column, allowed: Sequence[str]) -> DataFrame:
    """Jobs turned into failed ones: results cleared, and the message kept only if it is an allowed one."""
    fixed = F.when(stage == "fetch", FAILURE_MESSAGES["fetch"]).otherwise(OTHER_FAILURE)
    said = F.when(message.isin(list(allowed)), message).otherwise(fixed)
    cleared = {c: F.lit(None).cast(df.schema[c].dataType) for c in ("transcript", "transcription_manifest", "prompt") if c in df.columns}
    return df.withColumns({**cleared, "status": F.lit("failed"), "error": F.struct(stage.alias("stage"), kind.alias("type"), said.alias("message"))})


def neighbours(points: DataFrame, keys: Sequence[str], point: str, lo: Column, hi: Column) -> DataFrame:
    """Points with those one before and after, distinct, inside [lo, hi]."""
    out = points.select(*keys, F.explode(F.array(F.col(point) - 1, F.col(point), F.col(point) + 1)).alias(point), lo.alias("__lo"), hi.alias("__hi"))
    return out.where(F.col(point).between(F.col("__lo"), F.col("__hi"))).select(*keys, point).distinct()


def metadata_prompt(template: Column, transcript: Column, fields: dict[str, Column]) -> Column:
    """A prompt: the template with its {{name}} fields filled, then the transcript."""
    out = template
    for name, value in fields.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return F.concat_ws("\n\n", out, transcript)


def bounded_slice(array: Column | str, start: Column, end: Column) -> Column:
    """Elements start to end (exclusive, from 0), held to the array's bounds; empty where nothing lies between."""
    lo = F.least(F.greatest(start.cast("int"), F.lit(0)), F.size(col(array)))
    hi = F.least(F.greatest(end.cast("int"), lo), F.size(col(array)))
    return F.slice(col(array), lo + 1, hi - lo)
