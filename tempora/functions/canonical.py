"""Content identity: canonical JSON, digests, strict JSON and safe paths."""

from __future__ import annotations

import json
import math
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.functions.text import col

SHA256 = r"^[0-9a-f]{64}$"


def canonical_json(**fields: Column | str) -> Column:
    """Compact JSON of string and integer fields in order of their names; null fields are written."""
    return F.to_json(F.struct(*[col(c).alias(name) for name, c in sorted(fields.items())]), {"ignoreNullFields": "false"})


def canonical_sha256(**fields: Column | str) -> Column:
    return F.sha2(canonical_json(**fields), 256)


def is_sha256(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike(SHA256), F.lit(False))


def content_sha256(c: Column | str) -> Column:
    """Digest of text (UTF-8) or bytes; depends on the content alone."""
    return F.sha2(col(c), 256)


def canonical_text(value) -> str:
    """Canonical JSON of any value: sorted keys, compact, Unicode as it is, no NaN or infinity."""
    return json.dumps(value, ensure_ascii=False, allow_nan=False, sort_keys=True, separators=(",", ":"))


def pretty_text(value) -> str:
    return json.dumps(value, ensure_ascii=False, allow_nan=False, indent=2) + "\n"


def parse_strict(raw: str | bytes, *, decimals: bool = False):
    """A JSON object without duplicate keys, NaN, infinities or trailing text; ValueError otherwise.

    With ``decimals`` numbers with a fraction become decimals, digit by digit.
    """

    def no_duplicates(pairs):
        out = {}
        for key, value in pairs:
            if key in out:
                raise ValueError(f"duplicate key {key!r}")
            out[key] = value
        return out

    def no_constant(name):
        raise ValueError(f"{name} is not allowed")

    def finite(text):
        value = float(text)
        if not math.isfinite(value):
            raise ValueError("number out of range")
        return Decimal(text) if decimals else value

    text = raw.decode("utf-8") if isinstance(raw, bytes) else raw
    out = json.loads(text, object_pairs_hook=no_duplicates, parse_constant=no_constant, parse_float=finite)
    if not isinstance(out, dict):
        raise ValueError("the root is not an object")
    return out


@F.pandas_udf(T.StringType())
def strict_json(raw: pd.Series) -> pd.Series:
    """Canonical JSON of a strictly valid object, else null.  Spark's own parsers accept duplicates or NaN."""

    def one(text):
        try:
            return None if text is None else canonical_text(parse_strict(text))
        except (ValueError, RecursionError):
            return None

    return raw.map(one)


def contained_path(c: Column | str) -> Column:
    """Whether a relative path stays inside its folder: not empty, not absolute, never above it.

    Each part counts one level, ``..`` takes one away, and the level may never
    fall below zero.
    """
    parts = F.filter(F.split(col(c), "/"), lambda p: ~p.isin("", "."))
    start = F.struct(F.lit(0).alias("level"), F.lit(True).alias("ok"))

    def step(a, p):
        level = a["level"] + F.when(p == "..", -1).otherwise(1)
        return F.struct(level.alias("level"), (a["ok"] & (level >= 0)).alias("ok"))

    inside = F.aggregate(parts, start, step, lambda a: a["ok"] & (a["level"] > 0))
    return F.coalesce(~col(c).rlike(r"^(/|[A-Za-z]:|\\)") & ~col(c).contains("\\") & inside, F.lit(False))


def digests_of_files(binary_files: DataFrame) -> DataFrame:
    """path, bytes and sha256 of a ``binaryFile`` source."""
    return binary_files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
