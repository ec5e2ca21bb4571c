"""Time codes as columns: milliseconds are longs, seconds doubles or decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tempora.functions.text import col

SRT_TIME = r"\d{2}:\d{2}:\d{2},\d{3}"


SAMPLE_RATE = 16_000


def to_seconds(samples: Column | str, rate: int = SAMPLE_RATE) -> Column:
    return col(samples) / rate


def to_samples(seconds: Column | str, rate: int = SAMPLE_RATE) -> Column:
    """The nearest sample."""
    return F.round(col(seconds).cast("double") * rate).cast("long")


def parse_srt_millis(c: Column | str) -> Column:
    """Milliseconds of ``hh:mm:ss,mmm``; null for anything else, hours of three digits included."""
    x = col(c)
    part = lambda i: F.regexp_extract(x, r"^(\d{2}):(\d{2}):(\d{2}),(\d{3})$", i).try_cast("long")
    return part(1) * 3_600_000 + part(2) * 60_000 + part(3) * 1000 + part(4)


def srt_time(ms: Column | str) -> Column:
    """``hh:mm:ss,mmm``; hours may exceed 99."""
    x = col(ms)
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(x / 3_600_000), F.floor(x / 60_000) % 60, F.floor(x / 1000) % 60, x % 1000)


def clock(seconds: Column | str) -> Column:
    """``hh:mm:ss`` of whole seconds, at least zero."""
    x = F.greatest(F.lit(0).cast("long"), col(seconds).cast("long"))
    return F.format_string("%02d:%02d:%02d", F.floor(x / 3600), F.floor(x / 60) % 60, x % 60)


def seconds_to_millis(seconds: Column | str) -> Column:
    """Milliseconds, halves rounded up, from the decimal value."""
    return F.round(col(seconds).cast("decimal(18,6)") * 1000, 0).cast("long")


def _parts(hundredths: Column) -> tuple[Column, Column, Column]:
    return F.floor(hundredths / 360_000), F.floor(hundredths / 6000) % 60, hundredths % 6000


def _two_places(hundredths: Column, pad: bool) -> Column:
    whole = F.floor(hundredths / 100)
    return F.format_string("%02d.%02d" if pad else "%d.%02d", whole, hundredths % 100)


def format_duration(hundredths: Column | str) -> Column:
    """``1h 2m 03.04s``, ``2m 03.04s`` or ``3.04s``, from seconds rounded to hundredths first."""
    x = col(hundredths).cast("long")
    h, m, s = _parts(x)
    return (
        F.when(x < 6000, F.concat(_two_places(x, False), F.lit("s")))
        .when(x < 360_000, F.format_string("%dm %ss", m, _two_places(s, True)))
        .otherwise(F.format_string("%dh %dm %ss", h, m, _two_places(s, True)))
    )


def format_elapsed(seconds: Column | str) -> Column:
    """Like ``format_duration``, but the parts are split before rounding (59.999 gives 60.00s)."""
    x = col(seconds)
    h, rest = F.floor(x / 3600), F.pmod(x, F.lit(3600.0))
    m, s = F.floor(rest / 60), F.pmod(rest, F.lit(60.0))
    padded = F.lpad(F.format_string("%.2f", s), 5, "0")
    return (
        F.when(h >= 1, F.format_string("%dh %dm %ss", h, m, padded))
        .when(m >= 1, F.format_string("%dm %ss", m, padded))
        .otherwise(F.format_string("%.2fs", x))
    )
