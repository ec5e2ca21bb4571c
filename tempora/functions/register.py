"""The engine's functions under SQL names."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tempora.functions.text import SENTENCE_PUNCTUATION

_SPACE = r"(?U)[\\s\\x1c-\\x1f]+"
SQL_FUNCTIONS = {
    "collapse_whitespace(t STRING) RETURNS STRING": f"trim(regexp_replace(t, '{_SPACE}', ' '))",
    "srt_time(ms BIGINT) RETURNS STRING": "format_string('%02d:%02d:%02d,%03d', ms div 3600000, ms div 60000 % 60, ms div 1000 % 60, ms % 1000)",
    "clock(seconds BIGINT) RETURNS STRING": "format_string('%02d:%02d:%02d', greatest(0, seconds) div 3600, greatest(0, seconds) div 60 % 60, greatest(0, seconds) % 60)",
    "cut_sentences(t STRING) RETURNS ARRAY<STRING>": (
        f"filter(transform(regexp_extract_all(t, '[^{SENTENCE_PUNCTUATION}]*[{SENTENCE_PUNCTUATION}]+|[^{SENTENCE_PUNCTUATION}]+$', 0), "
        f"x -> trim(regexp_replace(x, '{_SPACE}', ' '))), x -> x <> '')"
    ),
}


@udtf(returnType="s bigint, e bigint")
class MergeIntervals:
    """Maximal intervals of two arrays of starts and ends; touching ones merge."""

    def eval(self, starts: list, ends: list) -> Iterator[tuple[int, int]]:
        held = None
        for s, e in sorted(zip(starts or [], ends or [], strict=True)):
            if e <= s:
                continue
            if held is not None and s <= held[1]:
                held = (held[0], max(held[1], e))
            else:
                if held is not None:
                    yield held
                held = (s, e)
        if held is not None:
            yield held


_TIME = re.compile(r"(\d{2}):(\d{2}):(\d{2}),(\d{3})\s*-->\s*(\d{2}):(\d{2}):(\d{2}),(\d{3})")


@udtf(returnType="id int, start_ms bigint, end_ms bigint, text string")
class ParseSrt:
    """The cues of one subtitle text."""

    def eval(self, content: str) -> Iterator[tuple[int, int, int, str]]:
        n = 0
        for block in re.split(r"\r?\n\r?\n+", (content or "").lstrip("﻿").strip()):
            lines = [x for x in block.splitlines() if x.strip()]
            skip = 1 if len(lines) >= 3 and lines[0].strip().isdigit() else 0
            found = _TIME.fullmatch(lines[skip].strip()) if len(lines) > skip else None
            if not found:
                continue
            a, b = (((int(h) * 60 + int(m)) * 60 + int(s)) * 1000 + int(ms) for h, m, s, ms in (found.groups()[:4], found.groups()[4:]))
            said = " ".join(" ".join(lines[skip + 1 :]).split())
            if a != b and said:
                yield n, a, b, said
                n += 1


def register(spark: SparkSession) -> None:
    """Make the functions known to this session's SQL."""
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("merge_intervals", MergeIntervals)
    spark.udtf.register("parse_srt", ParseSrt)
