"""SubRip subtitles: reading, writing, probing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.functions.text import collapse_whitespace
from tempora.functions.timecode import SRT_TIME, parse_srt_millis, seconds_to_millis, srt_time

# Fixed value.
EMPTY = "Subtitle SRT is empty or invalid."


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of whole subtitle files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def parse(files: DataFrame, keys: Sequence[str] = ("path",), content: str = "content") -> DataFrame:
    """Cues (keys, id, start_ms, end_ms, text) of subtitle texts.

    A byte-order mark, CR LF, an index line and several text lines are allowed.
    Cues without a valid time line, of zero duration or without text are
    dropped; ids count from 0.
    """
    text = F.regexp_replace(F.col(content), "^﻿", "")
    text = F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), "\r\n", "\n")
    blocks = files.select(*keys, F.posexplode(F.split(text, r"\n\n+")).alias("block", "raw"))
    lines = F.filter(F.transform(F.split("raw", r"[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"), lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: F.trim(x) != "")
    cues = blocks.select(*keys, "block", lines.alias("lines")).where(F.size("lines") >= 2)
    skip = F.when(F.coalesce(F.try_element_at("lines", F.lit(1)), F.lit("")).rlike(r"^\d+$") & (F.size("lines") >= 3), 1).otherwise(0)
    cues = cues.withColumn("skip", skip).withColumn("time", F.trim(F.try_element_at("lines", F.col("skip") + 1)))
    times = rf"^({SRT_TIME})\s*-->\s*({SRT_TIME})$"
    cues = cues.where(F.col("time").rlike(times)).select(
        *keys,
        "block",
        parse_srt_millis(F.regexp_extract("time", times, 1)).alias("start_ms"),
        parse_srt_millis(F.regexp_extract("time", times, 2)).alias("end_ms"),
        collapse_whitespace(F.array_join(F.slice("lines", F.col("skip") + 2, F.size("lines")), " ")).alias("text"),
    )
    kept = cues.where("start_ms <> end_ms AND text <> ''")
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("block")) - 1
    return kept.select(*keys, number.alias("id"), "start_ms", "end_ms", "text")


def probe(files: DataFrame, keys: Sequence[str] = ("path",), content: str = "content") -> DataFrame:
    """keys, the number of cues, and an error where there is none."""
    counts = parse(files, keys, content).groupBy(*keys).agg(F.count(F.lit(1)).alias("cues"))
    n = F.coalesce("cues", F.lit(0).cast("long"))
    return files.select(*keys).join(counts, list(keys), "left").select(*keys, n.alias("cues"), F.when(n == 0, EMPTY).alias("error"))


def cue_block(number: Column, start_ms: Column, end_ms: Column, text: Column) -> Column:
    return F.concat(number.cast("string"), F.lit("\n"), srt_time(start_ms), F.lit(" --> "), srt_time(end_ms), F.lit("\n"), text)


def render(segments: DataFrame, keys: Sequence[str], order: str = "id", *, bom: bool = True) -> DataFrame:
    """Subtitle files (keys, content) from segments with start_ms, end_ms and text; cues count from 1."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    blocks = segments.select(*keys, number.alias("n"), "start_ms", "end_ms", collapse_whitespace("text").alias("t"))
    blocks = blocks.select(*keys, "n", cue_block(F.col("n"), F.col("start_ms"), F.col("end_ms"), F.col("t")).alias("b"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "b"))), lambda r: r["b"])
    content = F.concat(F.lit("﻿" if bom else ""), F.array_join(ordered, "\n\n"), F.lit("\n"))
    return blocks.groupBy(*keys).agg(content.alias("content"))


def millis(segments: DataFrame, keys: Sequence[str], duration: Column | None = None, order: str = "id") -> DataFrame:
    """Segments with start_ms and end_ms rounded half up, and a violation where that leaves none or overlaps."""
    from tempora.operators.contracts import finite_nonnegative, first_broken

    good = finite_nonnegative("start") & finite_nonnegative("end")
    safe = lambda c: seconds_to_millis(F.when(good, F.col(c)))
    rows = segments.withColumns({"start_ms": safe("start"), "end_ms": safe("end")})
    before = F.lag("end_ms", 1, 0).over(Window.partitionBy(*keys).orderBy(order))
    rules = [(~good, "time_not_finite")]
    if duration is not None:
        rules.append((F.col("end") > duration, "past_duration"))
    rules += [
        (F.col("end_ms") <= F.col("start_ms"), "empty_after_rounding"),
        (F.col("start_ms") < before, "overlap_after_rounding"),
        (collapse_whitespace("text") == "", "empty_text"),
    ]
    return rows.withColumn("violation", first_broken(*rules))


def render_markdown(segments: DataFrame, keys: Sequence[str], metadata: dict[str, Column], order: str = "id") -> DataFrame:
    """A Markdown transcript (keys, content): metadata lines, then one line per paragraph.

    ``segments`` has start, end (seconds) and text, merged already.
    """
    from tempora.functions.text import safe_line
    from tempora.functions.timecode import clock

    line = F.concat(F.lit("["), clock("start"), F.lit(" - "), clock("end"), F.lit("] "), F.col("text"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda r: r["l"])
    body = segments.groupBy(*keys).agg(F.array_join(ordered, "\n").alias("__body"))
    head = [F.concat(F.lit(f"{name}: "), safe_line(F.coalesce(value.cast("string"), F.lit("")))) for name, value in metadata.items()]
    content = F.concat(F.lit("## metadata\n\n"), F.array_join(F.array(*head), "\n"), F.lit("\n\n## transcript text\n\n"), F.col("__body"), F.lit("\n"))
    return body.select(*keys, content.alias("content"))


def to_markdown(files: DataFrame, keys: Sequence[str], metadata: dict[str, Column], content: str = "content") -> DataFrame:
    """Subtitle files as Markdown transcripts: parsed, merged into paragraphs, rendered."""
    from tempora.operators.segments import merge_paragraphs

    cues = parse(files, keys, content).select(*keys, "id", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "text")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("id", "start", "end", "text"))), lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["text"].alias("text")))
    merged = cues.groupBy(*keys).agg(ordered.alias("segments"))
    paragraphs = merged.select(*keys, F.posexplode(merge_paragraphs(F.col("segments"))).alias("id", "p")).select(*keys, "id", "p.*")
    return render_markdown(paragraphs, keys, metadata)
