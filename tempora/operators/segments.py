"""Cutting and merging time-stamped text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.functions.text import SENTENCE_PUNCTUATION, col, collapse_whitespace, ends_strongly, ends_with_punctuation

MERGE_GAP_SECONDS = 5
MERGE_LENGTH = 64

SEGMENT = T.StructType([
    T.StructField("id", T.IntegerType()), T.StructField("start", T.DoubleType()),
    T.StructField("end", T.DoubleType()), T.StructField("text", T.StringType()),
])


def sentences(c: Column | str) -> Column:
    """A text's sentences: cut after runs of sentence punctuation, stripped, empty ones dropped."""
    cut = F.regexp_extract_all(col(c), F.lit(f"[^{SENTENCE_PUNCTUATION}]*[{SENTENCE_PUNCTUATION}]+|[^{SENTENCE_PUNCTUATION}]+$"), F.lit(0))
    return F.filter(F.transform(cut, collapse_whitespace), lambda x: x != "")


def renumber(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "id") -> DataFrame:
    """Rows numbered from 0 in order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def clean_segments(df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str = "text") -> DataFrame:
    """White space collapsed, empty segments dropped, ids dense again."""
    kept = df.withColumn(text, collapse_whitespace(text)).where(F.col(text) != "")
    return renumber(kept, keys, order)


def concatenated(df: DataFrame, keys: Sequence[str], order: str, text: str, separator: str, name: str = "text") -> DataFrame:
    """A key's texts joined in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["t"]), separator).alias(name))


def merge_paragraphs(segments: Column, gap=MERGE_GAP_SECONDS, length: int = MERGE_LENGTH) -> Column:
    """Paragraphs of an ordered array of (start, end, text) as an array of the same kind.

    A paragraph ends before a pause longer than ``gap``, and after a strong
    ending or more than ``length`` characters.  Texts join directly after
    punctuation, else with a blank.  One fold over the array, without Python.
    """
    empty = F.lit(None).cast("array<struct<start:double,end:double,text:string>>")
    nothing = F.struct(F.coalesce(empty, F.array().cast("array<struct<start:double,end:double,text:string>>")).alias("done"), F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"), F.lit("").alias("text"))

    def flushed(done, start, end, text):
        return F.concat(done, F.array(F.struct(start.alias("start"), end.alias("end"), text.alias("text"))))

    def step(a, x):
        pause = (a["text"] != "") & (x["start"] - a["end"] > gap)
        done = F.when(pause, flushed(a["done"], a["start"], a["end"], a["text"])).otherwise(a["done"])
        held = F.when(pause, F.lit("")).otherwise(a["text"])
        start = F.when(held == "", x["start"]).otherwise(a["start"])
        text = F.when(held == "", x["text"]).otherwise(F.concat(held, F.when(ends_with_punctuation(held), "").otherwise(" "), x["text"]))
        closes = ends_strongly(text) | (F.length(text) > length)
        return F.struct(
            F.when(closes, flushed(done, start, x["end"], text)).otherwise(done).alias("done"),
            start.alias("start"),
            x["end"].alias("end"),
            F.when(closes, F.lit("")).otherwise(text).alias("text"),
        )

    return F.aggregate(segments, nothing, step, lambda a: F.when(a["text"] == "", a["done"]).otherwise(flushed(a["done"], a["start"], a["end"], a["text"])))


def merge_paragraphs_of(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per paragraph (keys, id, start, end, text) of rows with start, end and text.

    Works on one key at a time in Python and so in linear time; meant for long
    recordings, where the array fold copies its result once per paragraph.
    """
    import unicodedata

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        out, start, end, text = [], 0.0, 0.0, ""
        for s, e, t in pdf.sort_values(order)[["start", "end", "text"]].itertuples(index=False):
            if text and s - end > MERGE_GAP_SECONDS:
                out.append((start, end, text))
                text = ""
            if text:
                text += ("" if unicodedata.category(text[-1]).startswith("P") else " ") + t
            else:
                start, text = s, t
            end = e
            if text[-1] in "。！？.!?" or len(text) > MERGE_LENGTH:
                out.append((start, end, text))
                text = ""
        if text:
            out.append((start, end, text))
        frame = pd.DataFrame(out, columns=["start", "end", "text"])
        frame.insert(0, "id", range(len(frame)))
        for k in reversed(list(keys)):
            frame.insert(0, k, pdf[k].iloc[0])
        return frame

    return df.groupBy(*keys).applyInPandas(merge, f"{kinds}, id int, start double, end double, text string")


class AlignmentError(ValueError):
    """Tokens that do not follow the text."""


def align(text: str, tokens: Sequence[str], on_boundary: Callable[[int, int], None] | None = None) -> None:
    """Walk a text along its tokens; only white space and punctuation may lie between or inside them.

    Sentence punctuation sets a boundary, which is reported once the next token
    starts: with the text position after it and the number of tokens before it.
    """
    import unicodedata

    for i, token in enumerate(tokens):
        if not token:
            raise AlignmentError(f"token {i} is empty")
    token = inside = 0
    boundary = None
    for at, c in enumerate(text):
        if token < len(tokens) and c == tokens[token][inside]:
            if inside == 0 and boundary is not None:
                if on_boundary is not None:
                    on_boundary(*boundary)
                boundary = None
            inside += 1
            if inside == len(tokens[token]):
                token, inside = token + 1, 0
                if c in SENTENCE_PUNCTUATION:
                    boundary = (at + 1, token)
        elif c.isspace() or unicodedata.category(c).startswith("P"):
            if c in SENTENCE_PUNCTUATION and inside == 0:
                boundary = (at + 1, token)
        else:
            raise AlignmentError(f"token {token}: the text has {c!r} at {at}")
    if token < len(tokens):
        raise AlignmentError(f"token {token}: the text ends before it")


def sentence_segments(text: str, items: Sequence[tuple[str, float, float]], duration: float | None = None) -> list[dict]:
    """Sentences of an aligned text with the times of their first and last tokens.

    ``items`` are (token, start, end).  With ``duration``, ends are clamped to it.
    """
    if not items:
        align(text, [])
        return []
    cuts: list[tuple[int, int]] = []
    align(text, [t for t, _, _ in items], lambda at, token: cuts.append((at, token)))
    out: list[dict] = []
    begin = first = 0
    for at, token in [*cuts, (len(text), len(items))]:
        said = text[begin:at].strip()
        last = at == len(text) and token == len(items)
        if token > first or last:
            if said and first < len(items):
                end = round(items[max(token, first + 1) - 1][2], 3)
                out.append({"id": len(out), "start": round(items[first][1], 3), "end": end if duration is None else min(end, duration), "text": said})
            first = token
        begin = at
    return out


@F.pandas_udf(T.StructType([T.StructField("segments", T.ArrayType(SEGMENT)), T.StructField("error", T.StringType())]))
def align_sentences(text: pd.Series, items: pd.Series) -> pd.DataFrame:
    """Sentence segments of (text, array of (text, start, end)), or the reason why the tokens do not fit."""
    rows = []
    for t, tokens in zip(text, items, strict=True):
        try:
            found = sentence_segments(t or "", [(i["text"], i["start"], i["end"]) for i in (tokens if tokens is not None else [])])
            rows.append((found, None))
        except AlignmentError as e:
            rows.append((None, str(e)))
    return pd.DataFrame(rows, columns=["segments", "error"])


def clip_last(df: DataFrame, keys: Sequence[str], order: str, duration: Column, tolerance: float = 0.1) -> DataFrame:
    """The last word's end cut to the duration where it starts in time and overruns by at most ``tolerance``."""
    is_last = F.lead(F.lit(1)).over(Window.partitionBy(*keys).orderBy(order)).isNull()
    over = is_last & (F.col("start") <= duration) & (F.col("end") > duration) & (F.col("end") - duration <= tolerance)
    return df.withColumn("end", F.when(over, duration).otherwise(F.col("end")))


def clamp_to(df: DataFrame, duration: Column) -> DataFrame:
    """Start and end at most the duration."""
    return df.withColumns({"start": F.least("start", duration), "end": F.least("end", duration)})


def valid_words(df: DataFrame) -> DataFrame:
    """Null text becomes empty, rows without times go, times have three decimals."""
    times = {c: F.round(F.col(c), 3) for c in ("start", "end")}
    return df.where("start IS NOT NULL AND end IS NOT NULL").withColumns({"text": F.coalesce("text", F.lit("")), **times})


def flatten_words(df: DataFrame, segments: str = "segments", words: str = "words") -> DataFrame:
    """One row per word of nested segments, with segment and word positions."""
    outer = df.select("*", F.posexplode(segments).alias("segment_no", "__segment"))
    return outer.select(*df.columns, "segment_no", F.posexplode(F.col(f"__segment.{words}")).alias("word_no", "word")).select(*[c for c in df.columns if c != segments], "segment_no", "word_no", "word.*")


def round_half_even_3(c: Column | str) -> Column:
    """Three decimals as binary floating point gives them (1.0005 -> 1.0); SQL's round gives 1.001."""

    @F.pandas_udf(T.DoubleType())
    def rounded(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if pd.isna(v) else round(v, 3))

    return rounded(col(c))
