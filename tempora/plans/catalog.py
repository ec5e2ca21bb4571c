"""The registered queries: each is one plan over the tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.functions import canonical, text, timecode, urls
from tempora.operators import contracts, diff, incremental, intervals, layouts, metrics, planner, projections, ranking, segments
from tempora.plans import oracles, records
from tempora.sources import srt
from tempora.sources.tables import DAY_US, MINUTE_US, event_spans, table

USER = ["user_id"]


def _islands(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    spans = event_spans(spark, sf_dir)
    if kind:
        spans = spans.where(F.col("event_type") == kind)
    return intervals.union(intervals.normalize(spans), USER, bucket=DAY_US)


def _starts(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return event_spans(spark, sf_dir).where(F.col("event_type") == kind).select("event_id", "user_id", F.col("s").alias("x"))


def interval_union(spark, sf_dir):
    return _islands(spark, sf_dir)


def interval_gaps(spark, sf_dir):
    return intervals.gaps(_islands(spark, sf_dir), USER)


def interval_clip_measure(spark, sf_dir):
    days = intervals.split_by_bucket(_islands(spark, sf_dir), DAY_US, "day")
    return intervals.measure(days, ["user_id", "day"], "covered")


def interval_intersect_pairs(spark, sf_dir):
    return intervals.intersect(_islands(spark, sf_dir, "view"), _islands(spark, sf_dir, "click"), USER, DAY_US)


def speech_at_coordinate(spark, sf_dir):
    return intervals.measure_before(_starts(spark, sf_dir, "error"), _islands(spark, sf_dir), USER, "x", "covered", bucket=DAY_US)


def coordinate_at_measure(spark, sf_dir):
    points = event_spans(spark, sf_dir).where("event_type = 'signup'").select("event_id", "user_id", (F.col("event_id") * MINUTE_US).alias("amount"))
    found = intervals.coordinate_at(points, _islands(spark, sf_dir), USER, bucket=DAY_US)
    return found.withColumn("coordinate", F.coalesce("coordinate", F.lit(-1).cast("long")))


def hard_boundary_flag(spark, sf_dir):
    return intervals.is_inside(_starts(spark, sf_dir, "purchase"), _islands(spark, sf_dir), USER, "x", "hard", bucket=DAY_US)


def first_n_seconds(spark, sf_dir):
    return intervals.first_length(_islands(spark, sf_dir), USER, 600 * MINUTE_US, bucket=DAY_US)


def gap_sessions(spark, sf_dir):
    rows = intervals.sessions(event_spans(spark, sf_dir), USER, 60 * MINUTE_US, bucket=DAY_US)
    return rows.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("s"), F.max("e").alias("e"))


def sentence_segments(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", F.posexplode(segments.sentences("text")).alias("id", "sentence"))


def _timed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as segments, ten seconds apart, with pauses of three to six seconds."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.safe_line("text").alias("text")).where("text <> ''")
    start = F.col("turn") * 10.0
    return turns.select("conv_id", "turn", start.alias("start"), (start + 4 + F.col("turn") % 4).alias("end"), "text")


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _timed_turns(spark, sf_dir)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "start", "end", "text"))), lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["text"].alias("text")))
    merged = rows.groupBy("conv_id").agg(ordered.alias("segments"))
    return merged.select("conv_id", F.posexplode(segments.merge_paragraphs(F.col("segments"))).alias("id", "p")).select("conv_id", "id", "p.*")


def paragraph_merge(spark, sf_dir):
    return _paragraphs(spark, sf_dir)


def markdown_render(spark, sf_dir):
    meta = {"title": F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")), "source": F.lit("conversations")}
    return srt.render_markdown(_paragraphs(spark, sf_dir), ["conv_id"], meta)


def segment_contract_violations(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    start = F.col("turn") * 10.0
    rows = turns.select("conv_id", F.col("turn").alias("id"), start.alias("start"), (start + F.length("text") % 13).alias("end"), "text")
    return contracts.transcript(rows, ["conv_id"], F.lit(60.0)).select("conv_id", "id", "violation")


def layout_contract_violations(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("long").alias("q"), F.max("l_returnflag").alias("f"), F.max("l_discount").alias("d"))
    per_order = lines.groupBy("l_orderkey").agg((F.count(F.lit(1)) * 50).alias("length"))
    s = (F.col("l_linenumber").cast("long") - 1) * 50
    kind = F.when(F.col("f") == "A", "silence").when(F.col("f") == "N", "hard").otherwise("audio_end")
    size = F.when(F.col("q") >= 5, 50).otherwise(F.col("q"))
    chunks = lines.join(per_order, "l_orderkey").select("l_orderkey", (F.col("l_linenumber") - 1).alias("idx"), s.alias("s"), (s + size).alias("e"), kind.alias("boundary"), F.round(F.col("d") * 100).cast("long").alias("speech"), "length")
    return contracts.layout(chunks, ["l_orderkey"], shortest=F.lit(2), longest=F.lit(50), length=F.col("length")).select("l_orderkey", "idx", "violation")


def _cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    start = F.col("turn") * 5.0005
    return turns.select("conv_id", F.col("turn").alias("id"), timecode.seconds_to_millis(start).alias("start_ms"), timecode.seconds_to_millis(start + 4.25).alias("end_ms"), "text")


def srt_render(spark, sf_dir):
    return srt.render(_cues(spark, sf_dir), ["conv_id"])


def srt_roundtrip(spark, sf_dir):
    return srt.parse(srt.render(_cues(spark, sf_dir), ["conv_id"]), ["conv_id"])


def timecode_format(spark, sf_dir):
    ms = F.col("event_id") * 7919 * 1000 + 37
    hundredths = F.round(F.col("value") * 100).cast("long") * 10
    rows = table(spark, sf_dir, "events").select("event_id", ms.alias("ms"), hundredths.alias("h"))
    return rows.select("event_id", timecode.srt_time("ms").alias("srt"), timecode.clock(F.floor(F.col("ms") / 1000)).alias("clock"), timecode.format_duration("h").alias("duration"))


def whitespace_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.collapse_whitespace("text").alias("normalized"))


def safe_line(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.safe_line("text").alias("line"))


def sanitize_filename(spark, sf_dir):
    name = F.concat_ws(" : ", "p_name", "p_brand", "p_type", F.lit("? .. "))
    return table(spark, sf_dir, "part").select("p_partkey", text.sanitize_filename(name).alias("name"))


def strip_non_prose(spark, sf_dir):
    prose = text.strip_non_prose("html")
    return table(spark, sf_dir, "pages").select("page_id", F.length(prose).alias("n_chars"), F.sha2(prose, 256).alias("sha256"))


def language_ratio(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.chinese_count("text").alias("chinese"), text.english_count("text").alias("english"), text.language_ratio("text", F.lit("en")).alias("ratio")
    )


def summary_validation(spark, sf_dir):
    name = F.concat(F.lit("page_summary_"), F.when(F.col("page_id") % 2 == 0, "en").otherwise("ZH"), F.lit(".md"))
    rows = table(spark, sf_dir, "pages").select("page_id", name.alias("name"), "html")
    return rows.select("page_id", F.array_join(text.summary_errors("html"), "; ").alias("errors"), text.language_mismatch("html", "name").alias("mismatch"))


def url_canonicalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.drop_tracking("url", ["page"]).alias("canonical"))


def video_identity(spark, sf_dir):
    raw = F.concat(F.lit("http://m.site.test/video/BV"), F.col("page_id").cast("string"), F.lit("x/?from=feed&p="), (F.col("page_id") % 5).cast("string"), F.lit("#t"))
    rows = table(spark, sf_dir, "pages").select("page_id", urls.canonical_video_url(raw).alias("canonical"))
    return rows.select("page_id", "canonical", urls.video_id("canonical").alias("video_id"))


def content_identity(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", canonical.content_sha256("text").alias("sha256"), F.octet_length("text").alias("bytes"))


def exact_duplicates(spark, sf_dir):
    rows = content_identity(spark, sf_dir)
    return rows.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


def variant_identity(spark, sf_dir):
    ident = canonical.canonical_sha256(status="o_orderstatus", key="o_orderkey", priority="o_orderpriority")
    return table(spark, sf_dir, "orders").select("o_orderkey", ident.alias("variant_id"))


def _labels(spark: SparkSession, sf_dir: str, quality: int) -> DataFrame:
    return table(spark, sf_dir, "labels").where(F.col("quality") == quality)


def pending_chunks(spark, sf_dir):
    return incremental.pending(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), ["doc_id"])


def progress_status(spark, sf_dir):
    failed = _labels(spark, sf_dir, 0).select("doc_id", F.lit("low quality").alias("error"))
    return incremental.progress(table(spark, sf_dir, "documents").select("doc_id", "source"), _labels(spark, sf_dir, 1), failed, ["doc_id"])


def failure_summary(spark, sf_dir):
    failed = progress_status(spark, sf_dir).where("status = 'failed'")
    return incremental.failure_summary(failed, ["source"], "doc_id", "error")


def correction_diff(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    edited = docs.select("doc_id", F.when(F.col("source") == "src3", "xx").otherwise(F.col("lang")).alias("lang"), "source", text.collapse_whitespace("text").alias("text"))
    return diff.correction_diff(docs, edited, ["doc_id"], ["lang", "source"])


def preference_top1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "lang", "n_chars")
    ranked = docs.withColumn("rank", ranking.preference_rank("lang", ["fr", "de", "en"]))
    return ranking.first_by(ranked, ["source"], ["rank", -F.col("n_chars"), "doc_id"])


def load_metrics(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("long").alias("load"), "l_returnflag")
    return metrics.load_metrics(lines, ["l_orderkey"], "load", F.col("l_returnflag") == "R")


def _recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.floor("o_totalprice").alias("n"))


SHORTEST, LONGEST = 3_000, 18_000


def legal_chunk_counts(spark, sf_dir):
    low, high = metrics.legal_chunk_range(F.col("n"), F.lit(SHORTEST), F.lit(LONGEST))
    counts = metrics.chunk_counts(F.col("n"), F.lit(SHORTEST), F.lit(LONGEST), 4)
    return _recordings(spark, sf_dir).select("o_orderkey", low.alias("low"), high.alias("high"), F.array_join(counts.cast("array<string>"), ",").alias("counts"))


def _planned(spark: SparkSession, sf_dir: str, boundaries: Callable[[Column, Column], Column]) -> DataFrame:
    low, _ = metrics.legal_chunk_range(F.col("n"), F.lit(SHORTEST), F.lit(LONGEST))
    rows = _recordings(spark, sf_dir).withColumn("k", low).where("k IS NOT NULL")
    return rows.select("o_orderkey", "k", F.array_join(boundaries(F.col("n"), F.col("k")).cast("array<string>"), ",").alias("boundaries"))


def plan_balanced(spark, sf_dir):
    return _planned(spark, sf_dir, layouts.balanced_boundaries)


def plan_earliest(spark, sf_dir):
    return _planned(spark, sf_dir, lambda n, k: layouts.earliest_boundaries(n, k, SHORTEST, LONGEST))


def plan_chunks(spark, sf_dir):
    """Each user's month in units of ten minutes, split into chunks of one to four days."""
    unit = 10 * MINUTE_US
    spans = intervals.normalize(event_spans(spark, sf_dir))
    span = spans.agg(F.min("s").alias("t0"), F.max("e").alias("t1")).first()  # two numbers
    t0, t1 = span["t0"] or 0, span["t1"] or 0
    rows = spans.select("user_id", F.floor((F.col("s") - t0) / unit).alias("s"), F.ceil((F.col("e") - t0) / unit).alias("e"), F.lit(-(-(t1 - t0) // unit)).alias("n"))
    return planner.plan_recordings(rows, USER, "n", shortest=144, longest=576, group=4)


def skyline_prune(spark, sf_dir):
    return ranking.skyline(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), "p_size", "p_retailprice", ["p_partkey", "p_size", "p_retailprice"])


def batch_assignment(spark, sf_dir):
    return metrics.batches(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], ["doc_id"], bucket=10_000)


def status_rollup(spark, sf_dir):
    status = F.when((F.col("event_type") != "error") & (F.col("value") > 40), "fail").when((F.col("event_type") == "error") & (F.col("value") > 60), "fail").otherwise("pass")
    provider = F.when(F.col("event_type") != "error", F.col("event_type"))
    checks = table(spark, sf_dir, "events").select("user_id", status.alias("status"), (F.col("event_type") == "error").alias("core"), provider.alias("provider"))
    return metrics.status_rollup(checks, USER)


def state_transitions_valid(spark, sf_dir):
    names = F.when(F.col("o_orderstatus") == "O", "preparing").when(F.col("o_orderstatus") == "P", "prompt_ready").otherwise("complete")
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", names.alias("after"))
    moves = incremental.illegal_moves(rows.withColumn("before", F.lag("after").over(order)), "before", "after", incremental.SUMMARY_MOVES)
    return moves.groupBy("before", "after", "legal").agg(F.count(F.lit(1)).alias("n"))


def json_props_strict(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", canonical.strict_json(F.col("props")).alias("object"))


def concatenated_text(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.clean_line("text").alias("line"))
    return segments.concatenated(turns, ["conv_id"], "turn", "line", " ")


def compact_metadata(spark, sf_dir):
    fields = F.create_map(F.lit("url"), F.col("url"), F.lit("html"), F.col("html"), F.lit("id"), F.col("page_id").cast("string"))
    kept = projections.compact(fields, ["id", "url", "title"])
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("keys"), F.try_element_at(kept, F.lit("url")).alias("url"))


def boundary_neighbours(spark, sf_dir):
    rows = _recordings(spark, sf_dir).select("o_orderkey", (F.col("n") % 100).alias("x"))
    return projections.neighbours(rows, ["o_orderkey"], "x", F.lit(0), F.lit(98))


_QUERIES = (
    interval_union, interval_gaps, interval_clip_measure, interval_intersect_pairs, speech_at_coordinate, coordinate_at_measure,
    hard_boundary_flag, first_n_seconds, gap_sessions, sentence_segments, paragraph_merge, markdown_render, segment_contract_violations,
    layout_contract_violations, srt_render, srt_roundtrip, timecode_format, whitespace_normalize, safe_line, sanitize_filename,
    strip_non_prose, language_ratio, summary_validation, url_canonicalize, video_identity, content_identity, exact_duplicates,
    variant_identity, pending_chunks, progress_status, failure_summary, correction_diff, preference_top1, load_metrics,
    legal_chunk_counts, plan_balanced, plan_earliest, plan_chunks, skyline_prune, batch_assignment, status_rollup,
    state_transitions_valid, json_props_strict, concatenated_text, compact_metadata, boundary_neighbours,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES} | records.QUERIES


def oracle_sql() -> dict[str, str]:
    return oracles.ORACLES | records.ORACLES
