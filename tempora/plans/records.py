"""Queries over records: contracts, jobs, files, words and text rules, each with its DuckDB SQL.

The tables hold no jobs or files, so a query derives its records from the rows
of a table.  ``_Rows`` writes such columns once, in expressions that Spark and
DuckDB both read; the rules themselves are written twice, as the operator and
as plain SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions import text, timecode, urls
from tempora.operators import contracts, incremental, intervals, jobs, metrics, planner, projections, ranking, segments
from tempora.runtime import scratch
from tempora.sources import files, results, srt
from tempora.sources.tables import event_spans, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _spark(sql: str) -> str:
    """``SHA(x)`` is the hexadecimal SHA-256 of a text, ``TEXT(x)`` a value as text."""
    out = sql.replace("TEXT(", "string(")
    while "SHA(" in out:
        at = out.index("SHA(")
        depth, end = 0, at + 3
        while True:
            depth += (out[end] == "(") - (out[end] == ")")
            if depth == 0:
                break
            end += 1
        out = f"{out[:at]}sha2{out[at + 3 : end]}, 256){out[end + 1 :]}"
    return out


def _duck(sql: str) -> str:
    return sql.replace("SHA(", "sha256(").replace("TEXT(", "concat(")


class _Rows:
    """Columns derived from a table, for both engines."""

    def __init__(self, table_name: str, /, **columns: str) -> None:
        self.table, self.columns = table_name, columns

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, self.table).select(*[F.expr(_spark(x)).alias(name) for name, x in self.columns.items()])

    @property
    def sql(self) -> str:
        return f"(SELECT {', '.join(f'{_duck(x)} AS {name}' for name, x in self.columns.items())} FROM {self.table})"


def query(sql: str):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _first(*rules: tuple[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {condition} THEN '{reason}'" for condition, reason in rules) + " END"


_HEX = "regexp_full_match(coalesce({x}, ''), '[0-9a-f]{{64}}')"
_is_hex = lambda x: _HEX.format(x=x)
_inside = lambda x: f"({x} IS NOT NULL AND NOT starts_with({x}, '/') AND NOT starts_with({x}, '..') AND {x} <> '')"

# --- results and their parts

_MANIFESTS = _Rows(
    "orders",
    o_orderkey="o_orderkey",
    schema_version="CASE WHEN o_orderkey % 31 = 0 THEN 2 ELSE 1 END",
    status="CASE WHEN o_orderkey % 29 = 0 THEN 'running' ELSE 'complete' END",
    audio_id="CASE WHEN o_orderkey % 23 = 0 THEN 'ABC' ELSE SHA(TEXT(o_orderkey)) END",
    duration="CASE WHEN o_orderkey % 19 = 0 THEN -o_totalprice ELSE o_totalprice END",
    sample_count="o_orderkey % 17",
    sample_rate="16000",
    provider="CASE o_orderkey % 9 WHEN 0 THEN 'other' WHEN 1 THEN NULL WHEN 2 THEN 'qwen3-asr' ELSE 'faster-whisper' END",
    language="CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'en' END",
    variant_id="SHA(o_orderpriority)",
    recomputed_variant_id="CASE WHEN o_orderkey % 11 = 0 THEN SHA(o_orderstatus) ELSE SHA(o_orderpriority) END",
    transcript_sha256="SHA(o_orderstatus)",
    raw_timestamps_sha256="CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE SHA(o_orderstatus) END",
    transcript_path="CASE o_orderkey % 6 WHEN 0 THEN '../t.json' WHEN 1 THEN '/t.json' WHEN 2 THEN 'a/../t.json' ELSE 't.json' END",
    raw_timestamps_path="'raw.json'",
)


@query(f"""SELECT o_orderkey, {_first(
    ('schema_version <> 1', 'schema_version'), ("status <> 'complete'", 'status'), (f"NOT {_is_hex('audio_id')}", 'audio_id'), ('duration < 0', 'duration'),
    ('sample_count <= 0 OR sample_rate <= 0', 'audio_shape'), ("provider IS NULL OR provider NOT IN ('faster-whisper', 'qwen3-asr')", 'provider'), ("language = ''", 'language'),
    ('variant_id <> recomputed_variant_id', 'variant_id'), (f"NOT {_is_hex('transcript_sha256')} OR NOT {_is_hex('raw_timestamps_sha256')}", 'artifact_sha256'),
    (f"NOT {_inside('transcript_path')}", 'artifact_path'))} AS violation FROM {_MANIFESTS.sql}""")  # fmt: skip
def manifest_violations(spark, sf_dir):
    return contracts.manifest(_MANIFESTS.df(spark, sf_dir)).select("o_orderkey", "violation")


_THEIRS = _Rows("documents", doc_id="doc_id * 2", lang="CASE WHEN doc_id % 5 = 0 THEN 'xx' ELSE lang END", source="CASE WHEN doc_id % 7 = 0 THEN NULL ELSE source END")
_MINE = _Rows("documents", doc_id="doc_id * 2 + doc_id % 2", lang="lang", source="source")


@query(f"""SELECT d.doc_id, d.lang, d.source, CASE WHEN o.doc_id IS NULL THEN 'missing' WHEN d.lang IS DISTINCT FROM o.lang THEN 'lang' WHEN d.source IS DISTINCT FROM o.source THEN 'source' END AS violation
FROM {_MINE.sql} d LEFT JOIN {_THEIRS.sql} o ON d.doc_id = o.doc_id""")
def artifact_identity(spark, sf_dir):
    return contracts.same_identity(_MINE.df(spark, sf_dir), _THEIRS.df(spark, sf_dir), "doc_id", ["lang", "source"])


_WORDS = _Rows(
    "conversations",
    conv_id="conv_id",
    turn="turn",
    text="CASE WHEN (conv_id + turn) % 11 = 0 THEN '' ELSE role END",
    start="turn * 2.0e0 - CASE WHEN (conv_id + turn) % 7 = 3 THEN 2.0e0 ELSE 0.0e0 END",
    end="turn * 2.0e0 + CASE (conv_id + turn) % 5 WHEN 0 THEN 0.0e0 WHEN 1 THEN -1.0e0 ELSE 1.5e0 END",
    probability="CASE (conv_id + turn) % 9 WHEN 0 THEN NULL WHEN 1 THEN 1.5e0 ELSE 0.5e0 END",
    provider="CASE WHEN conv_id % 4 = 0 THEN 'qwen3-asr' ELSE 'faster-whisper' END",
)
_WORDS.columns = {("t1" if k == "end" else k): v for k, v in _WORDS.columns.items()}


@query(f"""SELECT conv_id, turn, {_first(
    ("text = ''", 'empty_text'), ('start < 0 OR t1 < 0', 'time_not_finite'), ('start < p', 'starts_before_previous_end'), ('t1 < start', 'negative_length'), ('t1 > 12', 'past_duration'),
    ('probability > 1', 'probability_out_of_range'), ("provider = 'qwen3-asr' AND probability IS NOT NULL", 'unexpected_probability'))} AS violation
FROM (SELECT *, lag(t1, 1, 0.0) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM {_WORDS.sql})""")  # fmt: skip
def raw_timestamp_violations(spark, sf_dir):
    rows = _WORDS.df(spark, sf_dir).withColumnRenamed("t1", "end")
    return contracts.raw_timestamps(rows, ["conv_id"], ["turn"], F.lit(12.0), F.col("provider")).select("conv_id", "turn", "violation")


@query(f"""SELECT conv_id, turn, {_first(('start < 0', 'negative_start'), ('start + 0.5 < p', 'starts_before_previous_end'), ('t1 + 0.5 < start', 'negative_length'), ('t1 > 12.5', 'past_duration'))} AS violation
FROM (SELECT *, lag(t1, 1, 0.0) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM {_WORDS.sql})""")
def alignment_time_violations(spark, sf_dir):
    rows = _WORDS.df(spark, sf_dir).withColumnRenamed("t1", "end")
    return contracts.alignment_times(rows, ["conv_id"], ["turn"], F.lit(12.0), epsilon=0.5).select("conv_id", "turn", "violation")


_SPANS = """SELECT event_id, user_id, event_type, epoch_us(ts) AS s, epoch_us(ts) + CAST(round(value * 60000000) AS BIGINT) AS e FROM events"""
_END = 1_706_000_000_000_000


@query(f"""SELECT event_id, {_first(('s < 0', 'negative'), ('e <= s', 'empty'), (f'e > {_END}', 'past_end'), ('s < p', 'overlap'))} AS violation
FROM (SELECT *, lag(e, 1, 0) OVER (PARTITION BY user_id ORDER BY s, e) AS p FROM ({_SPANS}))""")
def interval_structure(spark, sf_dir):
    return intervals.structure_violation(event_spans(spark, sf_dir), ["user_id"], _END).select("event_id", "violation")


_SUMMARY_JOBS = _Rows(
    "orders",
    o_orderkey="o_orderkey",
    status="CASE o_orderkey % 6 WHEN 0 THEN 'preparing' WHEN 1 THEN 'needs_transcription' WHEN 2 THEN 'prompt_ready' WHEN 3 THEN 'complete' WHEN 4 THEN 'failed' ELSE 'other' END",
    bvid="CASE WHEN o_orderkey % 41 = 0 THEN '' ELSE 'BV1' END",
    title="o_orderpriority",
    url="'https://x'",
    fetch_manifest="CASE WHEN o_orderkey % 37 = 0 THEN '/abs' ELSE 'fetch.json' END",
    subtitle="CASE WHEN o_custkey % 13 = 0 THEN '../s.srt' WHEN o_custkey % 2 = 0 THEN 's.srt' END",
    audio="CASE WHEN o_custkey % 3 > 0 THEN 'a.m4a' END",
    subtitle_skipped="o_custkey % 5 = 0",
    transcript_source="CASE o_custkey % 3 WHEN 0 THEN 'subtitle' WHEN 1 THEN 'audio' END",
    transcript_path="CASE WHEN o_custkey % 7 = 0 THEN NULL WHEN o_custkey % 3 = 1 THEN '/work/t.json' ELSE 't.json' END",
    transcription_manifest="CASE WHEN o_custkey % 3 = 1 THEN '/work/m.json' WHEN o_custkey % 11 = 0 THEN 'm.json' END",
    prompt_path="CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'p.md' END",
    summary_path="'s.md'",
    error_stage="CASE WHEN o_orderkey % 8 IN (4, 5) THEN 'fetch' END",
    error_type="CASE WHEN o_orderkey % 8 IN (4, 6) THEN 'E' END",
    error_message="CASE WHEN o_orderkey % 8 = 4 THEN 'm' END",
)
_PRODUCED = "(transcript_source IS NOT NULL OR transcript_path IS NOT NULL OR transcription_manifest IS NOT NULL OR prompt_path IS NOT NULL OR summary_path IS NOT NULL)"
_CLEARED = ("transcript_source", "transcript_path", "transcription_manifest", "prompt_path", "summary_path")
_EARLY, _READY = "status IN ('preparing', 'needs_transcription')", "status IN ('prompt_ready', 'complete')"
_ERROR = "(error_stage IS NOT NULL OR error_type IS NOT NULL OR error_message IS NOT NULL)"
# Half of the early and failed jobs have no results, so that later rules are reached.
for _c in _CLEARED:
    _SUMMARY_JOBS.columns[_c] = f"CASE WHEN o_orderkey % 6 IN (0, 1, 4) AND o_custkey % 4 > 0 THEN NULL ELSE ({_SUMMARY_JOBS.columns[_c]}) END"


@query(f"""SELECT o_orderkey, {_first(
    ("status = 'other'", 'status'), ("bvid = ''", 'video'), (f"NOT {_inside('fetch_manifest')}", 'fetch_manifest'), (f"subtitle IS NOT NULL AND NOT {_inside('subtitle')}", 'resource_path'),
    (f'{_EARLY} AND {_PRODUCED}', 'early_job_has_results'), (f'{_EARLY} AND {_ERROR}', 'early_job_has_error'), ("status = 'needs_transcription' AND audio IS NULL", 'audio_missing'),
    (f'{_READY} AND transcript_source IS NULL', 'transcript_source'), (f"{_READY} AND transcript_source = 'subtitle' AND NOT {_inside('transcript_path')}", 'transcript_path'),
    (f"{_READY} AND transcript_source = 'subtitle' AND transcription_manifest IS NOT NULL", 'unexpected_manifest'),
    (f"{_READY} AND transcript_source = 'audio' AND (coalesce(NOT starts_with(transcript_path, '/'), true) OR coalesce(NOT starts_with(transcription_manifest, '/'), true))", 'path_not_absolute'),
    (f"{_READY} AND (NOT {_inside('prompt_path')} OR NOT {_inside('summary_path')})", 'prompt'), (f'{_READY} AND {_ERROR}', 'ready_job_has_error'),
    (f"status = 'failed' AND {_PRODUCED}", 'failed_job_has_results'), ("status = 'failed' AND (error_stage IS NULL OR error_type IS NULL OR error_message IS NULL)", 'error_shape'))} AS violation
FROM {_SUMMARY_JOBS.sql}""")  # fmt: skip
def summary_job_violations(spark, sf_dir):
    return contracts.summary_job(_SUMMARY_JOBS.df(spark, sf_dir)).select("o_orderkey", "violation")


_SUBTITLE_JOBS = _Rows(
    "orders",
    o_orderkey="o_orderkey",
    schema_version="CASE WHEN o_orderkey % 31 = 0 THEN 2 ELSE 1 END",
    job_id="CASE WHEN o_orderkey % 29 = 0 THEN 'x' ELSE SHA(TEXT(o_orderkey)) END",
    audio_id="CASE WHEN o_orderkey % 23 = 0 THEN SHA('other') ELSE SHA(TEXT(o_orderkey)) END",
    audio_path="CASE WHEN o_orderkey % 19 = 0 THEN 'a.wav' ELSE '/a.wav' END",
    status="CASE o_custkey % 5 WHEN 0 THEN 'needs_transcription' WHEN 1 THEN 'done' ELSE 'editable' END",
    n="CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_orderkey % 4 END",
    manifest_path="CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE '/m.json' END",
    variant_id="CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE SHA(o_orderpriority) END",
    baseline_sha256="CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE SHA(o_orderstatus) END",
    baseline_digest="CASE WHEN o_orderkey % 17 = 0 THEN SHA('b') ELSE SHA(o_orderstatus) END",
    normalized_sha256="CASE WHEN o_custkey % 10 IN (0, 2) THEN NULL ELSE SHA('n') END",
    normalized_digest="CASE WHEN o_orderkey % 13 = 0 THEN SHA('m') ELSE SHA('n') END",
    subtitle="CASE WHEN o_custkey % 10 IN (0, 2, 3) THEN NULL ELSE 's.srt' END",
    subtitle_sha256="CASE WHEN o_custkey % 10 IN (0, 2) THEN NULL ELSE SHA('s') END",
    subtitle_digest="CASE WHEN o_orderkey % 11 = 0 THEN SHA('t') ELSE SHA('s') END",
)
_ANY = "(normalized_sha256 IS NOT NULL OR subtitle IS NOT NULL OR subtitle_sha256 IS NOT NULL)"


@query(f"""SELECT o_orderkey, {_first(
    ('schema_version <> 1', 'schema_version'), (f"NOT {_is_hex('job_id')}", 'job_id'), ('audio_id <> job_id', 'audio_id'), ("NOT starts_with(audio_path, '/')", 'audio_path'), ('n = 3', 'changed_ids'),
    ("status = 'done'", 'status'), (f"status <> 'editable' AND (manifest_path IS NOT NULL OR variant_id IS NOT NULL OR baseline_sha256 IS NOT NULL OR {_ANY} OR n > 0)", 'untranscribed_job_has_results'),
    ("status = 'editable' AND (manifest_path IS NULL OR variant_id IS NULL)", 'transcription'), ("status = 'editable' AND baseline_sha256 IS DISTINCT FROM baseline_digest", 'baseline_digest'),
    (f"status = 'editable' AND NOT {_ANY} AND n > 0", 'unfinalized_job_has_changes'),
    (f"status = 'editable' AND {_ANY} AND (normalized_sha256 IS NULL OR subtitle IS NULL OR subtitle_sha256 IS NULL)", 'derived_fields'),
    (f"status = 'editable' AND {_ANY} AND normalized_sha256 <> normalized_digest", 'normalized_digest'), (f"status = 'editable' AND {_ANY} AND subtitle_sha256 <> subtitle_digest", 'subtitle_digest'),
    (f"status = 'editable' AND {_ANY} AND n = 2", 'changed_ids_differ'))} AS violation FROM {_SUBTITLE_JOBS.sql}""")  # fmt: skip
def subtitle_job_violations(spark, sf_dir):
    rows = _SUBTITLE_JOBS.df(spark, sf_dir)
    ids = F.when(F.col("n") == 3, F.array(F.lit(1), F.lit(1))).otherwise(F.slice(F.array(F.lit(4), F.lit(9)), F.lit(1), F.col("n").cast("int")))
    expected = F.when(F.col("n") == 2, F.array(F.lit(4))).otherwise(F.col("changed_ids"))
    return contracts.subtitle_job(rows.withColumn("changed_ids", ids).withColumn("expected_changed_ids", expected)).select("o_orderkey", "violation")


_CHUNKS = _Rows("lineitem", l_orderkey="l_orderkey", idx="l_linenumber", s="l_linenumber * 10", e="l_linenumber * 10 + l_suppkey % 3 + 8", text="CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_returnflag END",
                language="CASE WHEN l_partkey % 7 = 0 THEN '' ELSE 'en' END", elapsed="CASE WHEN l_suppkey % 5 = 0 THEN -l_tax ELSE l_tax END")
_LAYOUTS = _Rows("lineitem", l_orderkey="l_orderkey", idx="l_linenumber + 1", s="l_linenumber * 10 + 10", e="l_linenumber * 10 + 19")


@query(f"""SELECT c.l_orderkey, c.idx, c.s, c.e, c.text, CASE WHEN l.idx IS NULL THEN 'not_in_plan' WHEN c.s <> l.s OR c.e <> l.e THEN 'other_range' WHEN c.text IS NULL THEN 'no_text' END AS violation
FROM (SELECT DISTINCT l_orderkey, idx, s, e, text FROM {_CHUNKS.sql}) c LEFT JOIN (SELECT DISTINCT * FROM {_LAYOUTS.sql}) l ON c.l_orderkey = l.l_orderkey AND c.idx = l.idx""")
def cached_chunk_violations(spark, sf_dir):
    chunks = _CHUNKS.df(spark, sf_dir).select("l_orderkey", "idx", "s", "e", "text").distinct()
    return contracts.cached_chunk(chunks, _LAYOUTS.df(spark, sf_dir).distinct(), ["l_orderkey"])


@query(f"""SELECT l_orderkey, idx, {_first(('text IS NULL', 'text'), ("language = ''", 'language'), ('elapsed < 0', 'elapsed'))} AS violation FROM {_CHUNKS.sql}""")
def chunk_transcript_violations(spark, sf_dir):
    return contracts.chunk_transcript(_CHUNKS.df(spark, sf_dir)).select("l_orderkey", "idx", "violation")


_PLANS = _Rows("lineitem", l_orderkey="l_orderkey", l_linenumber="l_linenumber", n="l_partkey % 40 - 2", k="l_suppkey % 6", shortest="CAST(l_quantity AS INTEGER) % 9", longest="10 - l_linenumber")


@query(f"""SELECT l_orderkey, l_linenumber, {_first(
    ('n <= 0', 'sample_count'), ('k <= 0', 'chunk_count'), ('shortest <= 0 OR longest < shortest', 'bounds'), ('n < shortest AND k <> 1', 'infeasible'),
    ('n >= shortest AND NOT n BETWEEN k * shortest AND k * longest', 'infeasible'))} AS violation FROM {_PLANS.sql}""")  # fmt: skip
def planner_input_violations(spark, sf_dir):
    return contracts.planner_input(_PLANS.df(spark, sf_dir)).select("l_orderkey", "l_linenumber", "violation")


_OPTIONS = _Rows("part", p_partkey="p_partkey", beam_size="p_size % 5", workers="p_partkey % 6", threads="p_size % 7", cpus="p_partkey % 16 + 1")


@query(f"""SELECT p_partkey, {_first(('beam_size < 1', 'beam_size'), ('workers < 1 OR threads < 1', 'workers'), ('workers * threads > greatest(floor(cpus * 0.75), 1)', 'cpu_budget'))} AS violation
FROM {_OPTIONS.sql}""")
def thread_option_violations(spark, sf_dir):
    return contracts.thread_options(_OPTIONS.df(spark, sf_dir)).select("p_partkey", "violation")


@query("""SELECT DISTINCT l_suppkey, 'model-' || l_linenumber AS file FROM lineitem
EXCEPT SELECT l_suppkey, 'model-' || l_linenumber FROM lineitem WHERE l_linestatus = 'F' AND l_quantity > 49""")
def missing_model_files(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.concat(F.lit("model-"), F.col("l_linenumber").cast("string")).alias("file"), "l_linestatus", "l_quantity")
    return contracts.missing_files(lines, lines.where("l_linestatus = 'F' AND l_quantity > 49"), ["l_suppkey"])


@query("""SELECT DISTINCT s_suppkey, 'w' || i AS file FROM (SELECT s_suppkey, unnest([s_suppkey % 4, s_suppkey % 7, 9]) AS i FROM supplier)
EXCEPT SELECT l_suppkey, 'w' || (l_linenumber + 1) FROM lineitem""")
def missing_weight_shards(spark, sf_dir):
    name = lambda c: F.concat(F.lit("w"), c.cast("string"))
    k = F.col("s_suppkey")
    weights = F.create_map(F.lit("a"), name(k % 4), F.lit("b"), name(k % 7), F.lit("c"), F.lit("w9"))
    listing = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), name(F.col("l_linenumber") + 1).alias("file"))
    return contracts.missing_shards(table(spark, sf_dir, "supplier").select("s_suppkey", weights.alias("weight_map")), listing, ["s_suppkey"])


@query("""WITH a AS (SELECT source, lang FROM documents), b AS (SELECT source, CASE WHEN doc_id % 9 = 0 THEN 'xx' ELSE lang END AS lang FROM documents WHERE doc_id % 11 > 0)
SELECT *, 'cached' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'recomputed' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def cache_differences(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    again = docs.where("doc_id % 11 > 0").select("source", F.expr("CASE WHEN doc_id % 9 = 0 THEN 'xx' ELSE lang END").alias("lang"))
    return contracts.differs_from_recomputation(docs.select("source", "lang"), again)


@query("SELECT o_orderkey, o_orderkey % 3 <> 0 AS exact, o_orderkey % 3 <> o_custkey % 3 AS distinct_values FROM orders")
def key_sets(spark, sf_dir):
    third = F.col("o_orderkey") % 3
    fields = F.when(third == 0, F.create_map(F.lit("a"), third, F.lit("c"), third)).otherwise(F.create_map(F.lit("b"), third, F.lit("a"), third))
    rows = table(spark, sf_dir, "orders")
    return rows.select("o_orderkey", contracts.exact_keys(fields, ["a", "b"]).alias("exact"), contracts.unique(F.array(third, F.col("o_custkey") % 3)).alias("distinct_values"))


# --- files

_FILES = _Rows(
    "documents",
    key="doc_id % 50",
    name="TEXT(doc_id % 50) || '.' || lang || CASE doc_id % 7 WHEN 0 THEN '.SRT' WHEN 1 THEN '.srt.part' WHEN 2 THEN '.vtt' WHEN 3 THEN '.m4a.tmp' ELSE '.srt' END",
    path="'/f/' || TEXT(doc_id)",
    modified="timestamp_of(1700000000 + n_chars % 100)",
    error="CASE WHEN doc_id % 5 = 0 THEN 'bad' END",
)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {k: v for k, v in _FILES.columns.items() if k != "modified"}
    rows = table(spark, sf_dir, "documents").select(*[F.expr(_spark(x)).alias(k) for k, x in columns.items()], F.timestamp_seconds(1700000000 + F.col("n_chars") % 100).alias("modified"))
    return rows


_FILES_SQL = _FILES.sql.replace("timestamp_of(1700000000 + n_chars % 100)", "1700000000 + n_chars % 100")


@query(f"""WITH f AS (SELECT *, string_split(name, '.') AS parts FROM {_FILES_SQL} WHERE lower(name) LIKE '%.srt' AND error IS NULL),
r AS (SELECT key, name, path, parts[2] AS language, CASE parts[2] WHEN 'fr' THEN 0 WHEN 'en' THEN 1 END AS rank, modified FROM f WHERE parts[2] IN ('fr', 'en'))
SELECT key, language, rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rank, modified DESC, name) AS n FROM r) WHERE n = 1""")
def subtitle_choice(spark, sf_dir):
    rows = _files(spark, sf_dir)
    return files.best_subtitle(rows.drop("error"), rows.select("path", "error"), ["key"], ["fr", "en"]).select("key", "language", "rank")


@query(f"SELECT key, name, path FROM {_FILES_SQL} WHERE NOT (lower(name) LIKE '%.part' OR lower(name) LIKE '%.ytdl' OR lower(name) LIKE '%.tmp')")
def finished_media(spark, sf_dir):
    return files.media(_files(spark, sf_dir)).select("key", "name", "path")


@query(f"SELECT key, name, path FROM {_FILES_SQL} WHERE name = '7' OR name LIKE '7.%'")
def files_of_id(spark, sf_dir):
    return files.of_id(_files(spark, sf_dir), "7").select("key", "name", "path")


_VAD = _Rows(
    "orders",
    o_orderkey="o_orderkey",
    found="CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 13 > 0 END",
    readable="o_orderkey % 7 > 0",
    schema_version="o_orderkey % 5",
    source="o_orderstatus",
    wanted_source="CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_orderstatus END",
    parameters="o_orderpriority",
    wanted_parameters="CASE WHEN o_custkey % 4 = 0 THEN 'x' ELSE o_orderpriority END",
    structure="CASE WHEN o_custkey % 5 = 0 THEN 'overlap' END",
)


@query(f"""SELECT o_orderkey, {_first(
    ('NOT coalesce(found, false)', 'missing'), ('NOT readable', 'unreadable'), ('schema_version <> 1', 'schema_mismatch'), ('source IS DISTINCT FROM wanted_source', 'source_mismatch'),
    ('parameters <> wanted_parameters', 'parameters_mismatch'), ('structure IS NOT NULL', 'invalid_structure'))} AS reason FROM {_VAD.sql}""")  # fmt: skip
def vad_reasons(spark, sf_dir):
    return files.vad_status(_VAD.df(spark, sf_dir)).select("o_orderkey", "reason")


@query("""SELECT o.o_orderkey, o.o_orderstatus, o.o_orderpriority, c.plan FROM orders o
JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'F' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority, 'plan ' || o_custkey AS plan FROM orders) c USING (o_orderkey, o_orderstatus, o_orderpriority)""")
def matching_plans(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    cached = orders.select("o_orderkey", F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 'F' ELSE o_orderstatus END").alias("o_orderstatus"), "o_orderpriority", F.concat(F.lit("plan "), F.col("o_custkey").cast("string")).alias("plan"))
    return files.matching_plan(orders, cached, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query("SELECT doc_id, source, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def optional_metadata(spark, sf_dir):
    return files.with_optional(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id", {"quality": -1, "toxic": 0})


@query("SELECT event_id, CASE WHEN event_id % 4 > 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def lenient_json(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 > 0, F.col("props")).otherwise(F.lit("{broken")).alias("props"))
    return files.lenient_objects(rows, "props", "k bigint").select("event_id", "object.k")


@query("""SELECT conv_id, turn, CASE WHEN trim(t) = '' THEN 'empty_text' WHEN n = 0 THEN 'no_items' END AS violation
FROM (SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN ' ' ELSE text END AS t, (conv_id + turn) % 3 AS n FROM conversations)""")
def workspace_row_violations(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 5 == 0, " ").otherwise(F.col("text")).alias("text"),
                                                        F.when((F.col("conv_id") + F.col("turn")) % 3 > 0, F.array("role")).otherwise(F.array().cast("array<string>")).alias("items"))
    return files.workspace_rows(rows).select("conv_id", "turn", "violation")


_BLOCK = """CASE turn % 7 WHEN 0 THEN '{i}' || {nl} || '{a} --> {b}' || {nl} || said || {nl} || ' and  more ' WHEN 1 THEN '{a} --> {b}' || {nl} || said WHEN 2 THEN '{i}' || {nl} || '{a} -> {b}' || {nl} || said
  WHEN 3 THEN '{i}' || {nl} || '{a} --> {a}' || {nl} || said WHEN 4 THEN '{i}' || {nl} || '{a} --> {b}' || {nl} || ' ' WHEN 5 THEN '{i}' || {nl} || '0{a} --> {b}' || {nl} || said ELSE '{a}-->{b}' || {nl} || said END"""
_CUE = {"i": "' || TEXT(turn + 1) || '", "a": "00:00:' || lpad(TEXT(turn % 30), 2, '0') || ',250", "b": "00:01:' || lpad(TEXT(turn % 60), 2, '0') || ',500"}


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtitle files with a byte-order mark, CR LF, cues without index, bad times, no length or no text."""
    said = F.concat(F.col("role"), F.lit(" \t"), F.col("turn").cast("string"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("said"), F.when(F.col("conv_id") % 2 == 0, "\r\n").otherwise("\n").alias("nl"))
    block = F.expr(_spark(_BLOCK.format(nl="nl", **_CUE)))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda r: r["b"])
    gap = F.when(F.col("conv_id") % 2 == 0, "\r\n\r\n").otherwise("\n\n\n")
    bom = F.when(F.col("conv_id") % 3 == 0, "﻿").otherwise("")
    return rows.groupBy("conv_id").agg(ordered.alias("blocks")).select("conv_id", F.concat(bom, F.concat_ws("", F.array_join(F.col("blocks"), "<gap>"))).alias("c"), gap.alias("gap")).select(
        "conv_id", F.expr("replace(c, '<gap>', gap)").alias("content"))


_GOOD = """good AS (
  SELECT conv_id, turn, 1000 * (turn % 30) + 250 AS start_ms, 60000 + 1000 * (turn % 60) + 500 AS end_ms, role || ' ' || turn || CASE WHEN turn % 7 = 0 THEN ' and more' ELSE '' END AS text
  FROM conversations WHERE turn % 7 IN (0, 1, 6))"""


@query(f"WITH {_GOOD} SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS id, start_ms, end_ms, text FROM good")
def srt_dirty(spark, sf_dir):
    return srt.parse(_dirty(spark, sf_dir), ["conv_id"])


@query(f"""WITH {_GOOD} SELECT conv_id, n AS cues, CASE WHEN n = 0 THEN '{srt.EMPTY}' END AS error
FROM (SELECT c.conv_id, count(g.turn) AS n FROM conversations c LEFT JOIN good g ON g.conv_id = c.conv_id AND g.turn = c.turn GROUP BY 1)""")
def srt_probes(spark, sf_dir):
    return srt.probe(_dirty(spark, sf_dir), ["conv_id"])


# --- stored payloads

_ISLANDS = f"""islands AS (
  SELECT user_id, min(s) AS s, max(e) AS e FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (
      SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM ({_SPANS}) WHERE e > s))
  GROUP BY user_id, island)"""


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.union(intervals.normalize(event_spans(spark, sf_dir)), ["user_id"], bucket=86_400_000_000)


@query(f"""WITH {_ISLANDS} SELECT user_id, CAST(to_json({{'schema_version': 1, 'source': {{'sample_count': 10000, 'sample_rate': 16000}}, 'parameters': {{'threshold': 5, 'limit': NULL::INT}},
  'speech_intervals': list({{'start_sample': s, 'end_sample': e}} ORDER BY s)}}) AS VARCHAR) AS payload FROM islands GROUP BY user_id""")
def interval_payloads(spark, sf_dir):
    source = F.struct(F.lit(10_000).alias("sample_count"), F.lit(16_000).alias("sample_rate"))
    parameters = F.struct(F.lit(5).alias("threshold"), F.lit(None).cast("int").alias("limit"))
    return results.interval_payloads(_merged(spark, sf_dir), ["user_id"], source, parameters)


_CHUNK_TEXT = "l_returnflag || l_linestatus || '\"' || chr(10)"


@query(f"""SELECT l_orderkey, l_linenumber, CAST(to_json({{'schema_version': 1, 'plan': {{'key': l_orderkey, 'longest': 180}}, 'text': {_CHUNK_TEXT}, 'language': CASE WHEN l_linenumber = 1 THEN NULL ELSE 'en' END, 'items': l_linenumber}}) AS VARCHAR) AS payload
FROM lineitem""")
def chunk_payloads(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_CHUNK_TEXT).alias("text"), F.expr("CASE WHEN l_linenumber = 1 THEN NULL ELSE 'en' END").alias("language"), F.col("l_linenumber").alias("items"))
    plan = F.struct(F.col("l_orderkey").alias("key"), F.lit(180).alias("longest"))
    return results.chunk_payloads(rows, ["l_orderkey", "l_linenumber"], plan, ["text", "language", "items"])


@query("""SELECT conv_id, CAST(to_json({'schema_version': 1, 'plan': {'key': conv_id}, 'text': string_agg(role, '' ORDER BY turn), 'words': flatten(list([{'text': role, 'start': turn}, {'text': 'x', 'start': -turn}] ORDER BY turn))}) AS VARCHAR) AS payload
FROM conversations GROUP BY conv_id""")
def merged_payloads(spark, sf_dir):
    word = lambda x, at: F.struct(x.alias("text"), at.alias("start"))
    words = F.array(word(F.col("role"), F.col("turn")), word(F.lit("x"), -F.col("turn")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", words.alias("words"))
    return results.merged_payloads(rows, ["conv_id"], F.struct(F.col("conv_id").alias("key")), "turn", "role", "words")


@query("""SELECT 'languages' AS artifact, count(DISTINCT lang) AS rows, true AS valid FROM documents UNION ALL SELECT 'labels', count(*), true FROM labels
UNION ALL SELECT 'rebuilt', count(DISTINCT source), true FROM documents""")
def published_artifacts(spark, sf_dir):
    """Three artifacts and their manifest; one is damaged and rebuilt from its recomputation."""
    folder = scratch(spark, "published")
    docs = table(spark, sf_dir, "documents")
    by_source = docs.groupBy("source").agg(F.min("doc_id").alias("first_id"))
    incremental.publish({"languages": docs.select("lang").distinct(), "labels": table(spark, sf_dir, "labels"), "rebuilt": by_source}, folder)
    by_source.limit(1).write.mode("overwrite").parquet(f"{folder}/rebuilt")
    incremental.recover(spark, folder, "rebuilt", lambda: by_source)
    return incremental.verify(spark, folder).select("artifact", "rows", "valid")


@query("SELECT doc_id, CASE WHEN quality IS NOT NULL THEN 'first ' ELSE 'second ' END || source AS payload FROM documents LEFT JOIN labels USING (doc_id)")
def resumed_run(spark, sf_dir):
    """A run over the labelled documents, then one over all, which computes only what the first left."""
    store = scratch(spark, "results")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    work = lambda word: lambda rows: rows.select("doc_id", F.concat(F.lit(word), F.col("source")).alias("payload"), F.lit(None).cast("string").alias("error"))
    labelled = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    incremental.run_missing(labelled, store, ["doc_id"], work("first "))
    return incremental.run_missing(docs, store, ["doc_id"], work("second "))


# --- segments and words


@query("""SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS id, text
FROM (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 4 > 0 THEN role || ' ' || turn ELSE '' END AS text FROM conversations) WHERE text <> ''""")
def dense_segments(spark, sf_dir):
    said = F.when((F.col("conv_id") + F.col("turn")) % 4 > 0, F.concat(F.lit("　"), F.col("role"), F.lit(" \t"), F.col("turn").cast("string"))).otherwise(F.lit(" \n"))
    return segments.clean_segments(table(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("text")), ["conv_id"], ["turn"]).select("conv_id", "turn", "id", "text")


@query("""SELECT conv_id, CAST(turn AS INTEGER) AS segment_no, CAST(w AS INTEGER) AS word_no, turn * 1.0::DOUBLE + w AS start, role AS text
FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, unnest(range(0, turn % 3)) AS w FROM conversations)""")
def flat_words(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role")))
    word = lambda r, i: lambda w: F.struct((i.cast("double") + w).alias("start"), r["role"].alias("text"))
    nested = F.transform(ordered, lambda r, i: F.struct(F.transform(F.slice(F.array(F.lit(0), F.lit(1)), F.lit(1), (r["turn"] % 3).cast("int")), word(r, i)).alias("words")))
    return segments.flatten_words(turns.groupBy("conv_id").agg(nested.alias("segments")))


@query(f"""SELECT conv_id, turn, start, CASE WHEN last AND start <= 8 AND t1 > 8 AND t1 - 8 <= 4 THEN 8.0 ELSE t1 END AS clipped, least(start, 8.0) AS clamped
FROM (SELECT *, lead(1) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL AS last FROM {_WORDS.sql})""")
def clipped_words(spark, sf_dir):
    rows = segments.clip_last(_WORDS.df(spark, sf_dir).withColumnRenamed("t1", "end"), ["conv_id"], "turn", F.lit(8.0), tolerance=4.0)
    kept = rows.withColumnRenamed("end", "clipped").withColumn("at", F.col("start")).withColumn("end", F.col("clipped"))
    return segments.clamp_to(kept, F.lit(8.0)).select("conv_id", "turn", F.col("at").alias("start"), "clipped", F.col("start").alias("clamped"))


@query(f"SELECT conv_id, turn, coalesce(text, '') AS text, round(start, 3) AS start FROM (SELECT conv_id, turn, nullif(text, '') AS text, start / 3 AS start, nullif(t1, turn * 2.0) AS t1 FROM {_WORDS.sql}) WHERE t1 IS NOT NULL")
def usable_words(spark, sf_dir):
    rows = _WORDS.df(spark, sf_dir).select("conv_id", "turn", F.expr("nullif(text, '')").alias("text"), (F.col("start") / 3).alias("start"), F.expr("nullif(t1, turn * 2.0e0)").alias("end"))
    return segments.valid_words(rows).select("conv_id", "turn", "text", "start")


@query(f"""WITH t AS (SELECT conv_id, turn, regexp_replace(text, '\\s+', ' ', 'g') AS x FROM conversations),
w AS (SELECT conv_id, turn, list_filter(regexp_extract_all(x, '[^，,；;。.!！？?]*[，,；;。.!！？?]+|[^，,；;。.!！？?]+$'), lambda p: trim(p) <> '') AS c FROM t),
s AS (SELECT conv_id, turn, i, trim(c[i]) AS said, list_sum(list_transform(c[1:i], lambda p: len(regexp_extract_all(p, '[\\p{{L}}\\p{{N}}]+')))) AS upto, len(regexp_extract_all(c[i], '[\\p{{L}}\\p{{N}}]+')) AS n
  FROM (SELECT conv_id, turn, c, unnest(range(1, len(c) + 1)) AS i FROM w))
SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS id, CAST(upto - n AS DOUBLE) AS start, upto - 0.5::DOUBLE AS "end", said AS text FROM s""")
def token_sentences(spark, sf_dir):
    """Sentences with the times of their tokens, one second each; tokens are runs of letters and digits."""
    clean = F.regexp_replace("text", r"\s+", " ")
    tokens = F.regexp_extract_all(clean, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    items = F.transform(tokens, lambda x, i: F.struct(x.alias("text"), i.cast("double").alias("start"), (i + F.lit(0.5)).alias("end")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", segments.align_sentences(clean, items).alias("a"))
    return rows.select("conv_id", "turn", F.inline("a.segments")).select("conv_id", "turn", "id", "start", "end", "text")


@query("SELECT vec_id, CAST(len(x) AS INTEGER) AS n, CAST(x[1] AS DOUBLE) AS first FROM (SELECT vec_id, embedding[vec_id % 60 + 1:least(len(embedding), vec_id % 60 + 8)] AS x FROM embeddings)")
def sample_slice(spark, sf_dir):
    cut = projections.bounded_slice("embedding", F.col("vec_id") % 60, F.col("vec_id") % 60 + 8)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(cut).alias("n"), F.try_element_at(cut, F.lit(1)).cast("double").alias("first"))


# --- projections and jobs


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def nested_and_flat(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return projections.flat(projections.nested(rows, "plan", ["c_acctbal", "c_mktsegment"]), "plan")


@query("""SELECT o_orderkey, 'failed' AS status, CAST(NULL AS VARCHAR) AS prompt, stage, CASE WHEN message IN ('1-URGENT', '2-HIGH') THEN message WHEN stage = 'fetch' THEN 'Resource preparation failed.' ELSE 'Summary preparation failed.' END AS message
FROM (SELECT o_orderkey, o_orderpriority AS message, CASE WHEN o_orderstatus = 'F' THEN 'fetch' ELSE 'prompt' END AS stage FROM orders)""")
def failed_jobs(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), "o_orderpriority", F.lit("p.md").alias("prompt"))
    stage = F.when(F.col("status") == "F", "fetch").otherwise("prompt")
    out = projections.failed_job(rows, stage, F.lit("ValueError"), F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"])
    return out.select("o_orderkey", "status", "prompt", "error.stage", "error.message")


@query("SELECT o_orderkey, o_orderstatus AS a, o_orderpriority AS b FROM orders")
def zipped_results(spark, sf_dir):
    both = projections.zip_exact(F.array("o_orderstatus"), F.array("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.inline(both))


@query("SELECT page_id, '# ' || url || chr(10) || 'by ' || page_id || chr(10) || chr(10) || html AS prompt FROM pages")
def summary_prompts(spark, sf_dir):
    template = F.lit("# {{url}}\nby {{id}}")
    return table(spark, sf_dir, "pages").select("page_id", projections.metadata_prompt(template, F.col("html"), {"url": F.col("url"), "id": F.col("page_id")}).alias("prompt"))


@query("SELECT doc_id, source, quality, toxic FROM documents JOIN labels USING (doc_id)")
def complete_results(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    plan = table(spark, sf_dir, "documents").select("doc_id", "source").join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    return incremental.complete(plan, labels, ["doc_id"])


@query("""SELECT o_orderkey, sha256(o_orderpriority) AS audio_id, CASE WHEN o_orderstatus = 'O' AND m.n IS NOT NULL THEN 'prompt_ready' WHEN o_orderstatus = 'O' THEN 'needs_transcription' ELSE 'complete' END AS status
FROM orders LEFT JOIN (SELECT '1-URGENT' AS n UNION ALL SELECT '5-LOW') m ON m.n = o_orderpriority""")
def continued_jobs(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "needs_transcription").otherwise("complete")
    waiting = table(spark, sf_dir, "orders").select("o_orderkey", F.sha2("o_orderpriority", 256).alias("audio_id"), status.alias("status"))
    done = spark.createDataFrame([("1-URGENT",), ("5-LOW",)], "n string").select(F.sha2("n", 256).alias("audio_id"), F.concat(F.lit("/"), F.col("n")).alias("manifest_path"))
    return jobs.continue_summaries(waiting, done).select("o_orderkey", "audio_id", "status")


@query("SELECT sha256(html) AS job_id, min(url) AS audio_path, 'needs_transcription' AS status FROM pages GROUP BY 1")
def created_subtitle_jobs(spark, sf_dir):
    return jobs.create_subtitle_jobs(table(spark, sf_dir, "pages").select(F.col("html").alias("content"), F.col("url").alias("path")))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P'))")
def startable_jobs(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return incremental.not_finished(orders.select("o_orderkey"), orders.select("o_orderkey", F.col("o_orderstatus").alias("status")), "o_orderkey", ["F", "P"])


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN 'failed' WHEN o_custkey % 3 = 0 THEN 'prompt_ready' WHEN o_custkey % 2 = 0 THEN 'needs_transcription' ELSE 'failed' END AS status FROM orders""")
def chosen_sources(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("bvid", F.col("o_orderkey").cast("string"))
    path = F.lit("x").alias("path")
    made = orders.select("o_orderkey", "bvid", F.when(F.col("o_orderstatus") == "O", "preparing").otherwise("failed").alias("status"))
    return jobs.choose_source(made, orders.where("o_custkey % 3 = 0").select("bvid", path), orders.where("o_custkey % 2 = 0").select("bvid", path)).select("o_orderkey", "status")


# --- intervals and loads


@query("""WITH r AS (SELECT l_orderkey, l_suppkey % 60 AS s, l_suppkey % 60 + l_linenumber % 4 AS e FROM lineitem),
m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM r)
SELECT l_orderkey, min(s) AS s, max(e) AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM m) GROUP BY l_orderkey, i""")
def closed_ranges(spark, sf_dir):
    s = F.col("l_suppkey") % 60
    return intervals.union(table(spark, sf_dir, "lineitem").select("l_orderkey", s.alias("s"), (s + F.col("l_linenumber") % 4).alias("e")), ["l_orderkey"], gap=1)


_FROM, _TO = 1_700_000_000_000_000, 1_710_000_000_000_000


@query(f"""WITH {_ISLANDS}, g AS (SELECT user_id, coalesce(lag(e) OVER (PARTITION BY user_id ORDER BY s), {_FROM}) AS s, s AS e FROM islands
  UNION ALL SELECT user_id, max(e), {_TO} FROM islands GROUP BY user_id) SELECT user_id, s, e FROM g WHERE e > s""")
def complement_with_ends(spark, sf_dir):
    return intervals.gaps(_merged(spark, sf_dir), ["user_id"], lo=_FROM, hi=_TO)


@query(f"WITH {_ISLANDS} SELECT user_id, {_TO} - e AS s, {_TO} - s AS e FROM islands")
def mirrored(spark, sf_dir):
    return intervals.mirror(_merged(spark, sf_dir), _TO)


@query(f"""WITH {_ISLANDS}, pre AS (SELECT *, coalesce(sum(e - s) OVER (PARTITION BY user_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM islands),
p AS (SELECT event_id, user_id, event_id % 97 * 600000000 - 600000000 AS amount FROM events WHERE event_type = 'signup')
SELECT event_id, amount, CASE WHEN amount >= 0 THEN coalesce(found, {_TO}) END AS coordinate
FROM (SELECT p.event_id, p.amount, CAST(min(i.s + p.amount - i.b) FILTER (i.b <= p.amount AND p.amount < i.b + i.e - i.s) AS BIGINT) AS found FROM p LEFT JOIN pre i ON i.user_id = p.user_id GROUP BY 1, 2)""")
def latest_coordinates(spark, sf_dir):
    points = event_spans(spark, sf_dir).where("event_type = 'signup'").select("event_id", "user_id", (F.col("event_id") % 97 * 600_000_000 - 600_000_000).alias("amount"))
    return intervals.latest_coordinate_at(points, _merged(spark, sf_dir), ["user_id"], _TO, bucket=86_400_000_000).select("event_id", "amount", "coordinate")


@query("SELECT l_orderkey, l_returnflag, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL")
def smallest_labels(spark, sf_dir):
    return ranking.smallest_per(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_returnflag"], "l_suppkey")


@query("SELECT l_orderkey, string_agg(CAST(q AS VARCHAR), ',' ORDER BY l_linenumber, q) AS elapsed FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q FROM lineitem) GROUP BY 1")
def elapsed_in_chunk_order(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("q"))
    out = metrics.elapsed_in_order(rows, ["l_orderkey"], "l_linenumber", "q")
    return out.select("l_orderkey", F.array_join(F.col("elapsed").cast("array<string>"), ",").alias("elapsed"))


_SMALL_N, _SMALL_LONGEST = "6 + c_custkey % 6", 5


@query(f"""WITH RECURSIVE r AS (SELECT c_custkey, CAST({_SMALL_N} AS BIGINT) AS n FROM customer),
v AS (SELECT c_custkey, n, o_orderkey % n AS s, least(n, o_orderkey % n + 1 + o_orderkey // 16 % 3) AS e FROM r JOIN orders ON o_custkey = c_custkey),
cell AS (SELECT DISTINCT c_custkey, unnest(range(s, e)) AS x FROM v),
inner_cut AS (SELECT DISTINCT c_custkey, unnest(range(s + 1, e)) AS x FROM v),
merged_cut AS (SELECT a.c_custkey, a.x FROM cell a JOIN cell b ON a.c_custkey = b.c_custkey AND b.x = a.x - 1),
path AS (
  SELECT n, [0]::BIGINT[] AS b FROM (SELECT DISTINCT n FROM r)
  UNION ALL SELECT n, list_append(b, b[-1] + step) FROM path, (SELECT unnest(range(2, {_SMALL_LONGEST + 1})) AS step) WHERE b[-1] + step <= n),
full_path AS (SELECT n, b, len(b) - 1 AS k FROM path WHERE b[-1] = n),
piece AS (SELECT c_custkey, r.n, p.b, k, unnest(range(1, k + 1)) AS i FROM r JOIN full_path p USING (n) WHERE c_custkey IN (SELECT c_custkey FROM v)),
pl AS (
  SELECT p.c_custkey, p.n, p.b, p.k, p.i, p.b[i] AS s, p.b[i + 1] AS e, (SELECT count(*) FROM cell c WHERE c.c_custkey = p.c_custkey AND c.x >= p.b[i] AND c.x < p.b[i + 1]) AS load,
    p.i < p.k AND EXISTS (SELECT 1 FROM merged_cut c WHERE c.c_custkey = p.c_custkey AND c.x = p.b[i + 1]) AS cut,
    p.i < p.k AND EXISTS (SELECT 1 FROM inner_cut c WHERE c.c_custkey = p.c_custkey AND c.x = p.b[i + 1]) AS hard FROM piece p),
whole AS (
  SELECT c_custkey, n, b, k, sum(cut::INT) AS cuts, sum(hard::INT) AS hards, max(load) AS top, sum(load * load) AS squares, sum(load) AS total FROM pl GROUP BY c_custkey, n, b, k),
per_k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey, k ORDER BY cuts, top, squares, b) AS q FROM whole) WHERE q = 1),
stop AS (SELECT c_custkey, min(k) AS k FROM per_k WHERE hards = 0 GROUP BY 1),
best AS (SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY p.c_custkey ORDER BY hards, p.k, top, CASE WHEN total = 0 THEN 0 ELSE (p.k * squares - total * total) / (total * total) END, b) AS w
  FROM per_k p LEFT JOIN stop s USING (c_custkey) WHERE s.k IS NULL OR p.k <= s.k) WHERE w = 1)
SELECT l.c_custkey, CAST(l.i - 1 AS INTEGER) AS idx, l.s, l.e, CASE WHEN l.e = l.n THEN 'audio_end' WHEN l.hard THEN 'hard' ELSE 'silence' END AS boundary, l.load AS speech
FROM pl l JOIN best USING (c_custkey, b)""")
def plan_small(spark, sf_dir):
    """Each customer's recording of 6 to 11 units, with orders as intervals; the SQL tries every split."""
    n = F.expr(_SMALL_N).cast("bigint")
    customers = table(spark, sf_dir, "customer").select("c_custkey", n.alias("n"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey").join(customers, "c_custkey")
    s = F.col("o_orderkey") % F.col("n")
    rows = orders.select("c_custkey", "n", s.alias("s"), F.least(F.col("n"), s + 1 + F.floor(F.col("o_orderkey") / 16) % 3).alias("e"))
    return planner.plan_recordings(rows, ["c_custkey"], "n", shortest=2, longest=_SMALL_LONGEST, group=1).drop("error")


# --- text, addresses and times


@query(r"""WITH d AS (SELECT doc_id, source, CASE doc_id % 8 WHEN 0 THEN 'ai-zh' WHEN 1 THEN 'ZH-Hans' WHEN 2 THEN 'ai-en' WHEN 3 THEN '' WHEN 4 THEN 'yue' ELSE lang END AS code FROM documents),
t AS (SELECT *, CASE WHEN code = '' THEN 'en' WHEN starts_with(lower(code), 'ai-zh') OR starts_with(lower(code), 'zh') THEN 'zh' WHEN starts_with(lower(code), 'ai-en') OR starts_with(lower(code), 'en') THEN 'en' ELSE lower(code) END AS template FROM d)
SELECT doc_id, template, CASE WHEN template IN ('zh', 'de') THEN template ELSE 'en' END AS used, CASE code WHEN 'de' THEN 'German' WHEN 'en' THEN 'English' WHEN 'es' THEN 'Spanish' WHEN 'fr' THEN 'French' WHEN 'yue' THEN 'Cantonese' END AS model,
  'chunk_' || lpad(CAST(doc_id AS VARCHAR), CAST(greatest(3, len(CAST(doc_id AS VARCHAR))) AS INTEGER), '0') AS chunk, CASE WHEN code = '' THEN 'x' ELSE code || ',x' END AS listed, doc_id % 3 = 0 AS blocked, 'v' || doc_id AS tag FROM t""")
def text_rules(spark, sf_dir):
    code = F.expr("CASE doc_id % 8 WHEN 0 THEN 'ai-zh' WHEN 1 THEN 'ZH-Hans' WHEN 2 THEN 'ai-en' WHEN 3 THEN '' WHEN 4 THEN 'yue' ELSE lang END")
    said = F.when(F.col("doc_id") % 3 == 0, "x HTTP Error 412: y").otherwise("HTTP Error 404")
    return table(spark, sf_dir, "documents").withColumn("code", code).select(
        "doc_id", text.template_language("code").alias("template"), text.summary_template("code", ["zh", "de"]).alias("used"), text.model_language("code").alias("model"), text.chunk_key("doc_id").alias("chunk"),
        F.array_join(text.listed(F.concat(F.lit(" "), F.col("code"), F.lit(" , ,x"))), ",").alias("listed"), text.is_blocked_by_server(said).alias("blocked"),
        text.subtitle_language(F.concat(F.lit("a.v"), F.col("doc_id").cast("string"), F.lit(".srt"))).alias("tag"),
    )


@query(r"""SELECT conv_id, turn, regexp_matches(left(text, 1), '^[\s\p{P}]$') AS first_skippable, regexp_matches(right(text, 1), '^[\s\p{P}]$') AS last_skippable,
  trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')) AS joined FROM conversations""")
def skippable_characters(spark, sf_dir):
    lines = F.split("text", "\n")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.is_skippable(F.left("text", F.lit(1))).alias("first_skippable"), text.is_skippable(F.right("text", F.lit(1))).alias("last_skippable"), text.join_lines(lines).alias("joined"))


@query(f"""SELECT page_id, 'https://{urls.VIDEO_HOST}/video/BV' || page_id || '/' || CASE WHEN page_id % 4 = 1 THEN '?p=3' WHEN page_id % 4 = 2 THEN '?p=2' ELSE '' END AS source,
  CASE WHEN page_id % 4 = 3 THEN 'unknown-video' WHEN page_id % 4 = 0 THEN 'BV' || page_id ELSE 'BV' || page_id || '_p' || CASE WHEN page_id % 4 = 1 THEN '3' ELSE '2' END END AS name FROM pages""")
def source_addresses(spark, sf_dir):
    ident = F.concat(F.lit("BV"), F.col("page_id").cast("string"))
    kind = F.col("page_id") % 4
    info = F.when(kind == 1, F.concat(ident, F.lit("_p3"))).when(kind == 2, F.concat(ident, F.lit("_p2"))).otherwise(F.lit(""))
    url = F.when(kind == 0, F.concat(F.lit(f"https://{urls.VIDEO_HOST}/video/"), ident, F.lit("/")))
    name = urls.result_id(F.when(kind > 0, info), F.when(kind == 0, ident))
    return table(spark, sf_dir, "pages").select("page_id", urls.source_video_url(url, info, ident).alias("source"), name.alias("name"))


@query("""WITH e AS (SELECT event_id, CAST(round(value * 100) AS BIGINT) * (1 + event_id % 40) AS h FROM events)
SELECT event_id, CASE WHEN h >= 360000 THEN printf('%dh %dm %02d.%02ds', h // 360000, h // 6000 % 60, h % 6000 // 100, h % 100) WHEN h >= 6000 THEN printf('%dm %02d.%02ds', h // 6000, h % 6000 // 100, h % 100)
  ELSE printf('%d.%02ds', h // 100, h % 100) END AS elapsed, h * 160 AS samples, h / 100.0::DOUBLE AS seconds FROM e""")
def elapsed_and_samples(spark, sf_dir):
    h = F.round(F.col("value") * 100).cast("long") * (1 + F.col("event_id") % 40)
    rows = table(spark, sf_dir, "events").select("event_id", (h / 100).alias("x"), h.alias("h"))
    return rows.select("event_id", timecode.format_elapsed("x").alias("elapsed"), timecode.to_samples("x").alias("samples"), timecode.to_seconds(F.col("h") * 160).alias("seconds"))


@query(f"""WITH m AS (SELECT conv_id, turn, text, start, t1, CASE WHEN start >= 0 AND t1 >= 0 THEN CAST(round(start * 1000) AS BIGINT) END AS a, CASE WHEN start >= 0 AND t1 >= 0 THEN CAST(round(t1 * 1000) AS BIGINT) END AS b FROM {_WORDS.sql}),
l AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM m)
SELECT conv_id, turn, a AS start_ms, b AS end_ms, {_first(('start < 0 OR t1 < 0', 'time_not_finite'), ('t1 > 12', 'past_duration'), ('b <= a', 'empty_after_rounding'), ('a < p', 'overlap_after_rounding'), ("text = ''", 'empty_text'))} AS violation FROM l""")
def millisecond_violations(spark, sf_dir):
    rows = _WORDS.df(spark, sf_dir).withColumnRenamed("t1", "end")
    return srt.millis(rows, ["conv_id"], F.lit(12.0), order="turn").select("conv_id", "turn", "start_ms", "end_ms", "violation")

