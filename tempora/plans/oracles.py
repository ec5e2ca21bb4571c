"""DuckDB SQL with the same results as the queries of the same names."""

from __future__ import annotations

_SPANS = """spans AS (
  SELECT event_id, user_id, event_type, epoch_us(ts) AS s, epoch_us(ts) + CAST(round(value * 60000000) AS BIGINT) AS e FROM events)"""


def _islands(name: str = "islands", where: str = "e > s") -> str:
    return f"""{name} AS (
  SELECT user_id, min(s) AS s, max(e) AS e FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (
      SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh
      FROM spans WHERE {where}))
  GROUP BY user_id, island)"""


_BASE = f"WITH {_SPANS}, {_islands()}"
_PREFIX = """prefixed AS (
  SELECT *, CAST(coalesce(sum(e - s) OVER (PARTITION BY user_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM islands)"""
_WS = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]+"


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}', ' ', 'g'))"


def _clean(x: str) -> str:
    controls = f"regexp_replace({x}, '[\\x00-\\x1f\\x7f-\\x{{9f}}]+', ' ', 'g')"
    return _collapse(controls)


def _safe(x: str) -> str:
    return f"left({_clean(x)}, 1024)"


_CUT = "[^，,；;。.!！？?]*[，,；;。.!！？?]+|[^，,；;。.!！？?]+$"

_PARAGRAPHS = f"""RECURSIVE turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, turn * 10.0::DOUBLE AS s, turn * 10.0::DOUBLE + 4 + turn % 4 AS e, t AS text
  FROM (SELECT conv_id, turn, {_safe("text")} AS t FROM conversations) WHERE t <> ''),
fold AS (
  SELECT conv_id, i, 0 AS id, s AS ps, e AS pe, text AS pt FROM turns WHERE i = 1
  UNION ALL
  SELECT conv_id, i, CASE WHEN brk THEN id + 1 ELSE id END, CASE WHEN brk THEN s ELSE ps END, e,
    CASE WHEN brk THEN text ELSE pt || CASE WHEN regexp_matches(pt, '\\p{{P}}$') THEN '' ELSE ' ' END || text END
  FROM (SELECT t.*, f.id, f.ps, f.pt, (s - pe > 5 OR right(pt, 1) IN ('。', '！', '？', '.', '!', '?') OR length(pt) > 64) AS brk
    FROM fold f JOIN turns t ON t.conv_id = f.conv_id AND t.i = f.i + 1)),
paragraphs AS (SELECT conv_id, id, min(ps) AS start, max(pe) AS "end", max_by(pt, i) AS text FROM fold GROUP BY conv_id, id)"""


def _clock(x: str) -> str:
    return f"printf('%02d:%02d:%02d', CAST({x} AS BIGINT) // 3600, CAST({x} AS BIGINT) // 60 % 60, CAST({x} AS BIGINT) % 60)"


def _srt_time(x: str) -> str:
    return f"printf('%02d:%02d:%02d,%03d', {x} // 3600000, {x} // 60000 % 60, {x} // 1000 % 60, {x} % 1000)"


def _prose(x: str) -> str:
    for pattern, new in (
        (r"(?s)<!--.*?-->", ""),
        (r"(?s)```.*?(?:```|\z)", ""),
        (r"(?s)~~~.*?(?:~~~|\z)", ""),
        (r"`[^`\n]*`", ""),
        (r"\{\{[^}]+\}\}", ""),
        (r"\]\([^\n)]*\)", "]"),
        (r"https?://[^\s\p{Z}\x0b)>]+", ""),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    return x


_ZH = r"length(regexp_replace({x}, '[^\x{{3400}}-\x{{4dbf}}\x{{4e00}}-\x{{9fff}}\x{{f900}}-\x{{faff}}]', '', 'g'))"
_EN = "length(regexp_replace({x}, '[^A-Za-z]', '', 'g'))"
_CUES = f"""cues AS (
  SELECT conv_id, turn, CAST(round(CAST(turn * 5.0005::DOUBLE AS DECIMAL(18, 6)) * 1000) AS BIGINT) AS a,
    CAST(round(CAST(turn * 5.0005::DOUBLE + 4.25 AS DECIMAL(18, 6)) * 1000) AS BIGINT) AS b, {_collapse("text")} AS t,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n
  FROM conversations)"""
_PROGRESS = """progress AS (
  SELECT d.doc_id, d.source, CASE WHEN bool_or(l.quality = 1) THEN 'succeeded' WHEN bool_or(l.quality = 0) THEN 'failed' ELSE 'pending' END AS status
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.doc_id, d.source)"""
_RECORDINGS = """recordings AS (
  SELECT o_orderkey, n, CASE WHEN n <= 0 THEN NULL WHEN n < 3000 THEN 1 WHEN lo > hi THEN NULL ELSE lo END AS low,
    CASE WHEN n <= 0 THEN NULL WHEN n < 3000 THEN 1 WHEN lo > hi THEN NULL ELSE hi END AS high
  FROM (SELECT o_orderkey, n, (n + 17999) // 18000 AS lo, n // 3000 AS hi FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders)))"""

ORACLES: dict[str, str] = {
    "interval_union": f"{_BASE} SELECT user_id, s, e FROM islands",
    "interval_gaps": f"""{_BASE} SELECT user_id, p AS s, s AS e
FROM (SELECT user_id, s, lag(e) OVER (PARTITION BY user_id ORDER BY s) AS p FROM islands) WHERE s > p""",
    "interval_clip_measure": f"""{_BASE} SELECT user_id, day, CAST(sum(least(e, (day + 1) * 86400000000) - greatest(s, day * 86400000000)) AS BIGINT) AS covered
FROM (SELECT *, unnest(range(s // 86400000000, (e - 1) // 86400000000 + 1)) AS day FROM islands) GROUP BY user_id, day""",
    "interval_intersect_pairs": f"""WITH {_SPANS}, {_islands("a", "e > s AND event_type = 'view'")}, {_islands("b", "e > s AND event_type = 'click'")}
SELECT a.user_id, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e FROM a JOIN b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.e""",
    "speech_at_coordinate": f"""{_BASE} SELECT p.event_id, p.user_id, p.s AS x, CAST(coalesce(sum(greatest(0, least(i.e, p.s) - i.s)), 0) AS BIGINT) AS covered
FROM spans p LEFT JOIN islands i ON i.user_id = p.user_id WHERE p.event_type = 'error' GROUP BY ALL""",
    "coordinate_at_measure": f"""{_BASE}, {_PREFIX}, p AS (SELECT event_id, user_id, event_id * 60000000 AS amount FROM events WHERE event_type = 'signup')
SELECT p.event_id, p.user_id, p.amount, CASE WHEN amount <= 0 THEN 0 ELSE coalesce(i.s + amount - i.before, -1) END AS coordinate
FROM p LEFT JOIN prefixed i ON i.user_id = p.user_id AND i.before < amount AND amount <= i.before + i.e - i.s""",
    "hard_boundary_flag": f"""{_BASE} SELECT p.event_id, p.user_id, p.s AS x, EXISTS (SELECT 1 FROM islands i WHERE i.user_id = p.user_id AND i.s < p.s AND p.s < i.e) AS hard
FROM spans p WHERE p.event_type = 'purchase'""",
    "first_n_seconds": f"""{_BASE}, {_PREFIX} SELECT user_id, s, s + least(e - s, 36000000000 - before) AS e FROM prefixed WHERE before < 36000000000""",
    "gap_sessions": f"""WITH {_SPANS}, n AS (
  SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY user_id ORDER BY s, e) > 3600000000 THEN 1 ELSE 0 END AS fresh FROM spans)
SELECT user_id, session, count(*) AS n, min(s) AS s, max(e) AS e
FROM (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM n) GROUP BY user_id, session""",
    "sentence_segments": f"""SELECT conv_id, turn, CAST(unnest(range(len(c))) AS INTEGER) AS id, unnest(c) AS sentence
FROM (SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(text, '{_CUT}'), lambda x: {_collapse("x")}), lambda x: x <> '') AS c FROM conversations)""",
    "paragraph_merge": f"""WITH {_PARAGRAPHS} SELECT conv_id, id, start, "end", text FROM paragraphs""",
    "markdown_render": f"""WITH {_PARAGRAPHS} SELECT conv_id, '## metadata' || chr(10) || chr(10) || 'title: Conversation ' || conv_id || chr(10) || 'source: conversations' || chr(10) || chr(10) ||
  '## transcript text' || chr(10) || chr(10) || string_agg('[' || {_clock("start")} || ' - ' || {_clock('"end"')} || '] ' || text, chr(10) ORDER BY id) || chr(10) AS content
FROM paragraphs GROUP BY conv_id""",
    "segment_contract_violations": """WITH r AS (
  SELECT conv_id, turn AS id, turn * 10.0::DOUBLE AS s, turn * 10.0::DOUBLE + length(text) % 13 AS e, text FROM conversations),
w AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY id) - 1 AS rn, lag(e, 1, 0) OVER (PARTITION BY conv_id ORDER BY id) AS p FROM r)
SELECT conv_id, id, CASE WHEN id IS NULL OR id <> rn THEN 'id_not_continuous' WHEN coalesce(trim(text), '') = '' THEN 'empty_text' WHEN s < p THEN 'starts_before_previous_end'
  WHEN e <= s THEN 'not_positive_length' WHEN e > 60 THEN 'past_duration' END AS violation FROM w""",
    "layout_contract_violations": """WITH l AS (
  SELECT l_orderkey, l_linenumber, CAST(trunc(max(l_quantity)) AS BIGINT) AS q, max(l_returnflag) AS f, max(l_discount) AS d FROM lineitem GROUP BY 1, 2),
c AS (
  SELECT l_orderkey, l_linenumber - 1 AS idx, (CAST(l_linenumber AS BIGINT) - 1) * 50 AS s, (CAST(l_linenumber AS BIGINT) - 1) * 50 + CASE WHEN q >= 5 THEN 50 ELSE q END AS e,
    CASE f WHEN 'A' THEN 'silence' WHEN 'N' THEN 'hard' ELSE 'audio_end' END AS boundary, CAST(round(d * 100) AS BIGINT) AS speech, count(*) OVER (PARTITION BY l_orderkey) * 50 AS length
  FROM l),
w AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY idx) - 1 AS rn, lag(e, 1, 0) OVER (PARTITION BY l_orderkey ORDER BY idx) AS p,
    lead(1) OVER (PARTITION BY l_orderkey ORDER BY idx) IS NULL AS final FROM c)
SELECT l_orderkey, idx, CASE WHEN idx <> rn THEN 'index_not_continuous' WHEN s <> p THEN 'not_contiguous' WHEN e - s <= 0 OR e - s > 50 THEN 'length_out_of_bounds'
  WHEN length >= 2 AND e - s < 2 THEN 'length_out_of_bounds' WHEN speech < 0 OR speech > e - s THEN 'speech_out_of_bounds'
  WHEN (boundary = 'audio_end') <> final THEN 'audio_end_not_last' WHEN final AND e <> length THEN 'does_not_reach_end' END AS violation FROM w""",
    "srt_render": f"""WITH {_CUES} SELECT conv_id, chr(65279) || string_agg(n || chr(10) || {_srt_time("a")} || ' --> ' || {_srt_time("b")} || chr(10) || t, chr(10) || chr(10) ORDER BY turn) || chr(10) AS content
FROM cues GROUP BY conv_id""",
    "srt_roundtrip": f"""WITH {_CUES} SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS id, a AS start_ms, b AS end_ms, t AS text FROM cues WHERE t <> '' AND a <> b""",
    "timecode_format": f"""WITH r AS (SELECT event_id, event_id * 7919000 + 37 AS ms, CAST(round(value * 100) AS BIGINT) * 10 AS h FROM events)
SELECT event_id, {_srt_time("ms")} AS srt, {_clock("ms // 1000")} AS clock,
  CASE WHEN h < 6000 THEN printf('%d.%02ds', h // 100, h % 100) WHEN h < 360000 THEN printf('%dm %02d.%02ds', h // 6000 % 60, h % 6000 // 100, h % 100)
    ELSE printf('%dh %dm %02d.%02ds', h // 360000, h // 6000 % 60, h % 6000 // 100, h % 100) END AS duration
FROM r""",
    "whitespace_normalize": f"""SELECT doc_id, {_collapse("text")} AS normalized FROM documents""",
    "safe_line": f"""SELECT conv_id, turn, {_safe("text")} AS line FROM conversations""",
    "sanitize_filename": r"""SELECT p_partkey, CASE WHEN x = '' THEN 'untitled' ELSE left(x, 120) END AS name FROM (
  SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(trim(p_name || ' : ' || p_brand || ' : ' || p_type || ' : ? .. '), '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '\s+', ' ', 'g'), '[ .]+$', '') AS x FROM part)""",
    "strip_non_prose": f"""SELECT page_id, CAST(length(p) AS INTEGER) AS n_chars, sha256(p) AS sha256 FROM (SELECT page_id, {_prose("html")} AS p FROM pages)""",
    "language_ratio": f"""SELECT doc_id, CAST(zh AS INTEGER) AS chinese, CAST(en AS INTEGER) AS english, CASE WHEN zh + en = 0 THEN 0.0::DOUBLE ELSE en / (zh + en)::DOUBLE END AS ratio
FROM (SELECT doc_id, {_ZH.format(x="text")} AS zh, {_EN.format(x="text")} AS en FROM documents)""",
    "summary_validation": f"""WITH p AS (SELECT page_id, html, {_prose("html")} AS prose FROM pages),
c AS (SELECT *, {_ZH.format(x="prose")} AS zh, {_EN.format(x="prose")} AS en FROM p)
SELECT page_id, concat_ws('; ', CASE WHEN regexp_matches(html, '\\{{\\{{[^}}]+\\}}\\}}') THEN 'placeholder remains' END,
  CASE WHEN contains(html, '<!--') OR contains(html, '-->') THEN 'template comment remains' END) AS errors,
  CASE WHEN zh + en = 0 THEN true ELSE (CASE WHEN page_id % 2 = 0 THEN en ELSE zh END) / (zh + en)::DOUBLE < 0.8 END AS mismatch
FROM c""",
    "url_canonicalize": r"""WITH u AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS x FROM pages),
q AS (SELECT page_id, regexp_replace(x, '\?.*$', '') AS base, list_filter(string_split(regexp_extract(x, '\?(.*)$', 1), '&'), lambda p: string_split(p, '=')[1] = 'page') AS kept FROM u)
SELECT page_id, CASE WHEN len(kept) > 0 THEN base || '?' || array_to_string(kept, '&') ELSE base END AS canonical FROM q""",
    "video_identity": """SELECT page_id, 'http://m.site.test/video/BV' || page_id || 'x/' || CASE WHEN page_id % 5 > 0 THEN '?p=' || page_id % 5 ELSE '' END AS canonical,
  'BV' || page_id || 'x' || CASE WHEN page_id % 5 > 0 THEN '_p' || page_id % 5 ELSE '' END AS video_id FROM pages""",
    "content_identity": "SELECT doc_id, sha256(text) AS sha256, CAST(strlen(text) AS INTEGER) AS bytes FROM documents",
    "exact_duplicates": "SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "variant_identity": """SELECT o_orderkey, sha256('{"key":' || o_orderkey || ',"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}') AS variant_id FROM orders""",
    "pending_chunks": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "progress_status": f"WITH {_PROGRESS} SELECT doc_id, source, status, CASE WHEN status = 'failed' THEN 'low quality' END AS error FROM progress",
    "failure_summary": f"WITH {_PROGRESS} SELECT source, string_agg(x, '; ' ORDER BY x) AS errors, count(*) AS failures FROM (SELECT source, doc_id || ': low quality' AS x FROM progress WHERE status = 'failed') GROUP BY source",
    "correction_diff": f"SELECT doc_id, text <> {_collapse('text')} AS changed, CASE WHEN source = 'src3' AND lang <> 'xx' THEN 'lang_changed' END AS violation FROM documents",
    "preference_top1": """SELECT source, doc_id, lang, n_chars, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank, n_chars DESC, doc_id) AS rn
  FROM (SELECT source, doc_id, lang, n_chars, CASE lang WHEN 'fr' THEN 0 WHEN 'de' THEN 1 WHEN 'en' THEN 2 ELSE 3 END AS rank FROM documents)) WHERE rn = 1""",
    "load_metrics": """WITH l AS (SELECT l_orderkey, CAST(trunc(l_quantity) AS BIGINT) AS x, l_returnflag AS f FROM lineitem),
g AS (SELECT l_orderkey, count(*) AS chunks, CAST(sum(x) AS BIGINT) AS total, max(x) AS max_load, CAST(sum(x * x) AS BIGINT) AS squares, count(*) FILTER (f = 'R') AS hard_cuts FROM l GROUP BY 1)
SELECT *, CASE WHEN total = 0 THEN 0 ELSE chunks * squares - total * total END AS msre_numerator, CASE WHEN total = 0 THEN 1 ELSE total * total END AS msre_denominator FROM g""",
    "legal_chunk_counts": f"""WITH {_RECORDINGS} SELECT o_orderkey, low, high, CASE WHEN low IS NULL THEN NULL WHEN n < 3000 THEN '1'
  WHEN len(list_filter(range(low, high + 1), lambda c: c % 4 = 0)) = 0 THEN CAST(high AS VARCHAR) ELSE array_to_string(list_filter(range(low, high + 1), lambda c: c % 4 = 0), ',') END AS counts
FROM recordings""",
    "plan_balanced": f"""WITH {_RECORDINGS} SELECT o_orderkey, low AS k, array_to_string(list_transform(range(0, low + 1), lambda i: i * (n // low) + greatest(0, i - (low - n % low))), ',') AS boundaries
FROM recordings WHERE low IS NOT NULL""",
    "plan_earliest": f"""WITH {_RECORDINGS} SELECT o_orderkey, low AS k, array_to_string(list_transform(range(0, low + 1), lambda i: CASE WHEN i = 0 THEN 0 ELSE greatest(i * 3000, n - (low - i) * 18000) END), ',') AS boundaries
FROM recordings WHERE low IS NOT NULL""",
    "skyline_prune": """SELECT p_partkey, p_size, p_retailprice FROM part a WHERE NOT EXISTS (
  SELECT 1 FROM part b WHERE b.p_size <= a.p_size AND b.p_retailprice <= a.p_retailprice AND (b.p_size < a.p_size OR b.p_retailprice < a.p_retailprice))""",
    "batch_assignment": "SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 4 + 1 AS batch FROM documents",
    "status_rollup": """WITH c AS (
  SELECT user_id, CASE WHEN event_type <> 'error' THEN event_type END AS provider, event_type = 'error' AS core,
    (event_type <> 'error' AND value > 40) OR (event_type = 'error' AND value > 60) AS failed FROM events),
p AS (SELECT user_id, provider, bool_or(failed) AS failed, bool_or(failed AND core) AS core_failed FROM c GROUP BY 1, 2),
u AS (SELECT user_id, bool_or(core_failed) AS core_failed, count(*) FILTER (provider IS NOT NULL) AS providers, count(*) FILTER (provider IS NOT NULL AND NOT failed) AS ready FROM p GROUP BY 1)
SELECT *, CASE WHEN core_failed OR ready = 0 THEN 'not_ready' WHEN ready = providers THEN 'ready' ELSE 'degraded' END AS overall FROM u""",
    "state_transitions_valid": """WITH s AS (
  SELECT o_custkey, o_orderdate, o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'preparing' WHEN 'P' THEN 'prompt_ready' ELSE 'complete' END AS after FROM orders),
m AS (SELECT *, lag(after) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM s)
SELECT before, after, coalesce((before IS NULL AND after = 'preparing') OR (before = 'preparing' AND after = 'prompt_ready') OR (before = 'prompt_ready' AND after IN ('complete', 'prompt_ready'))
  OR (before = 'complete' AND after IN ('complete', 'prompt_ready')), false) AS legal, count(*) AS n FROM m GROUP BY ALL""",
    "json_props_strict": "SELECT event_id, replace(props, '\": ', '\":') AS object FROM events",
    "concatenated_text": f"SELECT conv_id, string_agg({_clean('text')}, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
    "compact_metadata": "SELECT page_id, 'id,url' AS keys, url FROM pages",
    "boundary_neighbours": """WITH r AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) % 100 AS x FROM orders)
SELECT DISTINCT o_orderkey, x FROM (SELECT o_orderkey, unnest([x - 1, x, x + 1]) AS x FROM r) WHERE x BETWEEN 0 AND 98""",
}
