"""DuckDB SQL for the queries that SQL can express."""

ORACLES: dict[str, str] = {}

_WORD = r"[^\x20\x09-\x0D]+"

ORACLES["op4_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
bw AS (
  SELECT DISTINCT item, m, array_to_string(w[i:i+m-1], ' ') AS win
  FROM (SELECT item, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT item, w, least(10, len(w)) AS m FROM b WHERE len(w) > 0))),
dw AS (
  SELECT doc_id, i, m, array_to_string(w[i:i+m-1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
hits AS (SELECT doc_id, i, dw.m, item FROM dw JOIN bw ON dw.m = bw.m AND dw.win = bw.win),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_LEDGER = r"""d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT rid, i, array_to_string(w[i:i+7], ' ') AS x
  FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT rid, x FROM win GROUP BY 1, 2 HAVING count(*) > 1),
rep AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT win.rid, unnest(range(i, i + 8)) AS p FROM win JOIN twice USING (rid, x)) GROUP BY 1),
ln AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
vary AS (
  SELECT rid, CAST(sum(len(list_distinct(w[k * 1000 + 1:k * 1000 + 1000]))) AS BIGINT) AS n_distinct_words
  FROM (SELECT rid, w, unnest(range(0, (len(w) + 999) // 1000)) AS k FROM d) GROUP BY 1),
m AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS n_letters, coalesce(n_distinct_words, 0) AS n_distinct_words
  FROM d LEFT JOIN ln USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN vary USING (rid)),
f AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END) AS r0, (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 1 ELSE 0 END) AS r1,
    (CASE WHEN word_chars < 2 * n_words THEN 1 ELSE 0 END) AS r2, (CASE WHEN word_chars > 20 * n_words THEN 1 ELSE 0 END) AS r3,
    (CASE WHEN 10 * n_symbols > n_words THEN 1 ELSE 0 END) AS r4, (CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 1 ELSE 0 END) AS r5,
    (CASE WHEN 100 * n_letters < 50 * word_chars THEN 1 ELSE 0 END) AS r6, (CASE WHEN 100 * n_distinct_words < 10 * n_words THEN 1 ELSE 0 END) AS r7
  FROM m),
l AS (
  SELECT *, CAST(r0 + 2 * r1 + 4 * r2 + 8 * r3 + 16 * r4 + 32 * r5 + 64 * r6 + 128 * r7 AS BIGINT) AS failed_rules FROM f)"""

ORACLES["op9_quality_rules"] = f"""
WITH {_LEDGER}
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, failed_rules,
  r0 + r1 > 0 AS base_failed, NOT (r0 + r1 > 0 OR r0 + r1 + r2 + r3 + r4 + r5 + r6 + r7 >= 3) AS kept
FROM l
"""

ORACLES["rule_policies"] = f"""
WITH {_LEDGER}
SELECT doc_id, failed_rules, failed_rules & 3 = 0 AS kept_v1_base, failed_rules & 3 = 0 AND bit_count(failed_rules) < 3 AS kept_v2_lenient, failed_rules = 0 AS kept_v3_strict FROM l
"""

# p: version, mask of its rules, mask of those that reject alone, failures that reject.
ORACLES["rule_ablations"] = f"""
WITH {_LEDGER},
p AS (SELECT unnest(['v1-base', 'v2-lenient', 'v3-strict']) AS policy, unnest([3, 255, 255]) AS counted, unnest([3, 3, 3]) AS fatal, unnest([1, 3, 1]) AS upto),
r AS (
  SELECT unnest(['too_few_words', 'repeated_windows', 'short_words', 'long_words', 'many_symbols', 'duplicate_lines', 'few_letters', 'little_variety']) AS rule, unnest(range(0, 8)) AS place),
c AS (SELECT policy, rule, counted, fatal, upto, CAST(1 << place AS BIGINT) AS bit FROM p JOIN r ON (counted >> place) & 1 = 1),
t AS (SELECT failed_rules AS b, count(*) AS n FROM l GROUP BY 1),
x AS (
  SELECT policy, rule, n, b & counted AS failed, bit_count(b & counted) >= upto OR b & fatal <> 0 AS gone,
    bit_count(b & counted & ~bit) >= upto OR b & fatal & ~bit <> 0 AS gone_without FROM c LEFT JOIN t ON true)
SELECT policy, rule, CAST(coalesce(sum(n) FILTER (NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (NOT gone_without), 0) AS BIGINT) AS kept_without_rule,
  CAST(coalesce(bit_or(failed) FILTER (gone), 0) AS BIGINT) AS or_bits, CAST(coalesce(bit_and(failed) FILTER (gone), 0) AS BIGINT) AS and_bits
FROM x GROUP BY policy, rule
"""

# Base 32 of a digest: eight groups of 40 bits, each as eight characters of five bits.
ORACLES["op6_warc"] = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, url, strlen(t) AS n, sha1(t) AS x FROM p),
b AS (
  SELECT page_id, url, n, x, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    (CAST('0x' || substr(x, 1 + 10 * (i // 8), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS INTEGER), 1)), '') AS digest
  FROM h),
g AS (SELECT x, min(page_id) AS first_id FROM h GROUP BY 1),
u AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_replace(coalesce(url, ''), '[\x00-\x20\x7f]+', '%20', 'g')), '#.*$', ''), '^[a-z][a-z0-9+.\-]*://', '') AS bare FROM b),
k AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_extract(bare, '^([^/?]*)', 1), '^.*@', ''), ':(80|443)$', ''), '^www\.', '') AS host FROM u)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to,
  array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || regexp_replace(bare, '^[^/?]*', '') AS url_key,
  strftime(make_timestamp(1577836800000000 + 1000000 * (page_id % 1000000000)), '%Y%m%d%H%M%S') AS captured_at
FROM k JOIN g USING (x)
"""

ORACLES["op8_suffix_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT rid, i, md5(b[i + 1:i + 400]) AS h FROM (SELECT rid, b, unnest(range(0, n - 399)) AS i FROM d WHERE n >= 400)),
r AS (SELECT rid, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
m AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM r),
s AS (SELECT rid, min(i) AS a, max(i) + 400 AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS run FROM m) GROUP BY rid, run),
p AS (
  SELECT rid, a AS place, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY a), 0) AS f, a AS t FROM s
  UNION ALL SELECT rid, n, e, n FROM (SELECT rid, max(e) AS e FROM s GROUP BY rid) JOIN d USING (rid)),
k AS (SELECT rid, list_reduce(list(b[f + 1:t] ORDER BY place), lambda x, y: x || y) AS kept FROM p JOIN d USING (rid) GROUP BY rid),
c AS (SELECT rid, CAST(sum(e - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM s GROUP BY rid),
dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS x FROM documents),
ww AS (SELECT doc_id, i, md5(array_to_string(x[i:i + 50], ' ')) AS h FROM (SELECT doc_id, x, unnest(range(1, len(x) - 49)) AS i FROM dw WHERE len(x) > 50)),
rw AS (SELECT DISTINCT doc_id, i FROM ww WHERE h IN (SELECT h FROM ww GROUP BY h HAVING count(DISTINCT doc_id) > 1)),
cw AS (
  SELECT doc_id, CAST(sum(CASE WHEN i - p <= 50 THEN i - p ELSE 51 END) AS BIGINT) AS n_passage_words, count(*) FILTER (p IS NULL OR i - p > 50) AS n_passages
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM rw) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(kept, b)) AS kept_sha256,
  coalesce(n_passage_words, 0) AS n_passage_words, coalesce(n_passages, 0) AS n_passages
FROM d LEFT JOIN c USING (rid) LEFT JOIN k USING (rid) LEFT JOIN cw USING (doc_id)
"""


def _matches(kind: str, pattern: str) -> str:
    """Leftmost matches of a pattern with their places: the text between matches tells where they are."""
    return f"""SELECT rid, '{kind}' AS kind, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a, m[i] AS x
  FROM (SELECT rid, m, string_split_regex(t, '{pattern}') AS p, unnest(range(1, len(m) + 1)) AS i FROM (SELECT rid, t, regexp_extract_all(t, '{pattern}') AS m FROM d) WHERE len(m) > 0)"""


def _personal_data() -> str:
    digits = "regexp_replace(x, '[^0-9]', '', 'g')"
    value = "CAST(substr({d}, len({d}) - i, 1) AS INTEGER)".format(d=digits)
    luhn = f"list_sum(list_transform(range(0, len({digits})), lambda i: CASE WHEN i % 2 = 0 THEN {value} WHEN {value} > 4 THEN 2 * {value} - 9 ELSE 2 * {value} END)) % 10 = 0"
    letters = "string_split(substr(replace(x, ' ', ''), 5) || substr(replace(x, ' ', ''), 1, 4), '')"
    number = "CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END"
    mod97 = f"list_reduce(list_transform({letters}, lambda c: {number}), lambda r, v: CASE WHEN v > 9 THEN (r * 100 + v) % 97 ELSE (r * 10 + v) % 97 END) = 1"
    near = "substr(t, greatest(0, a - 40) + 1, a - greatest(0, a - 40)) || ' ' || substr(t, a + length(x) + 1, 40)"
    phone_words = r"(?i)\b(?:phone|tel|call|mobile|fax|telephone|telefon|movil)\b"
    raw = " UNION ALL ".join(
        _matches(kind, pattern)
        for kind, pattern in (
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
            ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"),
            ("card", r"[0-9](?:[\x20-]?[0-9])+"),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
            ("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b"),
            ("ssn", r"[0-9-]+"),
            ("local_phone", r"[0-9().\x20-]+"),
        )
    )
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
raw AS ({raw}),
cut AS (
  SELECT rid, kind, CASE WHEN kind = 'local_phone' THEN a + length(x) - length(ltrim(x, ').- ')) ELSE a END AS a,
    CASE WHEN kind = 'local_phone' THEN rtrim(ltrim(x, ').- '), '(). -') ELSE x END AS x FROM raw WHERE kind <> 'local_phone' OR length(x) >= 12),
checked AS (
  SELECT rid, kind, a, a + length(x) AS e, x, list_position(['email', 'ip', 'card', 'phone', 'iban', 'ssn', 'local_phone'], kind) AS k, t FROM cut JOIN d USING (rid)
  WHERE CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(nullif(ltrim(p, '0'), '') AS INTEGER), 0) > 255)) = 0
    WHEN 'card' THEN len({digits}) BETWEEN 12 AND 19 AND {luhn}
    WHEN 'phone' THEN len({digits}) BETWEEN 9 AND 15
    WHEN 'iban' THEN length(replace(x, ' ', '')) BETWEEN 15 AND 34 AND {mod97}
    WHEN 'ssn' THEN regexp_full_match(x, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}') AND x[1:3] NOT IN ('000', '666') AND x[1] <> '9' AND x[5:6] <> '00' AND x[8:] <> '0000' AND regexp_matches({near}, '(?i)\\b(?:ssn|social security|social insurance)\\b')
    ELSE regexp_full_match(x, '(?:\\([0-9]{{3}}\\)\\x20?|[0-9]{{3}}[-.\\x20])[0-9]{{3}}[-.\\x20][0-9]{{4}}') AND (a = 0 OR substr(t, CAST(a AS INTEGER), 1) <> '+') AND regexp_matches({near}, '{phone_words}') END),
base AS (SELECT * FROM checked WHERE k <= 4),
spans AS (
  SELECT * FROM base UNION ALL
  SELECT * FROM checked c WHERE k > 4 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = c.rid AND b.a < c.e AND b.e > c.a)),
g AS (
  SELECT rid, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
    string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, k) FILTER (k <= 4) AS listed, string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, k) AS spans
  FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(listed, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)"""


ORACLES["op7_personal_data"] = _personal_data()
