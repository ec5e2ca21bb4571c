"""Text functions as columns: all run inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SENTENCE_PUNCTUATION = "，,；;。.!！？?"
STRONG_ENDINGS = "。！？.!?"
LANGUAGE_THRESHOLD = 0.8
CHINESE = r"[㐀-䶿一-鿿豈-﫿]"
RESERVED_NAMES = ["CON", "PRN", "AUX", "NUL", *[f"COM{i}" for i in range(1, 10)], *[f"LPT{i}" for i in range(1, 10)]]
MODEL_LANGUAGES = {
    "de": "German", "en": "English", "es": "Spanish", "fr": "French", "it": "Italian", "ja": "Japanese",
    "ko": "Korean", "pt": "Portuguese", "ru": "Russian", "yue": "Cantonese", "zh": "Chinese",
}
# What is no prose, in the order of removal with what takes its place, and what a finished summary may not hold.
PLACEHOLDER = r"\{\{[^}]+\}\}"
NON_PROSE = (
    (r"(?s)<!--.*?-->", ""),
    (r"(?s)```.*?(?:```|\z)", ""),
    (r"(?s)~~~.*?(?:~~~|\z)", ""),
    (r"`[^`\n]*`", ""),
    (PLACEHOLDER, ""),
    (r"\]\([^\n)]*\)", "]"),
    (r"(?U)https?://[^\s)>]+", ""),
)
COMMENT_MARKS = ("<!--", "-->")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def replace(c: Column | str, pattern: str, new: str) -> Column:
    return F.regexp_replace(col(c), F.lit(pattern), F.lit(new))


def collapse_whitespace(c: Column | str) -> Column:
    """Runs of Unicode white space become one blank; none stays at the ends."""
    return F.trim(replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def join_lines(lines: Column) -> Column:
    """Lines stripped, empty ones dropped, joined by blanks with white space collapsed."""
    return collapse_whitespace(F.array_join(lines, " "))


def clean_line(c: Column | str) -> Column:
    """Control characters become blanks and white space collapses."""
    return collapse_whitespace(replace(c, r"[\x00-\x1f\x7f-\x9f]+", " "))


def safe_line(c: Column | str, limit: int = 1024) -> Column:
    """A clean line, cut to ``limit``."""
    return F.left(clean_line(c), F.lit(limit))


def sanitize_filename(c: Column | str, limit: int = 120) -> Column:
    """A name that is valid on common file systems; empty ones become ``untitled``."""
    strip = lambda x: replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    tail = lambda x: replace(x, r"[ .]+$", "")
    x = replace(strip(c), r'[<>:"/\\|?*\x00-\x1f]', "_")
    x = tail(replace(x, r"(?U)\s+", " "))
    x = F.when(x == "", "untitled").otherwise(x)
    x = F.when(F.upper(x).isin(RESERVED_NAMES), F.concat(F.lit("_"), x)).otherwise(x)
    x = F.when(F.length(x) > limit, tail(F.left(x, F.lit(limit)))).otherwise(x)
    return F.when(x == "", "untitled").otherwise(x)


def is_skippable(c: Column | str) -> Column:
    """Whether a character is white space or punctuation."""
    return col(c).rlike(r"(?U)^[\s\p{P}]$")


def ends_with_punctuation(c: Column | str) -> Column:
    return col(c).rlike(r"\p{P}\z")


def ends_strongly(c: Column | str) -> Column:
    return F.right(col(c), F.lit(1)).isin(list(STRONG_ENDINGS))


def strip_non_prose(c: Column | str) -> Column:
    """Without comments, code fences, inline code, placeholders, link targets and addresses, in that order."""
    x = col(c)
    for pattern, new in NON_PROSE:
        x = replace(x, pattern, new)
    return x


def chinese_count(c: Column | str) -> Column:
    return F.length(replace(c, CHINESE.replace("[", "[^", 1), ""))


def english_count(c: Column | str) -> Column:
    return F.length(replace(c, "[^A-Za-z]", ""))


def language_ratio(c: Column | str, language: Column | str) -> Column:
    """Share of the expected language's letters among Chinese and English ones; 0 if there are none."""
    zh, en = chinese_count(c), english_count(c)
    total = zh + en
    return F.when(total == 0, F.lit(0.0)).otherwise(F.when(col(language) == "zh", zh).otherwise(en) / F.greatest(total, F.lit(1)))


def expected_language(name: Column | str) -> Column:
    """zh or en from a name that ends in _summary_<language>.md, else null."""
    found = F.lower(F.regexp_extract(col(name), r"(?i)_summary_(zh|en)\.md$", 1))
    return F.when(found != "", found)


def summary_errors(c: Column | str) -> Column:
    x = col(c)
    found = F.array(
        F.when(x.rlike(PLACEHOLDER), F.lit("placeholder remains")),
        F.when(x.contains(COMMENT_MARKS[0]) | x.contains(COMMENT_MARKS[1]), F.lit("template comment remains")),
    )
    return F.array_compact(found)


def language_mismatch(c: Column | str, name: Column | str) -> Column:
    """Whether a summary's prose falls short of the language that its name announces; null without one."""
    wanted = expected_language(name)
    return F.when(wanted.isNotNull(), language_ratio(strip_non_prose(c), wanted) < LANGUAGE_THRESHOLD)


def subtitle_language(name: Column | str) -> Column:
    """The part before the last of a dotted name of at least three parts, else null."""
    parts = F.split(col(name), r"\.")
    return F.when(F.size(parts) >= 3, F.try_element_at(parts, F.lit(-2)))


def template_language(language: Column | str) -> Column:
    x = F.lower(col(language))
    return (
        F.when(F.coalesce(x, F.lit("")) == "", "en")
        .when(x.startswith("ai-zh") | x.startswith("zh"), "zh")
        .when(x.startswith("ai-en") | x.startswith("en"), "en")
        .otherwise(x)
    )


def summary_template(language: Column | str, available: list[str]) -> Column:
    """The template for a language, or that for English."""
    x = template_language(language)
    return F.when(x.isin(available), x).otherwise("en")


def model_language(code: Column | str) -> Column:
    """A model's name for a language code; null for an unknown code."""
    names = F.create_map(*[F.lit(x) for pair in MODEL_LANGUAGES.items() for x in pair])
    return F.try_element_at(names, col(code))


def listed(c: Column | str) -> Column:
    """The non-empty, trimmed parts of a comma-separated list."""
    return F.filter(F.transform(F.split(col(c), ","), lambda x: F.trim(x)), lambda x: x != "")


def chunk_key(index: Column | str) -> Column:
    return F.format_string("chunk_%03d", col(index))


def is_blocked_by_server(message: Column | str) -> Column:
    """Whether an error message tells of HTTP status 412."""
    x = col(message)
    return x.contains("HTTP Error 412") | x.contains("HTTP 412") | x.contains("Precondition Failed")
