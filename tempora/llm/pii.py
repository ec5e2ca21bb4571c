"""Personal data: patterns propose spans, checksums confirm them, context words score them.

Base kinds (email, ip, card, phone) are fixed patterns, matched leftmost and
without overlaps for each kind; a match that fails its check is dropped.  The
other kinds (iban, ssn, local_phone) are proposed by looser patterns, confirmed
by mod-97 or range rules, and kept only if prior, checksum and nearby context
words together reach ``MIN_SCORE``.

Defined cases: null text counts as empty and gives no spans; offsets are code
points, end exclusive; equal starts are ordered by kind; texts of any length
are scanned whole, in time linear in their length; repeated rows each get
their own result; an empty table gives an empty result; other columns never
matter, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.llm.common import field, fresh, map_text

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "local_phone")
#: A span of an added kind stays from this score on.
MIN_SCORE = 0.6
#: Code points before and after a proposed span in which context words count.
CONTEXT_CHARS = 40
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.4, "phone": 0.7, "iban": 0.3, "ssn": 0.3, "local_phone": 0.2}
CHECKSUM_GAIN, CONTEXT_GAIN = 0.4, 0.4
_PHONE_WORDS = r"\b(?:phone|tel|call|mobile|fax|telephone|telefon|m[oóÓ]vil)\b"
CONTEXT = {
    "email": re.compile(r"\b(?:e-?mail|contact|mailto|write)\b", re.I | re.A),
    "ip": re.compile(r"\b(?:ip|address|host|server|addr)\b", re.I | re.A),
    "card": re.compile(r"\b(?:card|visa|mastercard|amex|credit|debit|payment)\b", re.I | re.A),
    "phone": re.compile(_PHONE_WORDS, re.I | re.A),
    "iban": re.compile(r"\b(?:iban|bank|account|konto|compte|cuenta|transfer)\b", re.I | re.A),
    "ssn": re.compile(r"\b(?:ssn|social security|social insurance)\b", re.I | re.A),
    "local_phone": re.compile(_PHONE_WORDS, re.I | re.A),
}

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# The look-behind only skips starts inside a run of digits, where no match is
# possible once the start of the run has failed; it keeps the scan linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", re.A)
# Whole runs of the characters are taken, and then must have the form.
_SSN_RUN = re.compile(r"[0-9-]+")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
# Other numbers may stand beside this one, but not joined to it by a hyphen, or by a point before it.
_LOCAL_PHONE = re.compile(r"(?<![0-9+])(?<![0-9][.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?!-?[0-9])")
_DIGIT = re.compile(r"[0-9]")
_SEPARATORS = str.maketrans("", "", " -().+")


def luhn(digits: str) -> bool:
    """Whether a string of digits passes the Luhn check."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an IBAN without blanks passes the mod-97 check."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: each at sign has one candidate, the run of local characters before it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            done = found.end()
        else:
            done = at + 1
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the base kinds in one text, in order of start, then kind."""
    out = [(s, e, "email") for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    out.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].translate(_SEPARATORS)
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(m[0].translate(_SEPARATORS)) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=_order)


def _order(span: tuple) -> tuple[int, int]:
    return span[0], KINDS.index(span[2])


def _valid_ssn(run: str) -> bool:
    return bool(_SSN.fullmatch(run)) and run[:3] not in ("000", "666") and run[0] != "9" and run[4:6] != "00" and run[7:] != "0000"


def score(text: str, start: int, end: int, kind: str, confirmed: bool) -> float:
    """Prior of the kind, raised by a passed checksum and by context words nearby; at most 1."""
    near = text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]
    return min(1.0, PRIOR[kind] + CHECKSUM_GAIN * confirmed + CONTEXT_GAIN * bool(CONTEXT[kind].search(near)))


def find_spans(text: str | None) -> list[tuple[int, int, str, float]]:
    """All spans (start, end, kind, score) of a text, in order of start, then kind.

    Base spans always stay; an added span stays from ``MIN_SCORE`` on and only
    where it overlaps no base span.
    """
    if not text:
        return []
    base = base_spans(text)
    out = [(s, e, k, score(text, s, e, k, k in ("card", "ip"))) for s, e, k in base]
    if _DIGIT.search(text):
        added = [(m.start(), m.end(), "iban", True) for m in _IBAN.finditer(text) if 15 <= len(m[0].replace(" ", "")) <= 34 and mod97(m[0].replace(" ", ""))]
        if "-" in text:
            added += [(m.start(), m.end(), "ssn", False) for m in _SSN_RUN.finditer(text) if m.end() - m.start() == 11 and _valid_ssn(m[0])]
        added += [(m.start(), m.end(), "local_phone", False) for m in _LOCAL_PHONE.finditer(text)]
        starts, reach = [s for s, _, _ in base], list(accumulate((e for _, e, _ in base), max))
        for s, e, kind, confirmed in added:
            value = score(text, s, e, kind, confirmed)
            if value >= MIN_SCORE and not _overlaps(starts, reach, s, e):
                out.append((s, e, kind, value))
    return sorted(out, key=_order)


def _overlaps(starts: Sequence[int], reach: Sequence[int], start: int, end: int) -> bool:
    """reach: the largest end of the spans up to each one."""
    i = bisect_left(starts, end)
    return i > 0 and reach[i - 1] > start


def redact(text: str | None, spans: Sequence[tuple]) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    if not text or not spans:
        return text
    out, at = [], 0
    for start, end, kind, *_ in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def listed(spans: Sequence[tuple]) -> str:
    return ",".join([f"{k}:{s}:{e}" for s, e, k, *_ in spans])


SPAN = T.StructType([field("start", T.IntegerType()), field("end", T.IntegerType()), field("kind", T.StringType()), field("score", T.DoubleType())])


def detect(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and ``spans``, an array of (start, end, kind, score)."""

    def make():
        def run(texts):
            return [[[dict(zip(("start", "end", "kind", "score"), s, strict=True)) for s in find_spans(t)] for t in texts]]

        return run

    return map_text(docs, text_col, make, [field("spans", T.ArrayType(SPAN))], [id_col])


def redact_documents(docs: DataFrame, *, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The documents with personal data in their texts replaced; lengths follow the new text."""

    def make():
        def run(texts):
            new = [redact(t, find_spans(t)) for t in texts]
            return [new, [None if t is None else len(t) for t in new]]

        return run

    length = fresh(docs, "__length")
    fields = [field(text_col, T.StringType()), field(length, T.LongType())]
    out = map_text(docs, text_col, make, fields, docs.columns)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.col(length).cast(docs.schema[length_col].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
