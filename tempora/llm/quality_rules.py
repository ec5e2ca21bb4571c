"""Rule bitmask ledger: every rule is evaluated once, policies are applied to the stored bits.

The ledger holds the measurements of each text and one long with a failure bit
for each rule.  A policy is a version name, a mask of rules and the number of
failed rules from which a text is rejected; a bit outside the mask never
counts.  Ablations (what a policy would keep without one of its rules) come
from counts per distinct bit pattern, of which there are at most two to the
number of rules.  ``stored_ledger`` writes the ledger once; policies and
ablations read that small table, so texts are read once however many versions
are compared.

Defined cases: null text has no words and zero measurements; an empty or blank
text likewise; a text shorter than the window has no repeated words; repeated
rows each get their own result; texts of any length are measured whole, and by
the same rules; an empty table gives an empty ledger, and ablations of zeros;
where a policy rejects nothing, ``or_bits`` and ``and_bits`` are 0; other
columns never matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.llm.common import field, map_text, materialize

WINDOW = 8
#: Distinct words are counted in blocks of so many words, so that long texts are held to the same share.
VARIETY_BLOCK = 1000
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_chars_total", "n_distinct_words")

#: name -> the failing condition over the measurements, as SQL; the order gives the bits.
RULES = {
    "too_few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "100 * n_dup_lines > 30 * n_lines",
    "few_letters": "100 * n_letters < 50 * n_chars_total",
    "little_variety": "100 * n_distinct_words < 10 * n_words",
}
BASE_RULES = ("too_few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """Rejects a text that fails at least ``reject_from`` of ``rules``, or any of ``fatal``."""

    version: str
    rules: tuple[str, ...]
    fatal: tuple[str, ...] = ()
    reject_from: int = 1


POLICIES = (
    Policy("v1-base", BASE_RULES, BASE_RULES),
    Policy("v2-lenient", tuple(RULES), BASE_RULES, 3),
    Policy("v3-strict", tuple(RULES), BASE_RULES, 1),
)
PRODUCTION = POLICIES[1]

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_LETTER = regex.compile(r"\p{L}")
_SPACES = bytes([9, 10, 11, 12, 13, 32])


def repeated_words(words: Sequence[bytes], window: int = WINDOW) -> tuple[int, int]:
    """Words that lie in a window of ``window`` words found twice or more, and distinct words.

    Windows are compared by a hash of their word numbers; those whose hash is
    not unique are compared word by word.
    """
    number: dict[bytes, int] = {}
    ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, len(words))
    n = len(ids) - window + 1
    if n < 2 or len(number) == len(words):
        return 0, len(number)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25)
    mixed ^= mixed >> np.uint64(29)
    key = mixed[:n] * _MULTIPLIERS[0]
    for k in range(1, window):
        key += mixed[k : k + n] * _MULTIPLIERS[k % 8] + np.uint64(k // 8)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0, len(number)
    suspect = np.zeros(n, bool)
    suspect[order[1:][same]] = suspect[order[:-1][same]] = True
    starts = np.flatnonzero(suspect)
    found = Counter(ids[s : s + window].tobytes() for s in starts)
    edge = np.zeros(len(ids) + 1, np.int64)
    for s in starts:
        if found[ids[s : s + window].tobytes()] > 1:
            edge[s] += 1
            edge[s + window] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum()), len(number)


def measure(text: str | None) -> tuple[int, ...]:
    """The values of ``MEASURES`` for one text."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode()
    words = raw.split()
    bare = raw.translate(None, _SPACES)
    chars = len(bare) if raw.isascii() else len(bare.decode())
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeated, distinct = repeated_words(words)
    if len(words) > VARIETY_BLOCK:
        distinct = sum(len(set(words[i : i + VARIETY_BLOCK])) for i in range(0, len(words), VARIETY_BLOCK))
    letters = len(raw.translate(None, _NOT_LETTERS)) if raw.isascii() else len(_LETTER.findall(text))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), letters, chars, distinct


_NOT_LETTERS = bytes(b for b in range(256) if not chr(b).isalpha() or b > 127)


def measures(docs: DataFrame, *, keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep`` and the columns of ``MEASURES`` for every whole text."""

    def make():
        def run(texts):
            rows = [measure(t) for t in texts]
            return list(zip(*rows, strict=True)) if rows else [[] for _ in MEASURES]

        return run

    return map_text(docs, text_col, make, [field(m, T.LongType()) for m in MEASURES], keep)


def ledger(docs: DataFrame, *, keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The measurements and ``failed_rules``, a long with bit i set where rule i of ``RULES`` fails."""
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measures(docs, keep=keep, text_col=text_col).withColumn("failed_rules", total.cast("long"))


def stored_ledger(docs: DataFrame, *, keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The ledger written to the shared folder and read back: later policies cost a scan of it and none of the texts."""
    return materialize(ledger(docs, keep=keep, text_col=text_col), "ledger")


def mask(rules: Sequence[str]) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def rejects(policy: Policy, bits: Column | str = "failed_rules", without: Sequence[str] = ()) -> Column:
    """Whether a policy, less the rules in ``without``, rejects a bit pattern."""
    bits = F.col(bits) if isinstance(bits, str) else bits
    counted = mask([r for r in policy.rules if r not in without])
    fatal = mask([r for r in policy.fatal if r not in without])
    return (F.bit_count(bits.bitwiseAND(F.lit(counted))) >= policy.reject_from) | (bits.bitwiseAND(F.lit(fatal)) != 0)


def apply_policies(rows: DataFrame, policies: Sequence[Policy] = POLICIES) -> DataFrame:
    """A boolean column ``kept_<version>`` for each policy, from the ledger's bits alone."""
    return rows.withColumns({f"kept_{p.version}": ~rejects(p) for p in policies})


def ablations(rows: DataFrame, policies: Sequence[Policy] = POLICIES) -> DataFrame:
    """For each policy and rule: texts that the policy keeps, and that it would keep without the rule.

    Counts per distinct bit pattern come first (summed map-side); the policies
    see only those.  ``or_bits`` and ``and_bits`` are the policy's rules that
    any and every rejected text fails.
    """
    zero = F.lit(0).cast("long")
    patterns = rows.groupBy(F.col("failed_rules").alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    cases = [(p, rule) for p in policies for rule in p.rules]
    one = lambda p, rule: F.struct(
        F.lit(p.version).alias("policy"), F.lit(rule).alias("rule"),
        rejects(p, "bits").alias("rejected"), rejects(p, "bits", without=(rule,)).alias("rejected_without"),
        F.col("bits").bitwiseAND(F.lit(mask(p.rules)).cast("long")).alias("failed"),
    )
    found = patterns.select("n", F.inline(F.array(*[one(p, rule) for p, rule in cases])))
    sums = found.groupBy("policy", "rule").agg(
        F.sum(F.when(F.col("rejected"), zero).otherwise(F.col("n"))).alias("kept"),
        F.sum(F.when(F.col("rejected_without"), zero).otherwise(F.col("n"))).alias("kept_without_rule"),
        F.bit_or(F.when(F.col("rejected"), F.col("failed"))).alias("or_bits"),
        F.bit_and(F.when(F.col("rejected"), F.col("failed"))).alias("and_bits"),
    )
    listed = rows.sparkSession.createDataFrame([(p.version, rule) for p, rule in cases], "policy string, rule string")
    out = F.broadcast(listed).join(sums, ["policy", "rule"], "left")
    return out.select("policy", "rule", *[F.coalesce(c, zero).alias(c) for c in ("kept", "kept_without_rule", "or_bits", "and_bits")])
