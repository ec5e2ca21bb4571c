"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on every document.
Expectation-maximisation estimates each labeller's vote distribution for good
and for bad documents and the share of good ones; it sees only the counts of
the distinct vote patterns, of which there are at most 3 to the number of
labellers.  The posterior of a pattern is the soft label of its documents, and
a hashed linear scorer over word shapes learns from those of a bounded sample.

One pass over the texts writes votes and hashed features; estimation, training
and scoring read only that small table.

Defined cases: null and empty text have no words, so only the length labeller
votes and only the empty-text feature is set; repeated rows each get their own
result; an empty table gives an empty result; texts of any length are read
whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.llm.common import bounded_sample, field, map_text, materialize

ABSTAIN, BAD, GOOD = 0, 1, 2
BUCKETS = 1 << 14
#: A document is kept from this probability on.
KEEP_FROM = 0.5
CACHE_WORDS = 200_000


def _vote(bad: bool, good: bool) -> int:
    return BAD if bad else GOOD if good else ABSTAIN


#: name -> vote on the statistics of one text; a ratio over no words abstains.
LABELLERS = {
    "length": lambda s: _vote(s["words"] < 1, s["words"] >= 50),
    "variety": lambda s: _vote(s["words"] >= 20 and s["distinct"] < 0.3, s["words"] >= 20 and s["distinct"] > 0.5 or s["words"] >= 2000 and s["distinct"] > 0.3),
    "repeated_word": lambda s: _vote(s["words"] >= 5 and s["same_as_last"] > 0.2, s["words"] >= 20 and s["same_as_last"] < 0.05),
    "symbols": lambda s: _vote(s["words"] >= 5 and s["symbols"] > 0.15, s["words"] >= 20 and s["symbols"] < 0.02),
    "one_byte_words": lambda s: _vote(s["words"] >= 5 and s["one_byte"] > 0.2, s["words"] >= 20 and s["one_byte"] < 0.1),
    "upper_case": lambda s: _vote(s["letters"] >= 20 and s["upper"] > 0.3, s["letters"] >= 50 and s["upper"] < 0.1),
    "letters": lambda s: _vote(s["chars"] >= 100 and s["letter_share"] < 0.85, s["chars"] >= 30 and s["letter_share"] > 0.9),
    "sentences": lambda s: _vote(s["words"] >= 50 and s["sentence_ends"] < 0.01, s["words"] >= 20 and 0.02 <= s["sentence_ends"] <= 0.3),
    "shouting": lambda s: _vote(s["words"] >= 5 and s["exclamations"] > 0.2, s["words"] >= 20 and s["exclamations"] < 0.02),
    "word_length": lambda s: _vote(s["words"] >= 10 and not 2.5 <= s["mean_word"] <= 11, s["words"] >= 20 and 3.5 <= s["mean_word"] <= 8),
    "duplicate_lines": lambda s: _vote(s["lines"] >= 4 and s["duplicate_lines"] > 0.3, s["lines"] >= 4 and s["duplicate_lines"] < 0.05),
}
N_VOTES = 3 ** len(LABELLERS)

_SPACES = bytes([9, 10, 11, 12, 13, 32])
_SYMBOLS = b"#*$%&|<>{}[]=~^_\\"
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]+")
_NOT_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())
_RUN = re.compile(r"(.)\1+")


def statistics(text: str | None, words: Sequence[bytes]) -> dict[str, float]:
    """What the labellers look at; shares are 0 where there is nothing to divide by."""
    raw = (text or "").encode()
    n = len(words)
    per_word = 1 / n if n else 0.0
    bare = raw.translate(None, _SPACES)
    chars = len(bare) if raw.isascii() else len(bare.decode())
    letter_bytes = bare.translate(None, _NOT_LETTERS)
    letters = len(letter_bytes) if raw.isascii() else len(letter_bytes.decode())
    upper = sum(map(len, _UPPER.findall(text))) if text else 0
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return {
        "words": n,
        "distinct": len(set(words)) * per_word,
        "same_as_last": sum(map(bytes.__eq__, words[1:], words)) * per_word if n > 1 else 0.0,
        "symbols": (len(raw) - len(raw.translate(None, _SYMBOLS))) * per_word,
        "one_byte": list(map(len, words)).count(1) * per_word,
        "chars": chars,
        "letters": letters,
        "letter_share": letters / chars if chars else 0.0,
        "upper": upper / letters if letters else 0.0,
        "sentence_ends": (raw.count(b".") + raw.count(b"?")) * per_word,
        "exclamations": raw.count(b"!") * per_word,
        "mean_word": chars * per_word,
        "lines": len(lines),
        "duplicate_lines": (len(lines) - len(set(lines))) / len(lines) if lines else 0.0,
    }


def pattern_of(stats: dict[str, float]) -> int:
    """The votes of all labellers as one number, three values each."""
    out = 0
    for vote in LABELLERS.values():
        out = 3 * out + vote(stats)
    return out


def votes_of(patterns: np.ndarray) -> np.ndarray:
    """(patterns, labellers) votes."""
    n = len(LABELLERS)
    return np.stack([(patterns // 3 ** (n - 1 - j)) % 3 for j in range(n)], 1) if len(patterns) else np.zeros((0, n), int)


@dataclass
class LabelModel:
    """objects[y, j]: chance that labeller j, if it votes, votes bad on a document of class y (0 bad, 1 good)."""

    good_share: float
    objects: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Chance that a document with these votes is good; an abstention tells nothing."""
        votes = votes_of(patterns)
        log = np.stack([
            (votes == BAD) @ np.log(self.objects[y]) + (votes == GOOD) @ np.log(1 - self.objects[y]) + np.log(share)
            for y, share in enumerate((1 - self.good_share, self.good_share))
        ])
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -60, 60)))

    def accuracies(self) -> dict[str, float]:
        """Estimated share of right votes among a labeller's votes."""
        right = (1 - self.good_share) * self.objects[0] + self.good_share * (1 - self.objects[1])
        return dict(zip(LABELLERS, right.tolist(), strict=True))


#: Before any data: how often a labeller objects to a bad and to a good document,
#: and the weight of that belief as a share of the votes it casts.
PRIOR_OBJECTS = (0.2, 0.002)
PRIOR_WEIGHT = 0.05


def estimate(patterns: np.ndarray, counts: np.ndarray, *, rounds: int = 100) -> LabelModel:
    """Expectation-maximisation (maximum a posteriori) from counts per vote pattern.

    It starts from documents without objection being good.  A labeller that
    objects to good documents more often than to bad ones is held to tell nothing.
    """
    votes = votes_of(patterns)
    counts = np.asarray(counts, float)
    p = np.where((votes == BAD).any(axis=1), 0.02, 0.98)
    prior = np.array(PRIOR_OBJECTS)[:, None]
    strength = PRIOR_WEIGHT * ((votes != ABSTAIN) * counts[:, None]).sum(axis=0)[None, :] + 1.0
    model = LabelModel(0.5, np.repeat(prior, len(LABELLERS), 1))
    for _ in range(rounds):
        mass = np.stack([(1 - p) * counts, p * counts])
        cast, bad = mass @ (votes != ABSTAIN), mass @ (votes == BAD)
        objects = np.clip((bad + prior * strength) / (cast + strength), 1e-4, 1 - 1e-4)
        objects[0] = np.maximum(objects[0], objects[1])
        share = float(np.clip((mass[1].sum() + 1) / (mass.sum() + 2), 1e-6, 1 - 1e-6))
        model = LabelModel(share, objects)
        new = model.posterior(patterns)
        if np.abs(new - p).max(initial=0) < 1e-7:
            break
        p = new
    return model


def _shape(word: str) -> bytes:
    """Upper, lower, digit and other characters of the whole word, with runs collapsed."""
    kinds = "".join(["X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word])
    return _RUN.sub(r"\1+", kinds).encode()


class Features:
    """Hashed counts of word shapes, pairs of shapes with repetition, and sizes."""

    def __init__(self) -> None:
        self.cache: dict[bytes, int] = {}

    @staticmethod
    def bucket(name: bytes) -> int:
        return xxhash.xxh32_intdigest(name) & (BUCKETS - 1)

    def _shape_bucket(self, word: bytes) -> int:
        found = self.cache.get(word)
        if found is None:
            found = self.bucket(b"s" + _shape(word.decode()))
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            self.cache[word] = found
        return found

    def of(self, words: Sequence[bytes], stats: dict[str, float]) -> dict[int, float]:
        """Bucket -> value; shares of words, and steps of the statistics."""
        if not words:
            return {self.bucket(b"empty"): 1.0}
        get, slow = self.cache.get, self._shape_bucket
        counts = Counter([get(w) or slow(w) for w in words])
        out = {b: n / len(words) for b, n in counts.items()}
        for name in ("distinct", "same_as_last", "duplicate_lines", "letter_share", "upper"):
            out[self.bucket(b"%s:%d" % (name.encode(), int(stats[name] * 8)))] = 0.5
        out[self.bucket(b"size:%d" % len(words).bit_length())] = 0.5
        return out


def votes_and_features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, sample_key (a hash of id and text), pattern, buckets, shares."""
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    docs = docs.select(ident.alias("id"), F.xxhash64(ident, text).alias("sample_key"), text.alias("text"))

    def make():
        features = Features()

        def run(texts):
            patterns, buckets, shares = [], [], []
            for text in texts:
                words = text.encode().split() if text else []
                stats = statistics(text, words)
                patterns.append(pattern_of(stats))
                found = features.of(words, stats)
                buckets.append(list(found))
                shares.append(list(found.values()))
            return [patterns, buckets, shares]

        return run

    fields = [field("pattern", T.IntegerType()), field("buckets", T.ArrayType(T.ShortType())), field("shares", T.ArrayType(T.FloatType()))]
    return map_text(docs, "text", make, fields, ["id", "sample_key"])


def train_scorer(buckets: Sequence[np.ndarray], shares: Sequence[np.ndarray], target: np.ndarray, *, rounds: int = 300, rate: float = 0.1, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels; weights by bucket, and the bias."""
    w, bias = np.zeros(BUCKETS), 0.0
    if not len(buckets):
        return w, bias
    owner = np.repeat(np.arange(len(buckets)), [len(b) for b in buckets])
    column, value = np.concatenate(buckets).astype(int), np.concatenate(shares).astype(float)
    m, v, mb, vb = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    for step in range(1, rounds + 1):
        z = np.bincount(owner, w[column] * value, minlength=len(buckets)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) / len(buckets)
        g, gb = np.bincount(column, error[owner] * value, minlength=BUCKETS) + l2 * w, error.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix_m, fix_v = 1 - 0.9**step, 1 - 0.999**step
        w -= rate * (m / fix_m) / (np.sqrt(v / fix_v) + 1e-9)
        bias -= rate * (mb / fix_m) / (np.sqrt(vb / fix_v) + 1e-9)
    return w, bias


def classify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 20_000) -> DataFrame:
    """One row per document: id, pattern, posterior (of the votes), score (of the linear scorer), keep.

    The scorer learns from at most ``sample_rows`` different documents chosen by
    a hash of id and text; votes are counted, and scores given, for all.
    """
    spark = docs.sparkSession
    rows = materialize(votes_and_features(docs, id_col=id_col, text_col=text_col), "votes")
    found = rows.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").collect()  # at most N_VOTES rows
    patterns, counts = np.array([r["pattern"] for r in found], int), np.array([r["n"] for r in found])
    model = estimate(patterns, counts)
    posterior = dict(zip(patterns.tolist(), model.posterior(patterns).tolist(), strict=True))
    sample = bounded_sample(rows.drop("id"), sample_rows, int(counts.sum())).select("pattern", "buckets", "shares").toArrow()
    order = sample.column(0).to_numpy()
    lists = [sample.column(k).combine_chunks() for k in (1, 2)]
    buckets, shares = ([x.values.to_numpy()[a:b] for a, b in zip(x.offsets.to_numpy()[:-1], x.offsets.to_numpy()[1:], strict=True)] if len(x) else [] for x in lists)
    weights, bias = train_scorer(buckets, shares, np.array([posterior[p] for p in order.tolist()]))
    shared = spark.sparkContext.broadcast((weights, bias, posterior))  # at most BUCKETS and N_VOTES numbers

    @F.pandas_udf(T.StructType([field("posterior", T.DoubleType()), field("score", T.DoubleType())]))
    def judge(pattern, buckets, shares):
        import pandas as pd

        weights, bias, posterior = shared.value
        z = np.array([weights[b] @ s for b, s in zip(buckets, shares, strict=True)], float) + bias
        return pd.DataFrame({"posterior": pattern.map(posterior).astype(float), "score": 1 / (1 + np.exp(-np.clip(z, -40, 40)))})

    out = rows.withColumn("__j", judge("pattern", "buckets", "shares"))
    return out.select(F.col("id").alias(id_col), "pattern", "__j.posterior", "__j.score", (F.col("__j.score") >= KEEP_FROM).alias("keep"))
