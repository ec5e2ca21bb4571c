"""Toxicity by cumulative-link ordinal regression over sparse text features.

P(grade >= k) = sigmoid(w . x - threshold_k): the weights are shared by all
grades and the thresholds are ordered.  Features are the distinct words of a
text and their prefixes of 4, 5 and 6 bytes, hashed to ``BUCKETS``; only
buckets that are associated with toxic texts (G-test and lift) get a weight.  Labels say
toxic or not, so the grades of toxic texts are made here: a text of one
half of the sample has grade 1 to 3 by the number of its distinct words with a
feature that the other half associates with toxic texts.  They grade how much
there is of it and are no human judgement of severity.  The expected severity
is the mean grade.

Training takes at most ``per_class`` labelled documents of each class, chosen
by a hash of the id; scoring covers every whole text.

Defined cases: null and empty text have no features and get the model's base
severity; null labels are ignored; repeated label rows count as toxic if one
of them is; of rows that repeat a labelled id one text is learned; without
toxic labels every severity is 0; repeated documents each get their own result;
texts of any length are read whole; an empty table gives an empty result; other
columns pass or are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.llm.common import bounded_sample, field, filter_texts, map_text
from tempora.llm.decontaminate import words_of

BUCKETS = 1 << 20
PREFIXES = (4, 5, 6)
GRADES = 4
#: Distinct words with an associated feature from which a toxic text has grade 2, 3.
GRADE_STEPS = (2, 4)
#: A feature's G statistic must reach this.
MIN_G = 25.0
#: It must be so many times as frequent in toxic texts as in others; ordinary words get no weight.
MIN_LIFT = 20.0
#: Probability of grade 1 or more from which a text counts as toxic.
REJECT_FROM = 0.5
CACHE_WORDS = 300_000


def word_features(word: bytes) -> list[int]:
    """Buckets of a word and its prefixes."""
    parts = [b"w" + word, *(b"p%d" % n + word[:n] for n in PREFIXES if len(word) > n)]
    return [xxhash.xxh32_intdigest(p) & (BUCKETS - 1) for p in parts]


@dataclass
class OrdinalModel:
    """weights: bucket -> weight; thresholds: ordered, one for each grade from 1."""

    weights: dict[int, float]
    thresholds: np.ndarray

    def word_weight(self, word: bytes) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in word_features(word))

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 ..; (rows, grades - 1)."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -40, 40)))


NEUTRAL = OrdinalModel({}, np.array([40.0] * (GRADES - 1)))


def associated(rows: Sequence[np.ndarray], toxic: np.ndarray, least: float = MIN_G) -> np.ndarray:
    """Buckets that toxic texts have far more often than others; rows[i] is a text's distinct buckets."""
    if not toxic.any() or toxic.all():
        return np.zeros(0, np.int64)
    count = lambda pick: np.bincount(np.concatenate([rows[i] for i in np.flatnonzero(pick)]), minlength=BUCKETS).astype(float)
    with_feature, without = count(toxic), count(~toxic)
    share = toxic.mean()
    total = with_feature + without
    log = lambda a, b: np.where(a > 0, a * np.log(np.maximum(a, 1e-9) / np.maximum(b, 1e-9)), 0)
    g = 2 * (log(with_feature, total * share) + log(without, total * (1 - share)))
    return np.flatnonzero((g >= least) & (with_feature * (1 - share) >= MIN_LIFT * without * share))


def train(rows: Sequence[np.ndarray], toxic: np.ndarray, *, steps: int = 400, rate: float = 0.05, l2: float = 1e-3) -> OrdinalModel:
    """Fit the model; rows[i] is (words, up to 4) buckets, padded with -1."""
    toxic = np.asarray(toxic, bool)
    if not toxic.any() or toxic.all():
        return NEUTRAL
    distinct = [np.unique(r[r >= 0]) for r in rows]
    chosen = associated(distinct, toxic)
    column = np.full(BUCKETS, -1)
    column[chosen] = np.arange(len(chosen))
    words = np.zeros(len(rows), int)
    half = np.arange(len(rows)) % 2 == 0
    for graded in (half, ~half):  # by the features of the other half
        there = np.zeros(BUCKETS, bool)
        there[associated([distinct[i] for i in np.flatnonzero(~graded)], toxic[~graded], MIN_G / 2)] = True  # G grows with the rows
        for i in np.flatnonzero(graded & toxic):
            words[i] = (there[np.maximum(rows[i], 0)] & (rows[i] >= 0)).any(axis=1).sum() if len(rows[i]) else 0
    grade = np.where(toxic, 1 + sum((words >= s).astype(int) for s in GRADE_STEPS), 0)
    # A feature's value is the number of distinct words that have it.
    flat = [column[r[r >= 0]] for r in rows]
    flat = [f[f >= 0] for f in flat]
    owner = np.repeat(np.arange(len(rows)), [len(f) for f in flat])
    nonzero = np.concatenate(flat) if flat else np.zeros(0, int)
    w, cut, gaps = np.zeros(len(chosen)), 0.0, np.zeros(GRADES - 2)
    state = [np.zeros_like(w), 0.0, np.zeros_like(gaps)]
    moments = [np.zeros_like(w), 0.0, np.zeros_like(gaps)]
    target = (grade[:, None] >= np.arange(1, GRADES)[None, :]).astype(float)
    row_weight = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum())[:, None]
    for step in range(1, steps + 1):
        thresholds = cut + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        score = np.bincount(owner, w[nonzero], minlength=len(rows))
        p = 1 / (1 + np.exp(-np.clip(score[:, None] - thresholds, -40, 40)))
        error = (p - target) * row_weight
        per_row = error.sum(axis=1)
        d_threshold = -error.sum(axis=0)
        grads = [np.bincount(nonzero, per_row[owner], minlength=len(w)) + l2 * w, d_threshold.sum(), np.array([d_threshold[k + 1 :].sum() * np.exp(gaps[k]) for k in range(len(gaps))])]
        new = []
        for value, grad, k in zip((w, cut, gaps), grads, range(3), strict=True):
            moments[k] = 0.9 * moments[k] + 0.1 * grad
            state[k] = 0.999 * state[k] + 0.001 * grad * grad
            new.append(value - rate * (moments[k] / (1 - 0.9**step)) / (np.sqrt(state[k] / (1 - 0.999**step)) + 1e-9))
        w, cut, gaps = new
    thresholds = cut + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
    return OrdinalModel({int(b): float(v) for b, v in zip(chosen, w, strict=True)}, thresholds)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 3000) -> OrdinalModel:
    """Train on at most ``per_class`` labelled documents of each class, one text for each id."""
    label, ident, text = F.col(f"`{label_col}`"), F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    marked = labels.where(label.isNotNull() & ident.isNotNull()).groupBy(ident.alias("id")).agg(F.max((label > 0).cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return NEUTRAL
    marked = marked.withColumn("sample_key", F.xxhash64("id"))
    chosen = [bounded_sample(marked.where(F.col("toxic") == c), per_class, counts[c]) for c in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]).drop("sample_key"))  # at most 2 * per_class rows
    sample = docs.select(ident.alias("id"), text.alias("text")).where("text IS NOT NULL").join(chosen, "id")
    sample = sample.groupBy("id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # reduced before the shuffle
    width = 1 + len(PREFIXES)

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(2).to_pylist():
                words = sorted(set(words_of(text)))
                rows = np.full((len(words), width), -1, np.int32)
                for i, w in enumerate(words):
                    f = word_features(w)
                    rows[i, : len(f)] = f
                out.append(rows.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array(out, pa.binary())], names=["id", "toxic", "features"])

    got = sample.mapInArrow(run, "id string, toxic int, features binary").toArrow()
    rows = sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), got.column(2).to_pylist(), strict=True))
    return train([np.frombuffer(f, np.int32).reshape(-1, width) for _, _, f in rows], np.array([t for _, t, _ in rows], bool))


def _scorer(model: OrdinalModel):
    """A function from texts to scores; word weights are kept in a bounded cache."""
    cache: dict[bytes, float] = {}

    def run(texts):
        out = np.zeros(len(texts))
        for i, text in enumerate(texts):
            total = 0.0
            for w in set(words_of(text)):
                v = cache.get(w)
                if v is None:
                    v = model.word_weight(w)
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    cache[w] = v
                total += v
            out[i] = total
        return out

    return run


def score(docs: DataFrame, model: OrdinalModel, *, keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep`` and, for every whole text, severity (expected grade), grade (most likely), p_toxic and toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most BUCKETS weights

    def make():
        model = shared.value
        scores = _scorer(model)

        def run(texts):
            p = model.probabilities(scores(texts))
            edges = np.concatenate([np.ones((len(p), 1)), p, np.zeros((len(p), 1))], 1)
            grade = (edges[:, :-1] - edges[:, 1:]).argmax(axis=1)
            return [p.sum(axis=1).tolist(), grade.tolist(), p[:, 0].tolist(), (p[:, 0] >= REJECT_FROM).tolist()]

        return run

    fields = [field("severity", T.DoubleType()), field("grade", T.IntegerType()), field("p_toxic", T.DoubleType()), field("toxic", T.BooleanType())]
    return map_text(docs, text_col, make, fields, keep)


def drop_toxic(docs: DataFrame, model: OrdinalModel, *, text_col: str = "text") -> DataFrame:
    """The documents that are not toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        scores = _scorer(model)
        return lambda texts: (model.probabilities(scores(texts))[:, 0] < REJECT_FROM).tolist()

    return filter_texts(docs, text_col, make)
