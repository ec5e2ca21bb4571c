"""Language identification by a byte convolutional network, trained here in numpy.

The text is lower-cased and its UTF-8 bytes become symbols of a small alphabet;
fixed-length windows pass filters of widths 2, 3 and 4, a max pool over the
window and a softmax layer.  A filter's response is a sum over its symbols, so
for prediction the filters are folded into two tables indexed by symbol pairs.
Every window of every text is scored; a text's log-probabilities are the mean
over its windows, weighted by the letters in them.

The network learns from a bounded sample: at most ``per_language`` documents of
each language chosen by a hash of id and text, and at most
``windows_per_text`` windows from each, spread over the whole text.  All
languages are learned; the network and its sample grow with their number.

Defined cases: null text and text without letters (Unicode category L) give
``und`` with score 0; null labels are never learned; without any labelled row
all is ``und``; one learned language is always predicted; rows that repeat id
and text are learned once and each get their own result; texts of any length
are predicted from all their windows; an empty table gives an empty result;
other columns never matter.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.llm.common import field, map_text

WINDOW = 128
FILTERS = 16
WIDTHS = (2, 3, 4)
UNDETERMINED = "und"
#: A small sample is gone through more often, up to so many steps.
LEAST_STEPS = 250
#: Windows scored at once; their responses stay within the processor's cache.
BATCH_WINDOWS = 96
#: Texts are scored together up to so many windows times languages; a longer text alone.
BATCH_SCORES = 1 << 23
_HASH_RANGE = 1 << 30

_LETTER = regex.compile(r"\p{L}")


def _alphabet() -> np.ndarray:
    """Byte -> symbol: 0 pad, 1 blank and punctuation, 2 digit, 3.. letters, then one for each byte beyond ASCII but lead and trail pairs folded to 64."""
    out = np.ones(256, np.uint8)
    out[48:58] = 2
    out[97:123] = np.arange(3, 29)
    out[128:192] = 29 + np.arange(64)
    out[192:256] = 93 + np.arange(64) % 32
    return out


SYMBOL_OF = _alphabet()
SYMBOLS = 125


def windows_of(text: str) -> np.ndarray:
    """The symbols of a whole text as rows of ``WINDOW``, the last one padded."""
    symbols = SYMBOL_OF[np.frombuffer(text.lower().encode(), np.uint8)]
    n = -(-len(symbols) // WINDOW)
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(symbols)] = symbols
    return out.reshape(n, WINDOW)


@dataclass
class ByteConvNet:
    """filters[w] is (w, SYMBOLS, FILTERS); bias (all filters); out (all filters, languages)."""

    languages: list[str]
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Responses of the first pair of symbols, and of the pair two places on."""
        f2, f3, f4 = (self.filters[w] for w in WIDTHS)
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(SYMBOLS * SYMBOLS, -1)
        zero = np.zeros_like(f3[2])
        first = np.concatenate([pair(f2[0], f2[1]), pair(f3[0], f3[1]), pair(f4[0], f4[1])], 1)
        second = np.concatenate([pair(f3[2], zero), pair(f4[2], f4[3])], 1)
        return np.ascontiguousarray(first + self.bias), np.ascontiguousarray(second)

    @staticmethod
    def respond(rows: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        s = rows.astype(np.int32)
        pairs = s[:, :-1] * SYMBOLS + s[:, 1:]
        r = first.take(pairs[:, : WINDOW - 3], axis=0)
        r[:, :, FILTERS:] += second.take(pairs[:, 2 : WINDOW - 1], axis=0)
        return r

    def log_probabilities(self, rows: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        out = np.empty((len(rows), len(self.languages)), np.float32)
        for at in range(0, len(rows), BATCH_WINDOWS):
            pooled = np.maximum(self.respond(rows[at : at + BATCH_WINDOWS], *tables).max(axis=1), 0)
            out[at : at + BATCH_WINDOWS] = pooled @ self.out + self.out_bias
        out -= out.max(axis=1, keepdims=True)
        return out - np.log(np.exp(out).sum(axis=1, keepdims=True))


def train(rows: np.ndarray, labels: np.ndarray, languages: Sequence[str], *, epochs: int = 4, batch: int = 128, rate: float = 0.004, seed: int = 7) -> ByteConvNet:
    """Fit the network to windows (n, WINDOW) and their language numbers by Adam."""
    rng = np.random.default_rng(seed)
    n_all = FILTERS * len(WIDTHS)
    net = ByteConvNet(
        list(languages),
        {w: rng.normal(0, 0.25, (w, SYMBOLS, FILTERS)).astype(np.float32) for w in WIDTHS},
        np.zeros(n_all, np.float32),
        rng.normal(0, 0.2, (n_all, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    if not len(rows) or len(languages) < 2:
        return net
    weights = [*net.filters.values(), net.bias, net.out, net.out_bias]
    first_moment, second_moment = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    epochs = max(epochs, -(-LEAST_STEPS * batch // len(rows)))
    filter_number = np.arange(FILTERS)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            s = rows[pick].astype(np.int32)
            response = net.respond(s, *net.tables())
            where = response.argmax(axis=1)
            pooled = np.take_along_axis(response, where[:, None, :], 1)[:, 0]
            active = np.maximum(pooled, 0)
            logits = active @ net.out + net.out_bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), labels[pick]] -= 1
            p /= len(pick)
            d_active = (p @ net.out.T) * (pooled > 0)
            grads = []
            for k, w in enumerate(WIDTHS):
                part = slice(k * FILTERS, (k + 1) * FILTERS)
                g = np.zeros_like(net.filters[w])
                for j in range(w):
                    symbol = np.take_along_axis(s, where[:, part] + j, 1)
                    np.add.at(g[j], (symbol, filter_number[None, :]), d_active[:, part])
                grads.append(g)
            grads += [d_active.sum(axis=0), active.T @ p, p.sum(axis=0)]
            step += 1
            for w, g, m, v in zip(weights, grads, first_moment, second_moment, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
    return net


def fit(docs: DataFrame, learnable: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 500, windows_per_text: int = 8) -> ByteConvNet:
    """Train on at most ``per_language`` different rows of each language for which ``learnable`` holds, ``windows_per_text`` windows from each."""
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rows = docs.where(learnable).select(F.xxhash64(ident, text).alias("key"), text.alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each language
    if not counts:
        return train(np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), [])
    limits = [(r["lang"], int(_HASH_RANGE * min(1.0, 1.2 * per_language / r["n"]))) for r in counts]
    limit = F.broadcast(docs.sparkSession.createDataFrame(limits, "lang string, upto long"))
    # About 1.2 times as many rows as wanted leave the tasks; rows that repeat id and text count once.
    near = rows.join(limit, "lang").where(F.pmod("key", F.lit(_HASH_RANGE)) < F.col("upto")).dropDuplicates(["lang", "key"])
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("key", F.lit(_HASH_RANGE)), "key"))
    sample = near.withColumn("nth", nth).where(F.col("nth") <= per_language).select("lang", "text")

    def run(batches):
        for batch in batches:
            names, cuts = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not _LETTER.search(text):
                    continue
                found = windows_of(text)
                for i in np.unique(np.linspace(0, len(found) - 1, windows_per_text).astype(int)):
                    names.append(lang)
                    cuts.append(found[i].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(cuts, pa.binary())], names=["lang", "window"])

    got = sample.mapInArrow(run, "lang string, window binary").toArrow()
    names, cuts = got.column(0).to_pylist(), got.column(1).to_pylist()
    languages = sorted(set(names))  # a language without letters in its texts is not learned
    number = {lang: i for i, lang in enumerate(languages)}
    order = sorted(range(len(cuts)), key=lambda i: (names[i], cuts[i]))  # the same network however the rows arrive
    labels = np.array([number[names[i]] for i in order], np.int64)
    windows = np.frombuffer(b"".join([cuts[i] for i in order]), np.uint8).reshape(-1, WINDOW)
    return train(windows, labels, languages)


def predict(docs: DataFrame, net: ByteConvNet, *, keep: Sequence[str] = ("doc_id",), text_col: str = "text", batch_scores: int = BATCH_SCORES) -> DataFrame:
    """``keep`` and, for every whole text, ``lang_pred`` and ``score`` (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # its size depends on the languages only

    def make():
        net = shared.value
        tables = net.tables() if net.languages else None

        def groups(index, texts):
            """Runs of the texts with their windows, each within ``batch_scores``."""
            part, windows, size = [], [], 0
            for i in index:
                found = windows_of(texts[i])
                if part and (size + len(found)) * len(net.languages) > batch_scores:
                    yield part, windows
                    part, windows, size = [], [], 0
                part.append(i)
                windows.append(found)
                size += len(found)
            if part:
                yield part, windows

        def run(texts):
            has = [bool(t and tables is not None and _LETTER.search(t)) for t in texts]
            names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            for index, windows in groups([i for i, h in enumerate(has) if h], texts):
                logp = net.log_probabilities(np.concatenate(windows), tables)
                weight = np.concatenate([(w > 2).sum(axis=1) for w in windows]).astype(np.float32)
                ends = np.cumsum([len(w) for w in windows])
                begins = np.concatenate([[0], ends[:-1]])
                total = np.add.reduceat(logp * weight[:, None], begins, axis=0)
                mean = total / np.maximum(np.add.reduceat(weight, begins), 1)[:, None]
                p = np.exp(mean - mean.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best = mean.argmax(axis=1)
                for row, i in enumerate(index):
                    names[i], scores[i] = net.languages[best[row]], float(p[row, best[row]])
            return [names, scores]

        return run

    return map_text(docs, text_col, make, [field("lang_pred", T.StringType()), field("score", T.DoubleType())], keep)
