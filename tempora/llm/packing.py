"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences.

Best fit decreasing looks only at piece lengths, and a length lies between 1 and
the capacity.  So the exact sequential algorithm runs on the histogram of
lengths: open bins are kept as runs of consecutive bin numbers with the same
remaining capacity, a segment tree over remaining capacities gives the tightest
open run in logarithmic time, and one step places as many equal pieces as fit
into a whole run.  The plan's size is bounded by the capacity and not by the
data; each piece finds its place from its length and its rank among the pieces
of that length.  Ranks come from counts per (input part, length), so no group
of equal lengths, however large, meets in one task.

Defined cases: null text counts as empty; an empty document is the end id
alone; texts of any length are read whole and cut into pieces; equal lengths are ranked by input part and place in it; repeated rows
are packed once each; an empty table gives an empty result; other columns of
the input are ignored, whatever their names.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.llm.common import materialize, stored_bytes

#: Words kept in a worker's cache, and the longest word (bytes) that enters it.
CACHE_WORDS = 400_000
CACHE_WORD_BYTES = 40
#: Rank offsets are broadcast below this size (compressed; some thirty times that in memory), joined by a shuffle above it.
BROADCAST_BYTES = 1 << 20
PIECES_PER_BATCH = 512

_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Token ids of whole texts through a cache of white-space separated words.

    The tokenizer must drop white space and never join text across it (a
    word-level pre-tokenizer), so a text's ids are its words' ids in order.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.cache: dict[bytes, bytes] = {}
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(visible)]
        self.letters = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def _slow(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch([w.decode() for w in words], add_special_tokens=False)
        return [np.asarray(e.ids, "<u4").tobytes() for e in found]

    def _core(self, word: bytes) -> bytes | None:
        """Ids of a word that the normaliser leaves as it is and that has letters only; None if it needs the whole tokenizer."""
        text = word.decode()
        if not text.isalpha():
            return None
        if not word.isascii():
            if text.lower() != text or not unicodedata.is_normalized("NFC", text):
                return None
            text = "".join([self.letters[b] for b in word])
        return np.asarray([t.id for t in self.model.tokenize(text)], "<u4").tobytes()

    def _miss(self, word: bytes) -> bytes:
        """Ids of a word that the cache lacks; they depend on the word alone, never on what is cached."""
        cache = self.cache
        ids = None
        if word[-1:] in (b".", b",") and len(word) > 1:
            core = self._core(word[:-1])  # only then is the mark a token of its own
            if core is not None:
                end = cache.get(word[-1:])
                if end is None:
                    end = cache[word[-1:]] = self._slow([word[-1:]])[0]
                ids = core + end
        else:
            ids = self._core(word)
        if ids is None:
            ids = self._slow([word])[0]
        if len(word) <= CACHE_WORD_BYTES:
            if len(cache) >= CACHE_WORDS:
                cache.clear()
            cache[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of ``text`` as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        get, miss = self.cache.get, self._miss
        raw = text.encode()
        if b"<|" in raw:  # may hold a special token, which is matched before lower-casing
            return self._slow([raw])[0]
        return b"".join([get(w) or miss(w) for w in raw.lower().split()])


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class CapacityTree:
    """Segment tree over remaining capacities; leaf c tells whether a bin with c left is open."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.open = bytearray(2 * self.size)

    def put(self, c: int, is_open: bool) -> None:
        i = c + self.size
        self.open[i] = is_open
        i >>= 1
        while i:
            self.open[i] = self.open[2 * i] | self.open[2 * i + 1]
            i >>= 1

    def tightest(self, least: int) -> int:
        """The smallest open capacity of at least ``least``, or -1."""
        i = least + self.size
        if self.open[i]:
            return least
        while i > 1:
            if not i & 1 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def plan_best_fit(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best fit decreasing of ``counts[length]`` pieces.

    Returns rows (length, first rank, first bin, pieces per bin, offset), sorted
    by length and rank: the piece of that length with rank first + i goes into
    bin first bin + i // per bin, at offset + (i % per bin) * length.
    """
    tree = CapacityTree(capacity)
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
    rows, bins = [], 0

    def add(left: int, first: int, end: int) -> None:
        if end > first and left > 0:
            if not runs[left]:
                tree.put(left, True)
            runs[left].append((first, end))

    for length in sorted(counts, reverse=True):
        rest, rank = counts[length], 0
        while rest:
            left = tree.tightest(length)
            if left < 0:
                left, per = capacity, capacity // length
                first, end = bins, bins + -(-rest // per)
                bins = end
            else:
                first, end = runs[left].pop()
                per = left // length
                if not runs[left]:
                    tree.put(left, False)
            placed = min(rest, (end - first) * per)
            rows.append((length, rank, first, per, capacity - left))
            full, some = divmod(placed, per)
            add(left - per * length, first, first + full)
            if some:
                add(left - some * length, first + full, first + full + 1)
            add(left, first + full + bool(some), end)
            rest -= placed
            rank += placed
    return np.asarray(sorted(rows), np.int64).reshape(-1, 5)


def tokenize_pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, tokenizer: str, end_id: int) -> DataFrame:
    """One row per piece: id, piece, start, length, ids (binary, <u4), and the input part with the rank in it."""
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("part_rank", T.LongType()),
    ])
    names = schema.fieldNames()

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode = encoder(tokenizer).encode
        tail = np.asarray([end_id], "<u4").tobytes()
        seen: dict[int, int] = defaultdict(int)
        step = 4 * capacity
        kind = None
        out: list[list] = [[] for _ in names]

        def flush():
            arrays = [pa.array(out[0], kind), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.binary()), pa.array(out[5], pa.int32()), pa.array(out[6], pa.int64())]
            for column in out:
                column.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            kind = keys.type
            for i in range(batch.num_rows):
                ids = encode(texts[i].as_py()) + tail
                key = keys[i].as_py()
                for k, at in enumerate(range(0, len(ids), step)):
                    cut = ids[at : at + step]
                    n = len(cut) // 4
                    for column, value in zip(out, (key, k, at // 4, n, cut, part, seen[n]), strict=True):
                        column.append(value)
                    seen[n] += 1
                if len(out[0]) >= PIECES_PER_BATCH:
                    yield flush()
            if out[0]:
                yield flush()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def pack_best_fit(
    docs: DataFrame,
    tokenizer: str,
    *,
    capacity: int = 4096,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` tokens.

    Returns one row per piece: id, piece, start, length, ids (binary,
    little-endian unsigned 32-bit), sequence_id, offset.  Pieces of a sequence
    lie gapless from offset 0.  Only a document longer than ``capacity`` is cut.
    """
    spark = docs.sparkSession
    pieces = materialize(tokenize_pieces(docs, id_col, text_col, capacity, tokenizer, end_id), "pieces")
    # At most `capacity` rows for each input part, summed map-side.
    per_part = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    per_part = materialize(per_part, "lengths")
    totals = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_best_fit(totals, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    offsets = materialize(offsets, "ranks")
    if stored_bytes(offsets) <= BROADCAST_BYTES:
        offsets = F.broadcast(offsets)
    ranked = pieces.join(offsets, ["length", "part"]).withColumn("rank", F.col("before") + F.col("part_rank"))
    shared = spark.sparkContext.broadcast(plan)  # bounded by the capacity

    @F.pandas_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    def place(length, rank):
        import pandas as pd

        plan = shared.value
        key = (plan[:, 0] << 44) + plan[:, 1]
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        row = plan[np.searchsorted(key, (length << 44) + rank, side="right") - 1]
        nth = rank - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 2] + nth // row[:, 3], "offset": row[:, 4] + nth % row[:, 3] * length})

    return ranked.withColumn("__place", place("length", "rank")).select(
        id_col, "piece", "start", "length", "ids", "__place.sequence_id", "__place.offset"
    )
