"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Symbols are words of the benchmark (any other word is one foreign symbol); the
patterns are the benchmark's windows.  A shift table over blocks of two
symbols tells how far a search position may move; where it tells zero, the
hash of the position's last block selects the patterns that end so, and the
symbols are compared one by one.  Patterns of one length share tables.  Texts
are cut into overlapping lanes whose positions advance together in numpy, so
no position costs a Python step.

The benchmark is dealt into blocks of bounded size.  One block at a time is
collected and broadcast, and the documents pass through one narrow search for
it, in which each task builds the block's tables once.  With one block nothing
is shuffled; with several, each pass writes what it found, and the hits of a
document are merged.  No document's result depends on how many others share a
passage.

Defined cases: null text has no words; benchmark rows without words give no
window; rows of one item id pool their windows; an item id that is null marks
hits but is listed in no result; repeated document rows each get their own
result; an empty benchmark leaves every document clean, an empty table gives
an empty result; texts of any length are read whole; other columns never
matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.llm.common import field, filter_texts, map_text, materialize

WINDOW = 10
#: Bytes of benchmark text in one block of patterns: its tables take about 350 MB in a worker.
BLOCK_BYTES = 4 << 20
#: Search positions that advance together, and the longest lane in words.
LANE_WORDS = 256

_TABLE = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: digits, letters a to z, and anything beyond ASCII."""
    return text.encode().translate(_TABLE).split() if text else []


class WuManber:
    """Shift and suffix tables for patterns (rows of symbols) of one length."""

    def __init__(self, patterns: np.ndarray) -> None:
        self.patterns = patterns
        count, m = patterns.shape
        self.m, self.block = m, min(2, m)
        self.size = 1 << max(10, min(22, (4 * count * m).bit_length()))
        self.shift = np.full(self.size, m - self.block + 1, np.int32)
        for end in range(self.block, m + 1):
            np.minimum.at(self.shift, self._hash(patterns[:, end - self.block : end]), m - end)
        last = self._hash(patterns[:, m - self.block :])
        self.order = np.argsort(last, kind="stable")
        self.begin = np.searchsorted(last[self.order], np.arange(self.size + 1)).astype(np.int64)

    def _hash(self, block: np.ndarray) -> np.ndarray:
        key = block[:, 0].astype(np.uint64)
        if self.block == 2:
            key = key * np.uint64(0x9E3779B97F4A7C15) + block[:, 1].astype(np.uint64)
        key = key * np.uint64(0xC2B2AE3D27D4EB4F)
        return ((key >> np.uint64(40)) & np.uint64(self.size - 1)).astype(np.int64)

    def search(self, symbols: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start positions and pattern numbers of all occurrences inside the texts [begin, end)."""
        m = self.m
        # A lane holds the window ends lo <= p < hi; p is the place after a window.
        n_ends = np.maximum(ends - begins - m + 1, 0)
        lanes = -(-n_ends // LANE_WORDS)
        owner = np.repeat(np.arange(len(begins)), lanes)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = begins[owner] + m + nth * LANE_WORDS
        stop = np.minimum(at + LANE_WORDS, ends[owner] + 1)
        starts, found = [], []
        offsets = np.arange(-self.block, 0)
        while len(at):
            slot = self._hash(symbols[at[:, None] + offsets])
            move = self.shift[slot]
            hit = move == 0
            if hit.any():
                p, s = at[hit], slot[hit]
                lo, n = self.begin[s], self.begin[s + 1] - self.begin[s]
                which = np.repeat(np.arange(len(p)), n)
                pattern = self.order[np.repeat(lo, n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)]
                where = p[which] - m
                for k in range(m):  # direct comparison, symbol by symbol
                    same = symbols[where + k] == self.patterns[pattern, k]
                    where, pattern = where[same], pattern[same]
                starts.append(where)
                found.append(pattern)
                move = np.maximum(move, 1)
            at = at + move
            live = at < stop
            at, stop = at[live], stop[live]
        empty = np.zeros(0, np.int64)
        return (np.concatenate(starts), np.concatenate(found)) if starts else (empty, empty)


class Patterns:
    """The windows of some benchmark items, with the items of each window."""

    def __init__(self, items: Sequence[tuple[str | None, str | None]], window: int = WINDOW) -> None:
        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set] = defaultdict(set)
        for item, text in items:
            words = words_of(text)
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]
            size = min(window, len(ids))
            for at in range(len(ids) - size + 1 if ids else 0):
                owners[tuple(ids[at : at + size])].add(item)
        by_length = defaultdict(list)
        for p in owners:
            by_length[len(p)].append(p)
        self.searchers = [WuManber(np.asarray(ps, np.int64)) for _, ps in sorted(by_length.items())]
        self.owners = [[owners[p] for p in ps] for _, ps in sorted(by_length.items())]

    def search(self, texts: Sequence[str | None]) -> list[tuple[int, list[tuple[int, int]], set]]:
        """For each text: its words, the hit runs of word positions (end exclusive), and the items found."""
        get = self.numbers.get
        ids: list[int] = []
        ends = []
        for t in texts:
            ids += [get(w, 0) for w in words_of(t)]
            ends.append(len(ids))
        ends = np.asarray(ends, np.int64)
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        symbols = np.asarray(ids, np.int64)
        edge = np.zeros(len(symbols) + 1, np.int64)
        items: list[set] = [set() for _ in texts]
        for searcher, owners in zip(self.searchers, self.owners, strict=True):
            starts, pattern = searcher.search(symbols, begins, ends)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + searcher.m, -1)
            text_of = np.searchsorted(ends, starts, side="right")
            for t, p in set(zip(text_of.tolist(), pattern.tolist(), strict=True)):
                items[t] |= owners[p]
        hit = np.cumsum(edge[:-1]) > 0
        out = []
        for t, (b, e) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True)):
            inside = hit[b:e]
            if not inside.any():
                out.append((e - b, [], items[t]))
                continue
            turn = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
            out.append((e - b, list(zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True)), items[t]))
        return out


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> list[Callable[[], list[tuple]]]:
    """The benchmark's items in blocks of about ``block_bytes`` of text: functions that collect one block each."""
    rows = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").alias("text")).where("text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    if n > 1:  # so that a block costs a scan of that block
        rows = materialize(rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n))), "benchmark", ["block"])
    pick = (lambda k: rows.where(F.col("block") == k)) if n > 1 else (lambda _: rows)
    return [lambda k=k: [(r["item"], r["text"]) for r in pick(k).collect()] for k in range(n)]


RUN = T.StructType([field("start", T.LongType()), field("end", T.LongType())])


def _merge(runs: list) -> list:
    out: list[list[int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _searcher(shared, window: int):
    """A search for the patterns of one block, whose tables are built once for each task."""
    return Patterns(shared.value, window).search


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    keep: Sequence[str] = ("doc_id",),
    text_col: str = "text",
    item_col: str = "item_id",
    benchmark_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``keep`` and, for every whole text: n_words, hit_runs (word positions, end exclusive), items (sorted strings)."""
    blocks = benchmark_blocks(benchmark, item_col, benchmark_text_col, block_bytes)
    fields = [field("n_words", T.LongType()), field("hit_runs", T.ArrayType(RUN)), field("items", T.ArrayType(T.StringType()))]

    def search(df: DataFrame, text: str, shared, kept: Sequence[str]) -> DataFrame:
        def make():
            found = _searcher(shared, window)

            def run(texts):
                total = found(texts)
                runs = [[{"start": s, "end": e} for s, e in r] for _, r, _ in total]
                return [[n for n, _, _ in total], runs, [sorted(i for i in items if i is not None) for _, _, items in total]]

            return run

        return map_text(df, text, make, fields, kept)

    context = docs.sparkSession.sparkContext
    if len(blocks) == 1:
        return search(docs, text_col, context.broadcast(blocks[0]()), keep)

    # Rows with the same text have the same hits, so the text's hash is the key.
    text = F.col(f"`{text_col}`")
    keyed = docs.select(F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2"), text.alias("text"))
    parts = []
    for k, block in enumerate(blocks):
        shared = context.broadcast(block())
        found = search(keyed, "text", shared, ["k1", "k2"])
        parts.append(materialize(found if k == 0 else found.where("size(hit_runs) > 0"), "hits"))
        shared.destroy()
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    every = every.groupBy("k1", "k2").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_set("hit_runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))

    def merge(batches):
        run_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            merged = [[{"start": s, "end": e} for s, e in _merge([(r["start"], r["end"]) for r in rows])] for rows in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(merged, run_type), batch.column(4)], names=["k1", "k2", "n_words", "hit_runs", "items"])

    schema = T.StructType([field("k1", T.LongType()), field("k2", T.LongType()), *fields])
    every = every.select("k1", "k2", "n_words", "runs", "items").mapInArrow(merge, schema)
    names = {f.name for f in fields}
    rows = docs.select(*[F.col(f"`{c}`").alias(f"keep{i}") for i, c in enumerate(keep)], F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2"))
    joined = rows.join(every, ["k1", "k2"])
    return joined.select(*[F.col(f"keep{i}").alias(c) for i, c in enumerate(keep) if c not in names], *[f.name for f in fields])


def items_sha256(items: Sequence[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    benchmark_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The documents in which no benchmark window occurs, with all their columns: one narrow pass for each block."""
    blocks = benchmark_blocks(benchmark, item_col, benchmark_text_col, block_bytes)

    def keep(df: DataFrame, shared) -> DataFrame:
        def make():
            search = _searcher(shared, window)
            return lambda texts: [not runs for _, runs, _ in search(texts)]

        return filter_texts(df, text_col, make)

    context = docs.sparkSession.sparkContext
    for block in blocks[:-1]:
        shared = context.broadcast(block())
        docs = materialize(keep(docs, shared), "clean")
        shared.destroy()
    return keep(docs, context.broadcast(blocks[-1]()))
