"""Exact substring dedup by a column-wise multi-document suffix order.

Two kinds of repeats are found in one pass: strings of 400 bytes that start
anywhere else (their bytes are removed), and passages of more than 50 words
that occur in another document (they are reported).  Below, a unit is a byte
for the first kind and a word for the second.

Every string has an anchor: the leftmost run of units in it with the smallest
hash.  Equal strings have equal anchors at equal places, so they meet in the
group of their anchor, and consecutive strings with the same anchor are kept
together as one context.  An anchor that occurs once proves that its strings
occur once.  Contexts are compared by 64 bits of their SHA-256: where an anchor always
has the same context, all its strings repeat.  Of all other anchors the distinct
contexts are fetched as text and put in order.

The contexts form collections whose Burrows-Wheeler transform and common
prefixes are built column by column: each round inserts one symbol of every
context (from its end), finds all new places with one stable counting sort of
the transform, takes the new common prefixes from range minima of the old
ones, and rewrites the sequential files that hold the collection.  The bytes
that all contexts of an anchor share around it (found by comparing them) are
one symbol.  A string of bytes is repeated where a suffix shares 400 bytes with
a neighbour in the order; a passage where an interval of suffixes that share 51
words has more than one document.

An anchor with more than ``GROUP_ROWS`` distinct contexts (a passage quoted
everywhere) is split: the strings of a context that start in the same slot
before the anchor become a context of their own, whose anchor is all that these
strings have in common.  Strings that differ there part; what stays together is
split again into narrower slots, at last into single strings, of which equal
ones are one row.

Defined cases: null text is empty; texts shorter than the length lose nothing;
matches never cross documents; repeated rows are copies of each other, so all
their strings repeat; overlapping strings count; texts of any length are read whole; an
empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.llm.common import materialize

LENGTH = 400
#: Bytes of an anchor for strings of 400 bytes; in proportion for others.
ANCHOR = 240
#: Words of a passage, and of its anchor; in proportion for others.
PASSAGE, PASSAGE_ANCHOR = 51, 12
#: Distinct contexts of one anchor beyond which it is split, and into how many slots at a time.
GROUP_ROWS = 256
SLOTS = 4
#: Distinct contexts for each task that puts them in order.
TASK_ROWS = 3000
#: Contexts that a task holds to deal them into collections, and contexts and anchors in one collection.
PENDING_ROWS = 6000
COLLECTION_ROWS, COLLECTION_GROUPS = 1024, 400
BYTES, WORDS = 0, 1
_PART = 1 << 17
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_POSITION = np.uint64((1 << 18) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(29)
    return x


class RollingHash:
    """64-bit hashes of any substrings of a part of at most ``size`` bytes."""

    def __init__(self, seed: int, size: int) -> None:
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(1 << 32, 1 << 62)) * 2 + 1
        self.power = self._powers(base, size)
        self.inverse = self._powers(pow(base, -1, 1 << 64), size)

    @staticmethod
    def _powers(base: int, size: int) -> np.ndarray:
        out = np.full(size + 1, np.uint64(base), np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of hashed units, from which ``of`` and ``rolling`` take those of substrings."""
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.power[: len(values)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((sums[end] - sums[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64))

    def rolling(self, sums: np.ndarray, length: int) -> np.ndarray:
        n = len(sums) - length
        return _mix((sums[length:] - sums[:n]) * self.inverse[:n])


_hashes: list[RollingHash] = []


def _hash_pair() -> list[RollingHash]:
    if not _hashes:
        _hashes.extend(RollingHash(seed, _PART + 4096) for seed in (11, 12))
    return _hashes


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    prefix = np.minimum.accumulate(rows, axis=1).ravel()
    suffix = np.ascontiguousarray(np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(suffix[:n], prefix[width - 1 : width - 1 + n])


def word_places(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word of a text."""
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).view(np.int8)))
    return edge[::2], edge[1::2]


def words_in(raw: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and hash of each word of a text of any length."""
    begin, end = word_places(raw)
    hashes = np.empty(len(begin), np.uint64)
    first = _hash_pair()[0]
    i = 0
    while i < len(begin):
        j = int(np.searchsorted(end, begin[i] + _PART, side="right"))
        if j == i:  # a word longer than a part
            hashes[i] = xxhash.xxh64_intdigest(data[begin[i] : end[i]])
            j = i + 1
        else:
            sums = first.sums(first.table[raw[begin[i] : end[j - 1]]])
            hashes[i:j] = first.of(sums, begin[i:j] - begin[i], end[i:j] - begin[i])
        i = j
    return begin, end, hashes


def _anchored(sums: np.ndarray, length: int, anchor: int, texts: Sequence[tuple[int, int]]) -> tuple[np.ndarray, ...]:
    """Runs of string starts with one anchor inside the texts [begin, end): first start, last start, the anchor's hash, the anchor's place in the context."""
    if len(sums) <= length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = _hash_pair()[0].rolling(sums, anchor)
    keyed = (hashes & ~_POSITION) | np.arange(len(hashes), dtype=np.uint64)
    place = (_sliding_min(keyed, length - anchor + 1) & _POSITION).astype(np.int64)
    inside = np.zeros(len(place), bool)
    for begin, end in texts:
        inside[begin : max(begin, end - length + 1)] = True
    change = place[1:] != place[:-1]
    begin = np.flatnonzero(inside & np.concatenate([[True], change | ~inside[:-1]]))
    last = np.flatnonzero(inside & np.concatenate([change | ~inside[1:], [True]]))
    return begin, last, hashes[place[begin]], place[begin] - begin


def _long_anchored(values: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """``_anchored`` of one text of any length, part by part."""
    first = _hash_pair()[0]
    out = [_anchored(np.zeros(1, np.uint64), length, anchor, [])]
    for at in range(0, len(values) - length + 1, _PART):
        part = values[at : at + _PART + length - 1]
        begin, last, *rest = _anchored(first.sums(part), length, anchor, [(0, len(part))])
        out.append((begin + at, last + at, *rest))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _digests(data: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of the SHA-256 of each part of a text."""
    sha = hashlib.sha256
    whole = b"".join([sha(data[a:b]).digest() for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(whole, np.int64)[::4]


_UNEVEN = re.compile(rb"[\x09-\x0D]|\x20\x20")
_PER_CONTEXT = ("first", "last", "anchor", "context", "place", "tail")


def _long_contexts(data: bytes, length: int, anchor: int, passage: int, passage_anchor: int) -> list[tuple[np.ndarray, ...]]:
    raw = np.frombuffer(data, np.uint8)
    begin, last, anchors, place = _long_anchored(_hash_pair()[0].table[raw], length, anchor)
    found = [(begin, last, anchors & ~np.uint64(1), _digests(data, begin, last + length), place, last - begin)]
    begin, end, hashes = words_in(raw, data)
    found.append(_of_words(data, begin, end, *_long_anchored(hashes, passage, passage_anchor), length, passage))
    return found


def _of_words(data: bytes, begin: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray, anchors: np.ndarray, place: np.ndarray, length: int, passage: int) -> tuple[np.ndarray, ...]:
    at, to = begin[a], end[b + passage - 1]
    if _UNEVEN.search(data):  # words are compared with one blank between them
        sizes = end - begin + 1
        ends = np.cumsum(sizes) - 1
        digests = _digests(b" ".join(data.split()), ends[a] - sizes[a] + 1, ends[b + passage - 1])
    else:
        digests = _digests(data, at, to)
    return at, to - length, anchors | np.uint64(1), digests, place, b - a


def contexts(texts: Sequence[bytes], length: int, anchor: int, passage: int, passage_anchor: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Contexts of both kinds of several texts: the number of each text's, and ``_PER_CONTEXT`` for all in order of the texts.

    first byte, last byte less ``length``, anchor (its lowest bit is the kind),
    digest of its bytes or words, place of the anchor and last start (units of
    the context).  Short texts are hashed together.
    """
    first = _hash_pair()[0]
    owners, found = [], []
    at = 0
    while at < len(texts):
        upto, size = at + 1, len(texts[at]) + 1
        while upto < len(texts) and size + len(texts[upto]) < _PART:
            size += len(texts[upto]) + 1
            upto += 1
        if size > _PART:
            for part in _long_contexts(texts[at], length, anchor, passage, passage_anchor):
                owners.append(np.full(len(part[0]), at))
                found.append(part)
        else:
            data = b" ".join(texts[at:upto])
            raw = np.frombuffer(data, np.uint8)
            ends = np.cumsum([len(t) + 1 for t in texts[at:upto]]) - 1
            begins = ends - [len(t) for t in texts[at:upto]]
            sums = first.sums(first.table[raw])
            begin, last, anchors, place = _anchored(sums, length, anchor, list(zip(begins.tolist(), ends.tolist(), strict=True)))
            parts = [(begin, last, anchors & ~np.uint64(1), _digests(data, begin, last + length), place, last - begin)]
            begin, end = word_places(raw)
            words = first.sums(first.of(sums, begin, end))
            cuts = np.searchsorted(begin, begins), np.searchsorted(begin, ends)
            spots = _anchored(words, passage, passage_anchor, list(zip(*(c.tolist() for c in cuts), strict=True)))
            parts.append(_of_words(data, begin, end, *spots, length, passage))
            for part in parts:
                owner = np.searchsorted(begins, part[0], side="right") - 1
                owners.append(owner + at)
                found.append((part[0] - begins[owner], part[1] - begins[owner], *part[2:]))
        at = upto
    owner = np.concatenate([np.zeros(0, np.int64), *owners])
    order = np.argsort(owner, kind="stable")
    columns = [np.concatenate([np.zeros(0, np.int64), *(f[k].view(np.int64) for f in found)])[order] for k in range(len(_PER_CONTEXT))]
    return np.bincount(owner, minlength=len(texts)), columns


class Sequential:
    """A column of the collection as a file that is read whole and written anew each round.

    The file is a task's scratch space, gone with the task; results never depend on it.
    """

    def __init__(self, dtype) -> None:
        self.dtype = np.dtype(dtype)
        self.rows = 0
        self.file = tempfile.TemporaryFile(buffering=0)  # noqa: SIM115

    def read(self) -> np.ndarray:
        out = np.empty(self.rows, self.dtype)
        self.file.seek(0)
        if self.rows and self.file.readinto(memoryview(out).cast("B")) != out.nbytes:
            raise OSError("a sequential file is cut short")
        return out

    def write(self, values: np.ndarray) -> None:
        self.rows = len(values)
        self.file.seek(0)
        left = memoryview(np.ascontiguousarray(values, self.dtype)).cast("B")
        while left:
            left = left[self.file.write(left) :]

    def close(self) -> None:
        self.file.close()


def suffix_order(symbols: Sequence[np.ndarray], group: np.ndarray, shared_weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of a grouped collection in order: owner, suffix length, common prefix with the one before (bytes).

    symbols[i] holds a string's symbols: 1 for what its group shares, then 2 and
    up for bytes.  Rows of a group follow each other.  A shared symbol weighs
    ``shared_weight`` of its group, any other 1; groups never mix.  Equal
    suffixes are ordered by their rows.
    """
    m = len(symbols)
    lengths = np.array([len(s) for s in symbols], np.int64)
    widest = int(lengths.max(initial=0))
    columns = np.zeros((widest + 1, m), np.uint16)  # columns[j] precedes the suffix of length j; 0 at the start of a string
    for i, s in enumerate(symbols):
        columns[: len(s), i] = s[::-1]
    alphabet = int(columns.max(initial=0)) + 1
    n_groups = int(group.max(initial=0)) + 1
    key_type = np.uint16 if n_groups * alphabet <= 1 << 16 else np.uint32  # 16 bits sort by counting
    base = (group * alphabet).astype(key_type)
    # The transform holds group and symbol as one sort key; a suffix is named by its row and length.
    transform, common, name = Sequential(key_type), Sequential(np.int32), Sequential(np.int64)
    try:
        transform.write(base + columns[0])
        common.write(np.zeros(m, np.int32))
        name.write(np.arange(m) * (widest + 1))
        place = np.arange(m)  # of the suffix that each row inserted last
        active = np.flatnonzero(lengths > 0)
        rows = np.bincount(group, minlength=n_groups)
        count, zeros = rows, np.bincount(group[columns[0] == 0], minlength=n_groups)
        for j in range(1, widest + 1):
            key, lcp, names = transform.read(), common.read(), name.read()
            order = np.argsort(key, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            at = place[active]
            mine, r, g = key[at], rank[at], group[active]
            # In the new order a group has its empty suffixes, then one suffix for each non-zero symbol.
            grown = rows + count - zeros
            first, new_first = np.cumsum(count) - count, np.cumsum(grown) - grown
            target = new_first[g] + rows[g] + (r - first[g] - zeros[g])
            # Common prefixes: of the same symbol's neighbours in the old order.
            weight = np.where(mine - base[active] == 1, shared_weight[g], 1)
            above, below = r - 1, r + 1
            has_above = (above >= 0) & (key[order[np.maximum(above, 0)]] == mine)
            has_below = (below < len(order)) & (key[order[np.minimum(below, len(order) - 1)]] == mine)
            up = np.zeros(len(at), np.int64)
            up[has_above] = weight[has_above] + _range_min(lcp, order[above[has_above]] + 1, at[has_above] + 1)
            down = weight[has_below] + _range_min(lcp, at[has_below] + 1, order[below[has_below]] + 1)
            # Merge.
            total = len(key) + len(active)
            old = np.ones(total, bool)
            old[target] = False
            new_key, new_lcp, new_names = np.empty(total, key_type), np.empty(total, np.int32), np.empty(total, np.int64)
            new_key[old], new_lcp[old], new_names[old] = key, lcp, names
            before = columns[j][active]
            new_key[target] = base[active] + before
            new_lcp[target[has_below] + 1] = down
            new_lcp[target] = up
            new_names[target] = active * (widest + 1) + j
            # Two new suffixes may be neighbours; the later one's prefix is its own `up`.
            transform.write(new_key)
            common.write(new_lcp)
            name.write(new_names)
            place = np.flatnonzero(old)[place] if len(place) else place
            place[active] = target
            count, zeros = grown, zeros + np.bincount(g[before == 0], minlength=n_groups)
            active = active[lengths[active] > j]
        names = name.read()
        return names // (widest + 1), names % (widest + 1), common.read()
    finally:
        for column in (transform, common, name):
            column.close()


def _range_min(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Minimum of values[begin:end] for each pair; no range is empty."""
    if not len(begin):
        return np.zeros(0, np.int64)
    edges = np.stack([begin, end], 1).ravel()
    padded = np.concatenate([values, values[-1:]])
    return np.minimum.reduceat(padded, edges)[::2].astype(np.int64)


def _shared(left: bytes, right: bytes, limit: int, back: bool) -> int:
    """Length of the common prefix (or suffix, going back) of two byte strings."""
    lo, hi = 0, min(len(left), len(right), limit)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        same = left[len(left) - mid :] == right[len(right) - mid :] if back else left[:mid] == right[:mid]
        lo, hi = (mid, hi) if same else (lo, mid - 1)
    return lo


def _numbered(heads: Sequence[Sequence], tails: Sequence[Sequence]) -> list[np.ndarray]:
    """Symbols of each context: 1 for what all share, between its head and its tail; bytes from 2 on by value, words by their number among those of the group."""
    if isinstance(heads[0], bytes):
        as_one = [np.frombuffer(h + b"\0" + t, np.uint8).astype(np.uint16) + 2 for h, t in zip(heads, tails, strict=True)]
        for symbols, h in zip(as_one, heads, strict=True):
            symbols[len(h)] = 1
        return as_one
    number: dict[bytes, int] = {}
    code = lambda units: [number.setdefault(w, len(number) + 2) for w in units]
    return [np.array([*code(h), 1, *code(t)], np.uint16) for h, t in zip(heads, tails, strict=True)]


def _reach(rows: np.ndarray, common: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """The longest prefix that each of some neighbouring suffixes shares with one of another document; ``common`` is with the one before."""
    best = np.zeros(len(rows), np.int64)
    for order in (range(1, len(rows)), range(len(rows) - 2, -1, -1)):
        step = 1 if order.step == 1 else -1
        held = np.zeros(len(rows), np.int64)
        for i in order:
            j = i - step
            c = common[i] if step == 1 else common[j]
            (a, b), (x, y) = documents[rows[i]], documents[rows[j]]
            held[i] = min(c, held[j]) if a == b == x == y else c
        best = np.maximum(best, held)
    return best


def repeated_starts(groups: Sequence[Sequence[tuple]], length: int, anchor: int, kind: int = BYTES) -> list[list[np.ndarray]]:
    """For each context (units, place of the anchor, occurrences, smallest and largest document) of each group: the starts whose string repeats.

    Strings of bytes repeat anywhere in the group, passages in another document.
    """
    prepared = []
    for rows in groups:
        lefts, rights = [r[0][: r[1]] for r in rows], [r[0][r[1] + anchor :] for r in rows]
        by_end = sorted(x[::-1] for x in lefts)
        left = _shared(by_end[0], by_end[-1], length, False)
        right = _shared(min(rights), max(rights), length, False)
        symbols = _numbered([x[: len(x) - left] for x in lefts], [x[right:] for x in rights])
        used, dense = np.unique(np.concatenate(symbols), return_inverse=True)  # a dense alphabet keeps the sort key in 16 bits
        symbols = np.split((dense + 1).astype(np.uint16), np.cumsum([len(x) for x in symbols])[:-1])
        prepared.append((symbols, left, left + anchor + right, len(used) + 1))
    # Groups of about one width share a collection, so none waits through the rounds of wider ones.
    order = sorted(range(len(groups)), key=lambda g: max(len(x) for x in prepared[g][0]))
    out: list[list[np.ndarray]] = [[] for _ in groups]
    part: list[int] = []
    n_rows = alphabet = 0
    for g in [*order, None]:
        if g is not None:
            n_rows, alphabet = n_rows + len(groups[g]), max(alphabet, prepared[g][3])
        if part and (g is None or n_rows > COLLECTION_ROWS or len(part) >= COLLECTION_GROUPS or (len(part) + 1) * alphabet > 1 << 16):
            for h, found in zip(part, _starts_in([groups[h] for h in part], [prepared[h] for h in part], length, kind), strict=True):
                out[h] = found
            part, n_rows, alphabet = [], len(groups[g]) if g is not None else 0, prepared[g][3] if g is not None else 0
        if g is not None:
            part.append(g)
    return out


def _starts_in(groups: Sequence[Sequence[tuple]], prepared: Sequence[tuple], length: int, kind: int) -> list[list[np.ndarray]]:
    """The repeated starts of one collection."""
    symbols = [x for p in prepared for x in p[0]]
    group = np.repeat(np.arange(len(groups)), [len(rows) for rows in groups])
    place = np.array([r[1] for rows in groups for r in rows]) - np.array([p[1] for p in prepared])[group]
    owner, size, lcp = suffix_order(symbols, group, np.array([p[2] for p in prepared]))
    starts = np.array([len(x) for x in symbols])[owner] - size  # in symbols
    at_shared = np.flatnonzero((starts == place[owner]) & (size > 0))
    if kind == BYTES:
        best = np.maximum(lcp, np.concatenate([lcp[1:], [0]]))
        repeats, reach = best >= length, best[at_shared]
    else:
        documents = np.array([r[3:] for rows in groups for r in rows], np.int64)
        begin = np.flatnonzero(lcp < length)  # of each interval of suffixes that share ``length`` words
        ends = documents[owner]
        several = np.minimum.reduceat(ends[:, 0], begin) != np.maximum.reduceat(ends[:, 1], begin)
        repeats = np.repeat(several, np.diff(np.concatenate([begin, [len(lcp)]])))
        cuts = np.flatnonzero(np.diff(group[owner[at_shared]])) + 1
        reach = np.concatenate([_reach(owner[i], lcp[i], documents) for i in np.split(at_shared, cuts)])
    found: list[list[int]] = [[] for _ in symbols]
    before = repeats & (starts < place[owner])
    for row, start in zip(owner[before].tolist(), starts[before].tolist(), strict=True):
        found[row].append(start)
    reach = dict(zip(owner[at_shared].tolist(), reach.tolist(), strict=True))
    out, row = [], 0
    for rows in groups:
        here = []
        for units, p, n, lo, hi in rows:
            last = len(units) - length
            if n > 1 if kind == BYTES else lo != hi:
                here.append(np.arange(last + 1))
            else:
                # Strings that start inside what the group shares, up to the anchor itself.
                more = min(p, last, int(place[row]) + reach[row] - length)
                here.append(np.array(sorted(found[row]) + list(range(int(place[row]), more + 1)), np.int64))
            row += 1
        out.append(here)
    return out


def _runs(starts: np.ndarray) -> list[dict]:
    """Starts as runs (first, last)."""
    if not len(starts):
        return []
    if starts[-1] - starts[0] == len(starts) - 1:
        return [{"first": int(starts[0]), "last": int(starts[-1])}]
    cut = np.flatnonzero(np.diff(starts) > 1)
    first = starts[np.concatenate([[0], cut + 1])]
    last = starts[np.concatenate([cut, [len(starts) - 1]])]
    return [{"first": int(a), "last": int(b)} for a, b in zip(first, last, strict=True)]


_RUNS = "array<struct<first:int,last:int>>"
_RUNS_ARROW = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


class Spans:
    """Lengths in units at one level of splitting: of strings, of what the strings of an anchor share, and how many may start in a context."""

    def __init__(self, length: int, passage: int, shared: tuple[int, int] | None = None) -> None:
        self.length = (length, passage)
        self.shared = shared or (max(1, length * ANCHOR // LENGTH), max(1, passage * PASSAGE_ANCHOR // PASSAGE))
        self.starts = tuple(n - a + 1 for n, a in zip(self.length, self.shared, strict=True))
        self.step = tuple(-(-s // SLOTS) for s in self.starts)

    def narrower(self) -> Spans:
        return Spans(*self.length, tuple(n - s + 1 for n, s in zip(self.length, self.step, strict=True)))


def _resolve(spans: Spans):
    """Contexts, whole anchors in order, to (anchor, context, runs)."""

    def run(batches):
        pending: tuple[list, list] = ([], [])
        rows = [0, 0]

        def flush(kind):
            units = (lambda t: t.split()) if kind == WORDS else bytes
            done = repeated_starts([[(units(t), p, n, lo, hi) for _, _, n, lo, hi, p, _, t in g] for g in pending[kind]], spans.length[kind], spans.shared[kind], kind)
            flat = [(a, c, _runs(s)) for g, found in zip(pending[kind], done, strict=True) for (a, c, *_), s in zip(g, found, strict=True)]
            pending[kind].clear()
            rows[kind] = 0
            names = ["anchor", "context", "runs"]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], pa.int64()), pa.array([x[2] for x in flat], _RUNS_ARROW)], names=names)

        def add(group):
            kind = group[0][0] & 1
            pending[kind].append(group)
            rows[kind] += len(group)
            if rows[kind] >= PENDING_ROWS:
                yield flush(kind)

        group: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[0][0] != row[0]:
                    yield from add(group)
                    group = []
                group.append(row)
        if group:
            yield from add(group)
        for kind in (BYTES, WORDS):
            if pending[kind]:
                yield flush(kind)

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents with a 128-bit key of id and text; rows with the same key are copies of each other."""
    text, key = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    return docs.select(F.xxhash64(key, text).alias("k1"), F.xxhash64(F.lit(7), text, key).alias("k2"), key.alias("id"), F.coalesce(text, F.lit("")).cast("binary").alias("data"))


def repeated_runs(keyed: DataFrame, length: int = LENGTH, passage: int = PASSAGE) -> tuple[DataFrame, DataFrame]:
    """The repeated strings as (doc, first, last, anchor, tail, runs), one row for each context that has any, and the keys (doc, k1, k2).

    A context holds the bytes from ``first`` to ``last + length``; a run has the
    first and last unit of the context from which strings repeat.
    """
    spans = Spans(length, passage)

    def find(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                counts, columns = contexts(part.column(2).to_pylist(), length, spans.shared[BYTES], passage, spans.shared[WORDS])
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in columns]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists], names=["k1", "k2", *_PER_CONTEXT])

    lists = ", ".join(f"{name} array<bigint>" for name in _PER_CONTEXT)
    least = min(length, 2 * passage - 1)
    per_doc = keyed.where(F.octet_length("data") >= least).select("k1", "k2", "data").mapInArrow(find, f"k1 bigint, k2 bigint, {lists}")
    per_doc = materialize(per_doc.withColumn("doc", F.monotonically_increasing_id()), "contexts")
    keys = per_doc.select("doc", "k1", "k2")
    rows = per_doc.select("doc", F.inline(F.arrays_zip(*_PER_CONTEXT)))
    ends = [F.min("context").alias("c1"), F.max("context").alias("c2"), F.min("doc").alias("lo"), F.max("doc").alias("hi")]
    several = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), *ends).where(f"n > 1 AND ({_IS_BYTES} OR lo <> hi)")
    several = materialize(several.select("anchor", (F.col("c1") != F.col("c2")).alias("mixed")), "anchors")
    rows = materialize(rows.join(several.hint("shuffle_hash"), "anchor"), "instances")
    out = ["doc", "first", "last", "anchor", "tail"]
    settled = rows.where("NOT mixed").select(*out, F.array(F.struct(F.lit(0).alias("first"), F.col("tail").cast("int").alias("last"))).cast(_RUNS).alias("runs"))
    mixed = rows.where("mixed")

    # One instance stands for each distinct context; its text is fetched.
    pick = F.struct("doc", "first", "last", "place", "tail")
    distinct = mixed.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min(pick).alias("at"))
    distinct = _with_rows(materialize(distinct, "distinct"))
    wanted = distinct.select("at.doc", F.struct("anchor", "context", "n", "lo", "hi", "rows", "at.first", "at.last", "at.place", "at.tail").alias("c"))
    wanted = materialize(wanted.groupBy("doc").agg(F.collect_list("c").alias("cs")).join(keys, "doc").select("k1", "k2", "cs"), "wanted")
    source = keyed.select("k1", "k2", "data").join(wanted.hint("shuffle_hash"), ["k1", "k2"])
    cut = F.explode(F.transform("cs", lambda c: F.struct(
        *[c[name].alias(name) for name in ("anchor", "context", "n", "lo", "hi", "rows")], *[c[name].cast("int").alias(name) for name in ("place", "tail")],
        F.substring(F.col("data"), (c["first"] + 1).cast("int"), (c["last"] - c["first"] + length).cast("int")).alias("data"),
    )))
    # A document that is there more than once gives its contexts as often; one of each stays.
    kept = [F.first(name).alias(name) for name in (*_names(_CONTEXT)[2:], "rows")]
    texts = materialize(source.select(cut.alias("c")).select("c.*").groupBy("anchor", "context").agg(*kept), "texts")
    results = materialize(_repeats_in(texts, spans), "resolved")
    return settled.unionByName(mixed.join(results.hint("shuffle_hash"), ["anchor", "context"]).select(*out, "runs")), keys


_CONTEXT = "anchor bigint, context bigint, n bigint, lo bigint, hi bigint, place int, tail int, data binary"
_IS_BYTES = "(anchor & 1) = 0"


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _values(kind: int, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed units of a context for both hashes, and where units begin and end."""
    raw = np.frombuffer(data, np.uint8)
    first, second = _hash_pair()
    if kind == WORDS:
        begin, end, hashes = words_in(raw, data)
        return hashes, _mix(hashes), begin, end
    at = np.arange(len(raw))
    return first.table[raw], second.table[raw], at, at + 1


def _with_rows(distinct: DataFrame) -> DataFrame:
    """Distinct contexts of anchors with anything to repeat, with ``rows``, the number of their anchor's."""
    per_anchor = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("__most"), F.min("lo").alias("__lo"), F.max("hi").alias("__hi"))
    per_anchor = per_anchor.where(f"CASE WHEN {_IS_BYTES} THEN rows > 1 OR __most > 1 ELSE __lo <> __hi END").select("anchor", "rows")
    return distinct.join(per_anchor, "anchor")


def _repeats_in(texts: DataFrame, spans: Spans) -> DataFrame:
    """(anchor, context, runs) of distinct contexts with repeated strings.

    The units that the contexts of an anchor share begin at ``place``; strings
    start from unit 0 to ``tail``.  The only context of its anchor repeats as a
    whole or not at all; all others are put in order.
    """
    every = F.array(F.struct(F.lit(0).alias("first"), F.col("tail").alias("last"))).cast(_RUNS)
    out = texts.where("rows = 1").select("anchor", "context", every.alias("runs"))
    few = texts.where(F.col("rows").between(2, GROUP_ROWS))
    tasks = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-few.count() // TASK_ROWS))
    few = few.repartition(tasks, "anchor").sortWithinPartitions("anchor", "context").select(*_names(_CONTEXT))
    found = few.mapInArrow(_resolve(spans), f"anchor bigint, context bigint, runs {_RUNS}")
    out = out.unionByName(found.where(F.size("runs") > 0))
    hot = texts.where(F.col("rows") > GROUP_ROWS).select(*_names(_CONTEXT))
    if hot.isEmpty():
        return out
    parts = materialize(hot.mapInArrow(_slots(spans), f"{_CONTEXT}, {_PARENT}"), "slots")
    merged = [F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), *[F.first(name).alias(name) for name in ("place", "tail", "data")]]
    narrow = materialize(parts.groupBy("anchor", "context").agg(*merged), "narrow")
    below = materialize(_repeats_in(materialize(_with_rows(narrow), "sized"), spans.narrower()), "below")
    back = parts.select("anchor", "context", "parent_anchor", "parent_context", "start").join(below, ["anchor", "context"])
    moved = F.transform("runs", lambda r: F.struct((r["first"] + F.col("start")).alias("first"), (r["last"] + F.col("start")).alias("last")))
    whole = back.select("parent_anchor", "parent_context", moved.cast(_RUNS).alias("runs")).groupBy("parent_anchor", "parent_context").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    return out.unionByName(whole.select(F.col("parent_anchor").alias("anchor"), F.col("parent_context").alias("context"), "runs"))


_PARENT = "parent_anchor bigint, parent_context bigint, start int"


def _slots(spans: Spans):
    """Contexts cut by the slot in which their strings start, counted back from the anchor.

    All strings of a slot hold the same ``length - step + 1`` units, which are
    the anchor of the new context.
    """

    def run(batches):
        second = _hash_pair()[1]
        for batch in batches:
            out = []
            for anchor, context, n, lo, hi, place, _, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kind = anchor & 1
                length, step = spans.length[kind], spans.step[kind]
                _, values, begins, ends = _values(kind, data)
                sums = second.sums(values)
                last = len(values) - length
                slots = sorted({(place - s) // step for s in range(last + 1)})
                for slot in slots:
                    a, b = max(0, place - (slot + 1) * step + 1), min(last, place - slot * step)
                    core = place - slot * step
                    begin, end = np.array([core, a]), np.array([core + length - step + 1, b + length])
                    common, whole = second.of(sums, begin, end)
                    salt = np.array([slot + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    key = (_mix((salt ^ common) + np.array([anchor]).view(np.uint64)) & ~np.uint64(1)) | np.uint64(kind)
                    out.append((int(key.view(np.int64)[0]), int(whole.view(np.int64)), n, lo, hi, core - a, b - a, data[begins[a] : ends[b + length - 1]], anchor, context, a))
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32()]
            columns = list(zip(*out, strict=True)) if out else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_names(f"{_CONTEXT}, {_PARENT}"))

    return run


def _covered(found: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes (end exclusive) covered by these."""
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def spans_in(data: bytes, rows: Sequence[tuple], length: int, passage: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Byte spans of a text's repeated strings, and of its passages, from its contexts (first, last, anchor, tail, runs)."""
    removed, passages = [], []
    for at, last, anchor, tail, runs in rows:
        if anchor & 1 == BYTES:
            removed += [(at + a, at + b + length) for a, b in runs]
        elif runs == [(0, tail)]:
            passages.append((at, last + length))
        else:
            words = [m.span() for m in _WORD.finditer(data, at, last + length)]
            passages += [(words[a][0], words[b + passage - 1][1]) for a, b in runs]
    return _covered(removed), _covered(passages)


def _rows_of(lists: pa.ListArray) -> list[list[tuple]]:
    """The contexts of each document as tuples, without a Python dictionary for each."""
    *plain, runs = lists.values.flatten()
    edges, values = runs.offsets.to_pylist(), [x.to_pylist() for x in runs.values.flatten()]
    pairs = list(zip(*values, strict=True))
    flat = list(zip(*(x.to_pylist() for x in plain), [pairs[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], strict=True))
    cuts = lists.offsets.to_pylist()
    return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """One row per document: id, n_bytes, spans (removed bytes, end exclusive), kept (the remaining bytes), passages, n_passage_words.

    Every byte covered by a string of ``length`` bytes that also starts
    elsewhere in the table is removed, all occurrences alike.  ``passages`` are
    the byte spans covered by ``passage`` words that also follow each other in
    another document, however many bytes they have; they stay in ``kept``
    unless the first rule removes them.
    """
    keyed = _keyed(docs, id_col, text_col)
    runs, keys = repeated_runs(keyed, length, passage)
    per_doc = runs.groupBy("doc").agg(F.collect_list(F.struct("first", "last", "anchor", "tail", "runs")).alias("rs"))
    once = keys.groupBy("k1", "k2").agg(F.min("doc").alias("doc"))  # rows with one key have the same text, and so the same repeats
    per_doc = materialize(per_doc.join(once, "doc").select("k1", "k2", "rs"), "removed")
    joined = keyed.join(per_doc.hint("shuffle_hash"), ["k1", "k2"], "left").select("id", "data", "rs")
    fields = [("n_bytes", T.LongType()), ("spans", SPANS), ("kept", T.BinaryType()), ("passages", SPANS), ("n_passage_words", T.LongType())]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *[T.StructField(n, t) for n, t in fields]])
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.int64(), span_type, pa.binary(), span_type, pa.int64()]

    def cut(batches):
        for batch in batches:
            found = _rows_of(batch.column(2))
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                out: list[list] = [[] for _ in kinds]
                for data, rows in zip(part.column(1).to_pylist(), found[at : at + 64], strict=True):
                    removed, passages = spans_in(data, rows, length, passage)
                    rest, done = [], 0
                    for a, b in removed:
                        rest.append(data[done:a])
                        done = b
                    as_rows = [[{"start": a, "end": b} for a, b in x] for x in (removed, passages)]
                    n_words = sum(len(data[a:b].split()) for a, b in passages)
                    for column, value in zip(out, (len(data), as_rows[0], b"".join([*rest, data[done:]]), as_rows[1], n_words), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], names=schema.fieldNames())

    return joined.mapInArrow(cut, schema)
