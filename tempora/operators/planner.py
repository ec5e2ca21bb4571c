"""Splitting a timeline into chunks.

The best split has, in this order: the fewest hard cuts (boundaries strictly
inside an interval), the smallest maximum load (measure of intervals in a
chunk), the smallest sum of squared loads, the earliest boundaries.  One
recording is one group; recordings are planned independently.

A cut is hard for the choice where it lies strictly inside the union of the
intervals; a chunk's end is labelled hard where it lies strictly inside one of
the intervals as given, so a cut between two that touch is labelled silence.

A dynamic programme over (chunks left, boundary, hard cuts used) runs three
times: for the fewest hard cuts; by bisection for the smallest cap on the load
that still allows them; for the smallest sum of squares under both, from the
end, so that the walk forward can take the earliest boundary that keeps the
optimum.  Loads grow along the axis, so a cap on the load only shortens the
window of allowed ends, and a stage of the first two takes range minima; a stage
of the third takes boundaries times the width of the bounds.  The axis should
have coarse units (seconds rather than samples).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.operators.intervals import normalize, union

_FAR = np.int64(1) << np.int64(60)
#: Chunks times boundaries times width of the bounds up to which plain loops beat arrays.
SMALL = 20_000


class InfeasibleError(ValueError):
    """No split obeys the bounds."""


def measure_to(n: int, intervals: Sequence[tuple[int, int]]) -> np.ndarray:
    """Measure of the union of intervals before each coordinate 0..n."""
    edge = np.zeros(n + 1, np.int64)
    for s, e in intervals:
        s, e = max(0, min(n, s)), max(0, min(n, e))
        if e > s:
            edge[s] += 1
            edge[e] -= 1
    covered = np.cumsum(edge)[:-1] > 0
    return np.concatenate([[0], np.cumsum(covered)]).astype(np.int64)


def hard_at(n: int, intervals: Sequence[tuple[int, int]]) -> np.ndarray:
    """Whether each coordinate 0..n lies strictly inside the union of the intervals, touching ones merged."""
    speech = np.diff(measure_to(n, intervals)) > 0
    out = np.zeros(n + 1, bool)
    out[1:n] = speech[:-1] & speech[1:]
    return out


def inside_one(n: int, intervals: Sequence[tuple[int, int]]) -> np.ndarray:
    """Whether each coordinate 0..n lies strictly inside one of the intervals."""
    edge = np.zeros(n + 2, np.int64)
    for s, e in intervals:
        s, e = max(0, min(n, s)), max(0, min(n, e))
        if e > s + 1:
            edge[s + 1] += 1
            edge[e] -= 1
    return np.cumsum(edge)[:-1] > 0


def _range_minimum(values: np.ndarray):
    """A function from (begin, end) arrays to the minima of values[begin:end]; empty ranges give ``_FAR``."""
    levels = [values]
    while 2 << (len(levels) - 1) <= len(values):
        half, last = 1 << (len(levels) - 1), levels[-1]
        levels.append(np.minimum(last[:-half], last[half:]))

    def minimum(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.full(len(begin), _FAR, np.int64)
        size = end - begin
        level = np.zeros(len(size), np.int64)
        level[size > 0] = np.log2(size[size > 0]).astype(np.int64)
        for k in np.unique(level[size > 0]):
            pick = (size > 0) & (level == k)
            out[pick] = np.minimum(levels[k][begin[pick]], levels[k][end[pick] - (1 << k)])
        return out

    return minimum


class Timeline:
    """What the planner asks of a recording, computed once for all candidate counts."""

    def __init__(self, n: int, intervals: Sequence[tuple[int, int]]) -> None:
        for s, e in intervals:
            if max(0, min(n, e)) < max(0, min(n, s)):
                raise ValueError(f"interval ends before it starts: {(s, e)}")
        self.n = n
        self.before, self.hard, self.inside = measure_to(n, intervals), hard_at(n, intervals), inside_one(n, intervals)


def optimal_boundaries(n: int, k: int, shortest: int, longest: int, intervals: Sequence[tuple[int, int]] | Timeline) -> list[int]:
    """The k + 1 boundaries of the best split of [0, n) into k chunks of shortest..longest units."""
    if min(n, k, shortest) < 1 or not k * shortest <= n <= k * longest:
        raise InfeasibleError(f"{n} units cannot be split into {k} chunks of {shortest} to {longest}")
    timeline = intervals if isinstance(intervals, Timeline) else Timeline(n, intervals)
    if k == 1:
        return [0, n]
    before, hard = timeline.before, timeline.hard
    if before[-1] == 0:
        return [0, *(max(i * shortest, n - (k - i) * longest) for i in range(1, k)), n]
    span = [(max(i * shortest, n - (k - i) * longest), min(i * longest, n - (k - i) * shortest)) for i in range(k + 1)]
    if k * n * (longest - shortest + 1) <= SMALL:
        return _small_boundaries(before.tolist(), hard.astype(int).tolist(), span, shortest, longest)

    def fewest_cuts(cap: int) -> int:
        """Fewest hard cuts of any split whose loads stay within ``cap``."""
        after = np.array([0], np.int64)
        for i in range(k - 1, -1, -1):
            lo, hi = span[i]
            nlo, nhi = span[i + 1]
            starts = np.arange(lo, hi + 1)
            upto = np.searchsorted(before, before[starts] + cap, side="right") - 1  # the last end within the cap
            begin, end = np.maximum(starts + shortest, nlo), np.minimum(np.minimum(starts + longest, nhi), upto)
            cost = after + hard[nlo : nhi + 1] if i < k - 1 else after
            after = _range_minimum(np.minimum(cost, _FAR))(begin - nlo, end - nlo + 1)
        return int(after[0])

    least = fewest_cuts(int(before[-1]))
    lo, hi = -(-int(before[-1]) // k) - 1, int(before[-1])
    while hi - lo > 1:  # lo is infeasible, hi feasible
        mid = (lo + hi) // 2
        if fewest_cuts(mid) <= least:
            hi = mid
        else:
            lo = mid
    cap = hi
    # value[i][x, h]: smallest sum of squares from boundary x of stage i with h hard cuts left.
    width = longest - shortest + 1
    value = [np.zeros((0, 0))] * (k + 1)
    value[k] = np.full((1, least + 1), _FAR, np.int64)
    value[k][0, 0] = 0
    for i in range(k - 1, -1, -1):
        lo, hi = span[i]
        nlo, nhi = span[i + 1]
        ends = slice(nlo - (lo + shortest), nhi - (lo + shortest) + 1)  # of the windows of all starts
        best = np.empty((hi - lo + 1, least + 1), np.int64)
        room = hi - lo + width
        load = np.full(room, before[-1], np.int64)
        load[: max(0, min(room, n + 1 - lo - shortest))] = before[lo + shortest : lo + shortest + room]
        load = np.lib.stride_tricks.sliding_window_view(load, width) - before[lo : hi + 1, None]
        square, over = load * load, load > cap
        for h in range(least + 1):
            rest = value[i + 1][:, h]
            if i < k - 1:
                cut = hard[nlo : nhi + 1]
                rest = np.where(cut, value[i + 1][:, h - 1] if h else _FAR, rest)
            row = np.full(room, _FAR, np.int64)
            first, last = max(ends.start, 0), min(ends.stop, room)
            row[first:last] = rest[first - ends.start : last - ends.start]
            total = square + np.lib.stride_tricks.sliding_window_view(row, width)
            total[over] = _FAR
            best[:, h] = total.min(axis=1)
        value[i] = np.minimum(best, _FAR)
    out, cuts = [0], least
    for i in range(k):
        s, target = out[-1], value[i][out[-1] - span[i][0], cuts]
        nlo, nhi = span[i + 1]
        for e in range(max(s + shortest, nlo), min(s + longest, nhi) + 1):
            load = int(before[e] - before[s])
            used = int(hard[e]) if i < k - 1 else 0
            if load <= cap and used <= cuts and value[i + 1][e - nlo, cuts - used] + load * load == target:
                out.append(e)
                cuts -= used
                break
    return out


def _small_boundaries(before: list[int], hard: list[int], span: list[tuple[int, int]], shortest: int, longest: int) -> list[int]:
    """The same choice for a short recording, boundary by boundary."""
    k, far = len(span) - 1, int(_FAR)
    cuts_at = [hard if i < k else [0] * len(hard) for i in range(k + 1)]  # the end of the recording is no cut

    def ends(i: int, s: int) -> range:
        return range(max(s + shortest, span[i + 1][0]), min(s + longest, span[i + 1][1]) + 1)

    def fewest_cuts(cap: int) -> int:
        after = {span[k][0]: 0}
        for i in range(k - 1, -1, -1):
            now = {}
            for s in range(span[i][0], span[i][1] + 1):
                now[s] = min((after[e] + cuts_at[i + 1][e] for e in ends(i, s) if before[e] - before[s] <= cap), default=far)
            after = now
        return after[0]

    least = fewest_cuts(before[-1])
    lo, hi = -(-before[-1] // k) - 1, before[-1]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if fewest_cuts(mid) <= least else (mid, hi)
    # value[s, h]: smallest sum of squares from boundary s of a stage with h hard cuts left, and the earliest next boundary.
    value = {(span[k][0], 0): (0, 0)}
    steps = []
    for i in range(k - 1, -1, -1):
        now = {}
        for s in range(span[i][0], span[i][1] + 1):
            for h in range(least + 1):
                best = (far, 0)
                for e in ends(i, s):
                    load = before[e] - before[s]
                    rest = value.get((e, h - cuts_at[i + 1][e]))
                    if load <= hi and rest is not None and rest[0] + load * load < best[0]:
                        best = (rest[0] + load * load, e)
                if best[0] < far:
                    now[s, h] = best
        value = now
        steps.append(now)
    out, cuts = [0], least
    for i, step in enumerate(reversed(steps)):
        out.append(step[out[-1], cuts][1])
        cuts -= cuts_at[i + 1][out[-1]]
    return out


def layout_of(n: int, boundaries: Sequence[int], intervals: Sequence[tuple[int, int]] | Timeline) -> list[tuple[int, int, int, str, int]]:
    """(idx, s, e, boundary kind, load) of each chunk."""
    timeline = intervals if isinstance(intervals, Timeline) else Timeline(n, intervals)
    before, inside = timeline.before, timeline.inside
    out = []
    for i, (s, e) in enumerate(zip(boundaries, boundaries[1:], strict=False)):
        kind = "audio_end" if e == n else "hard" if inside[e] else "silence"
        out.append((i, int(s), int(e), kind, int(before[e] - before[s])))
    return out


def candidate_counts(n: int, shortest: int, longest: int, group: int, strategy: str = "full") -> list[int]:
    """Legal chunk counts to try; see ``metrics.chunk_counts``."""
    if group < 1:
        raise ValueError("group must be positive")
    if n < 1:
        raise ValueError("nothing to split")
    if n < shortest:
        return [1]
    low, high = -(-n // longest), n // shortest
    if low > high:
        raise InfeasibleError("no chunk count is legal")
    found = [c for c in range(-(-low // group) * group, high + 1, group) if c]
    if strategy == "divisible":
        return found
    if strategy == "full":
        return found or [high]
    raise ValueError(f"unknown strategy {strategy!r}")


def plan_chunks(n: int, intervals: Sequence[tuple[int, int]], *, shortest: int, longest: int, group: int = 1, strategy: str = "full", count: int | None = None) -> list[tuple[int, int, int, str, int]]:
    """The best layout over all candidate counts.

    Counts rank by hard cuts, batches of ``group``, maximum load, relative
    squared error of the loads (as an exact ratio), boundaries; the first count
    without a hard cut ends the search.
    """
    from fractions import Fraction

    counts = [count] if count is not None else candidate_counts(n, shortest, longest, group, strategy)
    timeline = Timeline(n, intervals)
    ranked = []
    for k in counts:
        bounds = [0, n] if k == 1 and n < shortest else optimal_boundaries(n, k, shortest, longest, timeline)
        chunks = layout_of(n, bounds, timeline)
        loads = [c[4] for c in chunks]
        total = sum(loads)
        error = Fraction(k * sum(x * x for x in loads) - total * total, total * total) if total else Fraction(0)
        cuts = sum(c[3] == "hard" for c in chunks)
        ranked.append(((cuts, -(-k // group), max(loads), error, tuple(bounds)), chunks))
        if cuts == 0:
            break
    if not ranked:
        raise InfeasibleError("no candidate count")
    return min(ranked, key=lambda r: r[0])[1]


LAYOUT = [
    T.StructField("idx", T.IntegerType()), T.StructField("s", T.LongType()), T.StructField("e", T.LongType()),
    T.StructField("boundary", T.StringType()), T.StructField("speech", T.LongType()), T.StructField("error", T.StringType()),
]


def plan_recordings(intervals: DataFrame, keys: Sequence[str], length: str, *, shortest: int, longest: int, group: int = 4, strategy: str = "full", count: int | None = None) -> DataFrame:
    """The layout of each key's recording, from its intervals (s, e) and its ``length`` column.

    Intervals that overlap are merged before they are grouped (those that only
    touch are not, as a cut between them is no hard one), so a group holds at
    most as many rows as the recording has units, however many intervals it came
    with.  A recording that cannot be split, or with an interval that ends before
    it starts, gives one row with ``error`` and nothing else.
    """
    whole = [*keys, length]
    clamped = lambda c: F.greatest(F.lit(0).cast("long"), F.least(F.col(length).cast("long"), F.col(c).cast("long")))
    rows = intervals.select(*whole, clamped("s").alias("s"), clamped("e").alias("e"))
    merged = union(normalize(rows), whole, bucket=longest, gap=-1)
    reversed_ = F.coalesce(F.bool_or(F.col("e") < F.col("s")), F.lit(False)).alias("reversed")
    spans = merged.groupBy(*whole).agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans"))
    recordings = rows.groupBy(*whole).agg(reversed_).join(spans, whole, "left").select(*keys, F.col(length).cast("long").alias("n"), "reversed", "spans")
    schema = T.StructType([intervals.schema[k] for k in keys] + LAYOUT)
    n_keys = len(keys)

    def plan(n: int, is_reversed: bool, found: list) -> list[tuple]:
        try:
            if is_reversed:
                raise ValueError("an interval ends before it starts")
            chunks = plan_chunks(n, [(r["s"], r["e"]) for r in found or []], shortest=shortest, longest=longest, group=group, strategy=strategy, count=count)
            return [(*c, None) for c in chunks]
        except ValueError as e:
            return [(None, None, None, None, None, str(e))]

    def run(batches):
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            planned = [plan(*row) for row in zip(*(c.to_pylist() for c in batch.columns[n_keys:]), strict=True)]
            owner = pa.array([i for i, chunks in enumerate(planned) for _ in chunks], pa.int64())
            columns = list(zip(*(c for chunks in planned for c in chunks), strict=True)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([c.take(owner) for c in batch.columns[:n_keys]] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schema.fieldNames())

    return recordings.mapInArrow(run, schema)
