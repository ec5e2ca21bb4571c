"""Interval algebra on integer axes.

An interval is a pair of columns ``s`` and ``e``, half open.  Operators work per
``keys`` and keep one shuffle by the keys; ``union`` can pre-aggregate by
buckets of the axis, so a key with a large share of all rows never meets in
one task before it has been reduced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]


def normalize(df: DataFrame, lo=None, hi=None) -> DataFrame:
    """Intervals clamped to [lo, hi), empty ones dropped."""
    s = F.col("s") if lo is None else F.greatest(F.col("s"), F.lit(lo))
    e = F.col("e") if hi is None else F.least(F.col("e"), F.lit(hi))
    return df.withColumns({"s": s, "e": e}).where("e > s")


def union(df: DataFrame, keys: Keys, *, bucket: int | None = None, gap: int = 0) -> DataFrame:
    """Maximal intervals per key; those that touch merge.

    ``gap`` is the largest distance that still merges: 0 for half-open
    intervals, 1 for closed integer ranges, -1 where only overlapping ones do.  With ``bucket``, intervals that
    start in the same bucket of the axis merge first.
    """
    if bucket is not None:
        parted = df.withColumn("__b", F.floor(F.col("s") / bucket))
        df = _islands(parted, [*keys, "__b"], gap)
    return _islands(df, keys, gap).select(*keys, "s", "e")


def _islands(df: DataFrame, keys: Keys, gap: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("__new", F.when(F.col("s") <= reach + gap, 0).otherwise(1))
    numbered = marked.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__island").agg(F.min("s").alias("s"), F.max("e").alias("e"))


def gaps(islands: DataFrame, keys: Keys, lo=None, hi=None) -> DataFrame:
    """The complement of disjoint intervals between ``lo`` and ``hi``.

    Columns or literals; without them only the gaps between a key's intervals
    are given.
    """
    order = Window.partitionBy(*keys).orderBy("s")
    start = F.lag("e").over(order)
    if lo is not None:
        start = F.coalesce(start, lo if not isinstance(lo, int) else F.lit(lo))
    head = islands.select(*keys, start.alias("__s"), F.col("s").alias("__e"))
    if hi is not None:
        last = islands.groupBy(*keys).agg(F.max("e").alias("__s"))
        head = head.unionByName(last.withColumn("__e", hi if not isinstance(hi, int) else F.lit(hi)))
    return head.where("__e > __s").select(*keys, F.col("__s").alias("s"), F.col("__e").alias("e"))


def mirror(df: DataFrame, length) -> DataFrame:
    """Intervals with the axis reversed: [length - e, length - s)."""
    length = F.lit(length) if isinstance(length, int) else length
    return df.withColumns({"s": length - F.col("e"), "e": length - F.col("s")})


def split_by_bucket(df: DataFrame, bucket: int, name: str = "bucket") -> DataFrame:
    """Each interval clipped to every bucket of the axis that it meets.  Expects non-empty intervals."""
    cells = df.withColumn(name, F.explode(F.sequence(F.floor(F.col("s") / bucket), F.floor((F.col("e") - 1) / bucket))))
    lo = F.col(name) * bucket
    return cells.withColumns({"s": F.greatest(F.col("s"), lo), "e": F.least(F.col("e"), lo + bucket)})


def measure(df: DataFrame, keys: Keys, name: str = "total") -> DataFrame:
    """Total length per key; of disjoint intervals, their measure."""
    return df.groupBy(*keys).agg(F.sum(F.col("e") - F.col("s")).alias(name))


def intersect(a: DataFrame, b: DataFrame, keys: Keys, bucket: int) -> DataFrame:
    """Pairwise intersections of two sets of disjoint intervals.

    Both sides are cut into buckets, so the overlap join is an equi-join on
    keys and bucket and Catalyst can shuffle it; pieces that were cut at a
    bucket's edge are merged again.
    """
    left = split_by_bucket(a.select(*keys, "s", "e", F.col("s").alias("__as"), F.col("e").alias("__ae")), bucket, "__b")
    right = split_by_bucket(b.select(*keys, "s", "e", F.col("s").alias("__bs"), F.col("e").alias("__be")), bucket, "__b")
    right = right.select(*keys, "__b", F.col("s").alias("__s2"), F.col("e").alias("__e2"), "__bs", "__be")
    joined = left.join(right, [*keys, "__b"]).where("s < __e2 AND __s2 < e")
    whole = joined.select(*keys, F.greatest("__as", "__bs").alias("s"), F.least("__ae", "__be").alias("e"))
    return whole.distinct()


def with_prefix(islands: DataFrame, keys: Keys, name: str = "before", *, bucket: int | None = None) -> DataFrame:
    """Disjoint intervals with the measure of those before each.

    With ``bucket``, intervals are ordered within buckets of the axis and only
    one sum per bucket is ordered per key, so a key of any size is dealt over
    many tasks; keys must then not be null.
    """
    size = F.col("e") - F.col("s")
    sums = lambda by, order, x: F.coalesce(F.sum(x).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    if bucket is None:
        return islands.withColumn(name, sums(keys, "s", size))
    cell = [*keys, "__b"]
    cut = islands.withColumn("__b", F.floor(F.col("s") / bucket))
    cells = cut.groupBy(*cell).agg(F.sum(size).alias("__m")).withColumn("__earlier", sums(keys, "__b", F.col("__m"))).drop("__m")
    inside = cut.withColumn("__inside", sums(cell, "s", size)).join(cells, cell)
    return inside.select(*islands.columns, (F.col("__inside") + F.col("__earlier")).alias(name))


def first_length(islands: DataFrame, keys: Keys, limit: int, *, bucket: int | None = None) -> DataFrame:
    """The first ``limit`` units of a key's intervals, the last one cut."""
    left = F.greatest(F.lit(0).cast("long"), F.lit(limit) - F.col("__before"))
    cut = with_prefix(islands, keys, "__before", bucket=bucket).withColumn("e", F.col("s") + F.least(F.col("e") - F.col("s"), left))
    return cut.where("e > s").drop("__before")


def _as_of(points: DataFrame, rows: DataFrame, keys: Keys, point: str, at: str, values: Sequence[str], bucket: int | None = None) -> DataFrame:
    """For each point the values of the last row with ``at`` <= point: one union and one window.

    With ``bucket``, the window covers a bucket of the axis, and what the
    earlier buckets end with is carried on by one row per bucket.
    """
    found = F.struct(*[F.col(v) for v in values])
    left = points.select(*points.columns, F.col(point).alias("__t"), F.lit(1).alias("__kind"), F.lit(None).cast(rows.select(found).schema[0].dataType).alias("__row"))
    mine = [F.col(k) if k in keys else F.lit(None).cast(points.schema[k].dataType).alias(k) for k in points.columns]
    right = rows.select(*mine, F.col(at).alias("__t"), F.lit(0).alias("__kind"), found.alias("__row"))
    both = left.unionByName(right)
    cell = list(keys)
    if bucket is not None:
        cell.append("__b")
        both = both.withColumn("__b", F.floor(F.col("__t") / bucket))
    order = Window.partitionBy(*cell).orderBy("__t", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("__row", F.last("__row", ignorenulls=True).over(order)).where("__kind = 1")
    if bucket is not None:
        ends = both.groupBy(*cell).agg(F.max_by("__row", F.when(F.col("__kind") == 0, F.col("__t"))).alias("__end"))
        earlier = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.withColumn("__carried", F.last("__end", ignorenulls=True).over(earlier)).drop("__end")
        filled = filled.join(carried, cell).withColumn("__row", F.coalesce("__row", "__carried"))
    return filled.select(*points.columns, *[F.col(f"__row.{v}").alias(f"__{v}") for v in values])


def measure_before(points: DataFrame, islands: DataFrame, keys: Keys, point: str = "x", name: str = "measure", *, bucket: int | None = None) -> DataFrame:
    """The measure of a key's disjoint intervals before each point (0 without any)."""
    rows = with_prefix(islands, keys, "before", bucket=bucket).select(*keys, "s", "e", "before")
    found = _as_of(points, rows, keys, point, "s", ["s", "e", "before"], bucket)
    inside = F.least(F.col(point), F.col("__e")) - F.col("__s")
    return found.select(*points.columns, F.coalesce(F.col("__before") + inside, F.lit(0).cast("long")).alias(name))


def is_inside(points: DataFrame, islands: DataFrame, keys: Keys, point: str = "x", name: str = "inside", *, bucket: int | None = None) -> DataFrame:
    """Whether each point lies strictly inside an interval of its key."""
    found = _as_of(points, islands.select(*keys, "s", "e"), keys, point, "s", ["s", "e"], bucket)
    inner = (F.col("__s") < F.col(point)) & (F.col(point) < F.col("__e"))
    # A point on the start of an interval is inside none: disjoint intervals end before it.
    return found.select(*points.columns, F.coalesce(inner, F.lit(False)).alias(name))


def coordinate_at(points: DataFrame, islands: DataFrame, keys: Keys, amount: str = "amount", name: str = "coordinate", *, bucket: int | None = None) -> DataFrame:
    """The earliest coordinate with at least ``amount`` of the measure before it.

    Null beyond the total; amounts of zero or less give the coordinate 0.
    """
    rows = with_prefix(islands, keys, "before", bucket=bucket).select(*keys, "s", "e", "before")
    rows = rows.withColumn("from_amount", F.col("before") + 1)
    found = _as_of(points, rows, keys, amount, "from_amount", ["s", "e", "before"], bucket)
    at = F.col("__s") + F.col(amount) - F.col("__before")
    value = F.when(F.col(amount) <= 0, F.lit(0).cast("long")).when(at <= F.col("__e"), at)
    return found.select(*points.columns, value.alias(name))


def latest_coordinate_at(points: DataFrame, islands: DataFrame, keys: Keys, end, amount: str = "amount", name: str = "coordinate", *, bucket: int | None = None) -> DataFrame:
    """The latest coordinate up to ``end`` with at most ``amount`` of the measure before it."""
    end = F.lit(end) if isinstance(end, int) else end
    rows = with_prefix(islands, keys, "before", bucket=bucket).select(*keys, "s", "e", "before")
    found = _as_of(points, rows, keys, amount, "before", ["s", "e", "before"], bucket)
    at = F.col("__s") + F.col(amount) - F.col("__before")
    value = F.when(F.col(amount) < 0, F.lit(None).cast("long")).when(at < F.col("__e"), at).otherwise(end)
    return found.select(*points.columns, value.alias(name))


def sessions(df: DataFrame, keys: Keys, max_gap: int, *, bucket: int | None = None) -> DataFrame:
    """Rows with ``session``, a number that rises where a row starts more than ``max_gap`` after the one before ended.

    With ``bucket``, rows are ordered within buckets of the axis, and only one
    row per bucket is ordered per key, so a key of any size is dealt over many
    tasks; keys must then not be null.
    """
    new = lambda e: F.when(F.col("s") - e > max_gap, 1).otherwise(0)
    running = lambda w: F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    if bucket is None:
        order = Window.partitionBy(*keys).orderBy("s", "e")
        return df.withColumn("__new", new(F.lag("e").over(order))).withColumn("session", running(order)).drop("__new")
    cell = [*keys, "__b"]
    order = Window.partitionBy(*cell).orderBy("s", "e")
    marked = df.withColumn("__b", F.floor(F.col("s") / bucket)).withColumn("__new", new(F.lag("e").over(order))).withColumn("__seen", running(order))
    cells = marked.groupBy(*cell).agg(F.min("s").alias("s"), F.max_by("e", F.struct("s", "e")).alias("__e"), F.sum("__new").alias("__n"))
    by_key = Window.partitionBy(*keys).orderBy("__b")
    cells = cells.withColumn("__first", new(F.lag("__e").over(by_key)))
    earlier = F.sum(F.col("__n") + F.col("__first")).over(by_key.rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select(*cell, (F.coalesce(earlier, F.lit(0)) + F.col("__first")).alias("__before"))
    return marked.join(cells, cell).withColumn("session", F.col("__seen") + F.col("__before")).select(*df.columns, "session")


def structure_violation(df: DataFrame, keys: Keys, length) -> DataFrame:
    """``violation`` for each interval: negative, empty, past_end, or overlap with the one before (adjacent is fine)."""
    length = F.lit(length) if isinstance(length, int) else length
    order = Window.partitionBy(*keys).orderBy("pos") if "pos" in df.columns else Window.partitionBy(*keys).orderBy("s", "e")
    bad = (
        F.when(F.col("s").isNull() | F.col("e").isNull(), "missing")
        .when(F.col("s") < 0, "negative")
        .when(F.col("e") <= F.col("s"), "empty")
        .when(F.col("e") > length, "past_end")
        .when(F.col("s") < F.lag("e", 1, 0).over(order), "overlap")
    )
    return df.withColumn("violation", bad)
