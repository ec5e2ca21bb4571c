import random

from pyspark.sql import functions as F

from tempora.operators import intervals as I

KEYS = ["k"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k int, s long, e long")


def pairs(df):
    return sorted((r.k, r.s, r.e) for r in df.collect())


def merged(rows, gap=0):
    out = []
    for k, s, e in sorted(rows):
        if out and out[-1][0] == k and s <= out[-1][2] + gap:
            out[-1] = (k, out[-1][1], max(out[-1][2], e))
        else:
            out.append((k, s, e))
    return sorted(out)


def some(seed, n=200):
    rng = random.Random(seed)
    return [(rng.randint(0, 5), s := rng.randint(0, 400), s + rng.randint(1, 12)) for _ in range(n)]


def test_union_merges_touching_and_equals_brute_force(spark):
    rows = [(1, 0, 2), (1, 2, 4), (1, 5, 6)]
    assert pairs(I.union(frame(spark, rows), KEYS)) == [(1, 0, 4), (1, 5, 6)]
    assert pairs(I.union(frame(spark, rows), KEYS, gap=1)) == [(1, 0, 6)]
    rows = some(1)
    assert pairs(I.union(frame(spark, rows), KEYS)) == merged(rows)
    assert pairs(I.union(frame(spark, rows), KEYS, bucket=50)) == merged(rows)


def test_empty_table(spark):
    empty = frame(spark, [])
    assert pairs(I.union(empty, KEYS, bucket=10)) == []
    assert pairs(I.gaps(empty, KEYS)) == []


def test_normalize_clamps_and_drops_empty(spark):
    assert pairs(I.normalize(frame(spark, [(1, -3, 2), (1, 5, 5), (1, 8, 30), (1, 12, 20)]), 0, 10)) == [(1, 0, 2), (1, 8, 10)]


def test_gaps_with_head_and_tail(spark):
    islands = frame(spark, [(1, 2, 4), (1, 6, 10)])
    assert pairs(I.gaps(islands, KEYS)) == [(1, 4, 6)]
    assert pairs(I.gaps(islands, KEYS, 0, 12)) == [(1, 0, 2), (1, 4, 6), (1, 10, 12)]


def test_mirror_twice_is_the_same(spark):
    rows = [(1, 2, 4), (1, 6, 10)]
    assert pairs(I.mirror(I.mirror(frame(spark, rows), 12), 12)) == rows


def test_intersect_equals_brute_force(spark):
    a, b = merged(some(2)), merged(some(3))
    want = sorted((k, max(s, s2), min(e, e2)) for k, s, e in a for k2, s2, e2 in b if k == k2 and s < e2 and s2 < e)
    assert pairs(I.intersect(frame(spark, a), frame(spark, b), KEYS, 16)) == want


def test_measures_at_points(spark):
    islands = merged(some(4))
    speech = {k: {x for kk, s, e in islands if kk == k for x in range(s, e)} for k in range(6)}
    points = spark.createDataFrame([(k, x) for k in range(7) for x in range(0, 430, 7)], "k int, x long")
    isl = frame(spark, islands)
    for r in I.measure_before(points, isl, KEYS).collect():
        assert r.measure == sum(y < r.x for y in speech.get(r.k, ()))
    for r in I.is_inside(points, isl, KEYS).collect():
        assert r.inside == (r.x in speech.get(r.k, ()) and r.x - 1 in speech.get(r.k, ()))
    amounts = points.withColumnRenamed("x", "amount")
    for r in I.coordinate_at(amounts, isl, KEYS).collect():
        want = next((x for x in range(0, 500) if sum(y < x for y in speech.get(r.k, ())) >= r.amount), None)
        assert r.coordinate == want
    for r in I.latest_coordinate_at(amounts, isl, KEYS, 500).collect():
        want = max((x for x in range(0, 501) if sum(y < x for y in speech.get(r.k, ())) <= r.amount), default=None)
        assert r.coordinate == want, r


def test_first_length_cuts_the_last(spark):
    got = pairs(I.first_length(frame(spark, [(1, 0, 4), (1, 6, 10), (1, 20, 30)]), KEYS, 6))
    assert got == [(1, 0, 4), (1, 6, 8)]


def test_sessions_split_above_the_gap(spark):
    rows = I.sessions(frame(spark, [(1, 0, 1), (1, 6, 7), (1, 13, 14)]), KEYS, 5).orderBy("s").collect()
    assert [r.session for r in rows] == [0, 0, 1]


def test_sessions_by_bucket_are_the_same(spark):
    df = frame(spark, some(6, 300))
    plain = sorted(tuple(r) for r in I.sessions(df, KEYS, 3).collect())
    for bucket in (7, 50, 1000):
        assert sorted(tuple(r) for r in I.sessions(df, KEYS, 3, bucket=bucket).collect()) == plain


def test_structure_violations(spark):
    rows = [("adjacent", 0, 0, 2), ("adjacent", 1, 2, 4), ("negative", 0, -1, 2), ("empty", 0, 2, 2), ("past_end", 0, 2, 5), ("overlap", 0, 0, 3), ("overlap", 1, 2, 4), ("missing", 0, None, 2)]
    df = spark.createDataFrame(rows, "k string, pos int, s long, e long")
    got = {r.k: r.v for r in I.structure_violation(df, KEYS, 4).groupBy("k").agg(F.max("violation").alias("v")).collect()}
    assert got == {"adjacent": None, "negative": "negative", "empty": "empty", "past_end": "past_end", "overlap": "overlap", "missing": "missing"}


def test_buckets_change_nothing(spark):
    """Prefixes, as-of lookups and batches by buckets of the axis equal those by one window for each key."""
    import random

    from tempora.operators import metrics

    rng = random.Random(7)
    spans, points = [], []
    for key in ("a", "b", "c"):
        at = rng.randint(-30, 0)
        for _ in range(40):
            at += rng.randint(1, 25)
            end = at + rng.randint(1, 30)
            spans.append((key, at, end))
            at = end
        points += [(key, i, rng.randint(-40, 1800)) for i in range(60)]
    points += [("none", 0, 5)]
    islands = spark.createDataFrame(spans, "k string, s long, e long")
    asked = spark.createDataFrame(points, "k string, i long, x long")
    same = lambda f: sorted(map(tuple, f(None).collect()), key=repr) == sorted(map(tuple, f(10).collect()), key=repr) == sorted(map(tuple, f(10_000).collect()), key=repr)
    assert same(lambda b: I.with_prefix(islands, ["k"], bucket=b))
    assert same(lambda b: I.first_length(islands, ["k"], 100, bucket=b))
    assert same(lambda b: I.measure_before(asked, islands, ["k"], bucket=b))
    assert same(lambda b: I.is_inside(asked, islands, ["k"], bucket=b))
    assert same(lambda b: I.coordinate_at(asked, islands, ["k"], "x", bucket=b))
    assert same(lambda b: I.latest_coordinate_at(asked, islands, ["k"], 5000, "x", bucket=b))
    assert same(lambda b: metrics.batches(asked, ["k"], ["x", "i"], bucket=b))
