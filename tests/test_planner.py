import random
from itertools import combinations

import pytest

from tempora.operators import planner as P


def brute(n, k, a, b, intervals):
    before, hard = P.measure_to(n, intervals), P.hard_at(n, intervals)
    best = None
    for inner in combinations(range(1, n), k - 1):
        x = (0, *inner, n)
        if all(a <= q - p <= b for p, q in zip(x, x[1:], strict=False)):
            loads = [int(before[q] - before[p]) for p, q in zip(x, x[1:], strict=False)]
            key = (sum(bool(hard[p]) for p in inner), max(loads), sum(v * v for v in loads), x)
            best = key if best is None else min(best, key)
    return best


def test_ties_go_to_the_earliest_boundary():
    assert P.optimal_boundaries(9, 2, 3, 6, []) == [0, 3, 9]
    assert P.optimal_boundaries(10, 2, 3, 7, [(0, 10)]) == [0, 5, 10]


def test_a_cut_between_touching_intervals_is_silence():
    touching = [(0, 5), (5, 10)]
    assert [c[3] for c in P.layout_of(10, [0, 5, 10], touching)] == ["silence", "audio_end"]
    assert [c[3] for c in P.layout_of(10, [0, 4, 10], touching)] == ["hard", "audio_end"]
    assert [c[3] for c in P.layout_of(10, [0, 5, 10], [(0, 6), (4, 10)])] == ["hard", "audio_end"]


def test_reversed_intervals_are_refused(spark):
    with pytest.raises(ValueError, match="before it starts"):
        P.plan_chunks(8, [(5, 2)], shortest=2, longest=6)
    assert P.plan_chunks(8, [(20, 9)], shortest=2, longest=6) == P.plan_chunks(8, [], shortest=2, longest=6)  # both clamped to the end
    df = spark.createDataFrame([("a", 8, 5, 2), ("a", 8, 0, 1), ("b", 8, 0, 1)], "r string, n long, s long, e long")
    got = P.plan_recordings(df, ["r"], "n", shortest=2, longest=6).collect()
    assert {r.r: r.error is None for r in got} == {"a": False, "b": True}


@pytest.mark.parametrize("small", [0, P.SMALL])
def test_equals_all_combinations(monkeypatch, small):
    monkeypatch.setattr(P, "SMALL", small)
    rng = random.Random(9)
    for _ in range(300):
        n, k, a = rng.randint(2, 14), rng.randint(1, 4), rng.randint(1, 3)
        b = rng.randint(a, 8)
        if not k * a <= n <= k * b:
            with pytest.raises(P.InfeasibleError):
                P.optimal_boundaries(n, k, a, b, [])
            continue
        speech = [tuple(sorted((rng.randint(0, n), rng.randint(0, n)))) for _ in range(rng.randint(0, 3))]
        assert tuple(P.optimal_boundaries(n, k, a, b, speech)) == brute(n, k, a, b, speech)[3]


def test_candidate_counts():
    for n in range(1, 90):
        legal = [c for c in range(1, n + 1) if c * 5 <= n <= c * 13]
        if n < 5:
            assert P.candidate_counts(n, 5, 13, 3) == [1]
        elif legal:
            assert P.candidate_counts(n, 5, 13, 3) == ([c for c in legal if c % 3 == 0] or legal[-1:])


def test_counts_without_multiple():
    assert P.candidate_counts(60, 30, 180, 4, "divisible") == []
    with pytest.raises(P.InfeasibleError):
        P.plan_chunks(60, [], shortest=30, longest=180, group=4, strategy="divisible")
    with pytest.raises(ValueError):
        P.candidate_counts(60, 30, 180, 4, "other")


def test_recordings_are_planned_alone_and_errors_are_rows(spark):
    rows = [("a", 8, 0, 8), ("b", 8, None, None), ("c", 7, 0, 3)]
    df = spark.createDataFrame(rows, "r string, n long, s long, e long")
    got = P.plan_recordings(df, ["r"], "n", shortest=2, longest=6, count=2).orderBy("r", "idx").collect()
    assert [(r.r, r.s, r.e, r.boundary, r.speech) for r in got if r.r == "a"] == [("a", 0, 4, "hard", 4), ("a", 4, 8, "audio_end", 4)]
    assert [(r.s, r.e, r.boundary) for r in got if r.r == "b"] == [(0, 2, "silence"), (2, 8, "audio_end")]
    bad = P.plan_recordings(df, ["r"], "n", shortest=5, longest=6, count=2).collect()
    assert all(r.error and r.idx is None for r in bad) and len(bad) == 3


def test_short_audio_is_one_chunk():
    assert P.plan_chunks(5, [(1, 3)], shortest=30, longest=180) == [(0, 0, 5, "audio_end", 2)]


def test_closed_forms(spark):
    from pyspark.sql import functions as F

    from tempora.operators import layouts as L

    df = spark.createDataFrame([(11, 3)], "n long, k long")
    assert df.select(L.balanced_boundaries(F.col("n"), F.col("k"))).first()[0] == [0, 3, 7, 11]
    assert df.select(L.earliest_boundaries(F.col("n"), F.col("k"), 2, 6)).first()[0] == [0, 2, 5, 11]
    assert P.optimal_boundaries(11, 3, 2, 6, []) == [0, 2, 5, 11]
    assert P.optimal_boundaries(11, 3, 2, 6, [(0, 11)]) == [0, 3, 7, 11]
