import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tempora.llm import registry, simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=4):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    a = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= radius):
            x, y = find(i), find(int(i + 1 + j))
            parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_hash_is_sparks_own(spark):
    text = "héllo wörld x y"
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] % 2**64 == xxhash.xxh64_intdigest(text.encode(), 42)


@pytest.mark.parametrize("text", [None, "", " \n", "One", "A b C", "a b c d", "ÀB\x0bc d e f É g", "a b a b a b a b a b"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def cloud(rng, center, n, most):
    out = set()
    for _ in range(n):
        x = center
        for b in rng.sample(range(64), rng.randint(0, most)):
            x ^= 1 << b
        out.add(x)
    return out


@pytest.mark.parametrize("bucket_rows", [1024, 60])
def test_components_equal_brute_force(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", bucket_rows)
    rng = random.Random(6)
    fps = {0, 1, 31, 63 << 20} | {rng.getrandbits(64) for _ in range(150)}
    for _ in range(3):
        fps |= cloud(rng, rng.getrandbits(64), 220, 7)
    fps = sorted(fps)
    labels = {r.node % 2**64: r.label for r in simhash.link_fingerprints(spark.createDataFrame([(signed(x),) for x in fps], "fp long")).collect()}
    groups, mine = {}, {}
    for x, c in zip(fps, brute_components(fps), strict=True):
        groups.setdefault(c, []).append(x)
        mine.setdefault(labels.get(x, ("alone", x)), []).append(x)
    assert sorted(groups.values()) == sorted(sorted(v) for v in mine.values())


@pytest.mark.parametrize("blocks", [5, 6, 7, 8])
def test_every_link_shares_a_choice_of_blocks(blocks):
    rng = random.Random(blocks)
    masks = simhash.block_masks(blocks, 4)
    for _ in range(200):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 4):
            y ^= 1 << b
        assert any((signed(x) & m) == (signed(y) & m) for m in masks)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4])
def test_bit_sliced_distances(radius):
    rng = random.Random(radius)
    fps = np.array(sorted(cloud(rng, rng.getrandbits(64), 150, 6)), np.uint64)
    label = simhash.links_within(fps, np.array([0]), np.array([len(fps)]), radius)
    assert label.tolist() == brute_components(fps.tolist(), radius)


def test_chain_contracts(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 103), (103, 101), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in simhash.connect(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 103: 100, 101: 100}


def rows():
    rng = random.Random(8)
    base = [rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randint(0, 50)) for _ in range(300)]
    out = [(i, " ".join([*base[:k], f"new{i}", *base[k:]])) for i, k in enumerate(range(0, 300, 25))]
    out += [(100 + i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 12)))) for i in range(40)]
    return out + [(200, None), (201, ""), (202, "  "), (50, "same text here today"), (51, "same text here today"), (51, "same text here today"), (None, "same text here today"), (None, "lonely row of words")]


def expected(data):
    fps = [brute_fingerprint(t) for _, t in data]
    comps = brute_components(fps)
    first = {}
    for c, (i, _) in zip(comps, data, strict=True):
        if i is not None:
            first[c] = min(first.get(c, i), i)
    return sorted(((i, f"{fp:016x}", first.get(c)) for (i, _), fp, c in zip(data, fps, comps, strict=True)), key=repr)


def test_query_equals_brute_force(spark, documents, folder):
    data = rows()
    sf = folder(documents=documents(data, fp=1, component_id="clash"))
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in registry.op5_simhash(spark, sf).collect()), key=repr)
    assert got == expected(data)


def test_one_document_of_each_group_stays(documents):
    data = rows()
    kept = simhash.drop_near_duplicates(documents(data, component_id="clash", __n=5))
    assert kept.columns == documents(data, component_id="clash", __n=5).columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted({c for _, _, c in expected(data) if c is not None})
    assert kept.where("doc_id IS NULL").count() == 2
    twice = [(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (3, "other words are here")]
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(documents(twice)).collect()) == [1, 3]


def test_empty_table(documents):
    assert simhash.near_duplicates(documents([])).collect() == []
    assert simhash.drop_near_duplicates(documents([])).collect() == []
