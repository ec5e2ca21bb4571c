import bisect
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tempora.llm import packing, registry


def sequential_best_fit(lengths, capacity):
    """Bins used by the plain algorithm, one piece at a time."""
    open_bins, n = [], 0
    for length in sorted(lengths, reverse=True):
        i = bisect.bisect_left(open_bins, length)
        left = open_bins.pop(i) if i < len(open_bins) else capacity
        n += left == capacity
        if left > length:
            bisect.insort(open_bins, left - length)
    return n


def places(plan, lengths):
    seen, out = Counter(), []
    for length in lengths:
        rank = seen[length]
        seen[length] += 1
        row = [r for r in plan.tolist() if r[0] == length and r[1] <= rank][-1]
        nth = rank - row[1]
        out.append((row[2] + nth // row[3], row[4] + nth % row[3] * length, length))
    return out


@settings(max_examples=150, deadline=None)
@given(st.integers(3, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=150))))
def test_plan_is_best_fit_decreasing(case):
    capacity, lengths = case
    plan = packing.plan_best_fit(Counter(lengths), capacity)
    bins = defaultdict(list)
    for b, offset, length in places(plan, lengths):
        bins[b].append((offset, length))
    assert len(bins) == sequential_best_fit(lengths, capacity)
    for rows in bins.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= capacity


def test_tree_finds_the_tightest():
    rng = random.Random(1)
    tree, held = packing.CapacityTree(100), set()
    for _ in range(500):
        c = rng.randint(1, 100)
        held.symmetric_difference_update({c})
        tree.put(c, c in held)
        least = rng.randint(1, 100)
        assert tree.tightest(least) == min((x for x in held if x >= least), default=-1)


TRICKY = ["", "Ça É İı ſ K x\x1cy it's don't '' x.'s we'll. Σας ΑΣ 12ab. ½ ..., foo... 　z \x85q", "<|endoftext|> a <|ENDOFTEXT|>", "é, ﬁ. ́a \n\r\t.", "日本。テスト., x", "a" * 5000, "Ǆ. ǅ, ß ẞ"]


def test_word_cache_gives_the_tokenizers_ids():
    from tokenizers import Tokenizer

    path = registry.tokenizer_path()
    whole, mine = Tokenizer.from_file(path), packing.encoder(path)
    rng = random.Random(2)
    alphabet = "abzÀéß .,'!?0\n Σ中<|>-"
    texts = TRICKY + ["".join(rng.choice(alphabet) for _ in range(60)) for _ in range(500)]
    for text, want in zip(texts, whole.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == want.ids, text
    assert mine.encode(None) == b""


def test_ids_do_not_depend_on_what_was_seen_before():
    """Bare words first, then with a mark, and the other way round: always the tokenizer's ids."""
    from tokenizers import Tokenizer

    path = registry.tokenizer_path()
    whole = Tokenizer.from_file(path)
    rng = random.Random(6)
    alphabet = ["a", "b", "Z", "é", "É", "ß", "İ", "ı", "ﬁ", "ǅ", "Å", "9", "-", "中", "ग", "ढ", "़", *map(chr, range(0x958, 0x960))]
    bare = ["İ", "ABİ", "गढ़", *("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 5))) for _ in range(4000))]
    words = [w + mark for w in bare for mark in ("", ".", ",", "..", ".,")]
    want = {w: np.asarray(e.ids, "<u4").tobytes() for w, e in zip(words, whole.encode_batch(words, add_special_tokens=False), strict=True)}
    for order in (words, words[::-1]):
        mine = packing.WordEncoder(path)
        assert [w for w in order if mine.encode(w) != want[w]] == []


def test_documents_are_packed_whole(documents):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(registry.tokenizer_path())
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["the", "ab", "zq"]) for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(60, None), (61, ""), (62, "the " * 200), (7, "again"), (7, "again"), (None, "x")]
    out = packing.pack_best_fit(documents(rows, piece=3, sequence_id="clash"), registry.tokenizer_path(), capacity=32).collect()
    want = Counter()
    for i, t in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 32)):
            want[(i, k, at, tuple(ids[at : at + 32]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, tuple(np.frombuffer(bytes(r.ids), "<u4").tolist())) for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    assert len(bins) == sequential_best_fit([r.length for r in out], 32)
    for rows in bins.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 32


def test_empty_table(documents):
    assert packing.pack_best_fit(documents([]), registry.tokenizer_path()).collect() == []


def test_query_digests(spark, documents, folder):
    sf = folder(documents=documents([(1, "the cat"), (2, None)]))
    got = {r.doc_id: r for r in registry.op1_pack_best_fit(spark, sf).collect()}
    assert got[2].length == 1 and got[2].ids_crc32 == zlib.crc32(np.array([1], "<u4").tobytes())


@pytest.mark.parametrize("capacity", [1, 2])
def test_tiny_capacity(documents, capacity):
    out = packing.pack_best_fit(documents([(1, "the cat sat")]), registry.tokenizer_path(), capacity=capacity).collect()
    assert sum(r.length for r in out) == 4 and max(r.length for r in out) <= capacity


def test_shuffled_ranks_give_the_same_packing(documents, monkeypatch):
    rows = [(i, "the " * (i % 17)) for i in range(120)]
    pack = lambda: sorted(tuple(r)[:4] + tuple(r)[5:] for r in packing.pack_best_fit(documents(rows).repartition(5), registry.tokenizer_path(), capacity=16).collect())
    monkeypatch.setattr(packing, "BROADCAST_BYTES", -1)
    out = pack()
    bins = defaultdict(int)
    for *_, length, sequence, _ in out:
        bins[sequence] += length
    assert len(out) >= 120 and max(bins.values()) <= 16
    assert len(bins) == sequential_best_fit([r[3] for r in out], 16)
