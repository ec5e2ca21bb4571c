import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tempora.llm import registry, suffix_dedup
from tempora.llm.sql import ORACLES
from tests.oracle import DATA, duck


def brute(rows, length):
    """(id, bytes, removed runs, kept bytes) of every row."""
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        edge = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                edge[i] += 1
                edge[i + length] -= 1
        gone = np.cumsum(edge)[: len(b)] > 0
        turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(int))).tolist()
        out.append((d, len(b), tuple(zip(turn[::2], turn[1::2], strict=True)), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def run(df, length):
    got = suffix_dedup.remove_repeats(df, length=length).collect()
    return sorted(((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in got), key=repr)


def near_copies(seed):
    rng = random.Random(seed)
    base = "".join(rng.choice("abcdefgh ") for _ in range(300))
    rows = []
    for i in range(80):
        s = list(base[rng.randint(0, 100) : rng.randint(150, 300)])
        for _ in range(rng.randint(0, 6)):
            s[rng.randrange(len(s))] = rng.choice("xyzé")
        noise = lambda: "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 50)))
        rows.append((i, noise() + "".join(s) + noise()))
    return rows + [(300, None), (301, ""), (302, "ab " * 50), (303, "ab " * 50), (304, "a" * 19), (305, "a" * 20), (306, "a" * 21), (307, base), (307, base), (None, base[:100])]


@pytest.mark.parametrize("group_rows", [256, 4])
def test_equals_brute_force(documents, monkeypatch, group_rows):
    monkeypatch.setattr(suffix_dedup, "GROUP_ROWS", group_rows)
    rows = near_copies(1)
    assert run(documents(rows, n_bytes="clash", k1=1), 20) == brute(rows, 20)


def test_overlaps_within_one_document(documents):
    rows = [(1, "abcabcabcabcabcabc"), (2, "xyabcabcxy"), (3, "q" * 30), (4, "no repeats at all here")]
    assert run(documents(rows), 6) == brute(rows, 6)


def test_empty_table(documents):
    assert run(documents([]), 400) == []


def brute_passages(rows, passage):
    """(id, byte spans, words) covered by ``passage`` words that also follow each other in another document."""
    texts = {(i, d, t): (t or "").encode() for i, (d, t) in enumerate(rows)}
    spans = {k: [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)] for k, b in texts.items()}
    owners = defaultdict(set)
    for k, b in texts.items():
        words = [b[x:y] for x, y in spans[k]]
        for i in range(len(words) - passage + 1):
            owners[tuple(words[i : i + passage])].add(k)
    out = []
    for i, (d, t) in enumerate(rows):
        b, at = texts[i, d, t], spans[i, d, t]
        words = [b[x:y] for x, y in at]
        found = [(at[i][0], at[i + passage - 1][1]) for i in range(len(words) - passage + 1) if len(owners[tuple(words[i : i + passage])]) > 1]
        merged = []
        for x, y in found:
            if merged and x <= merged[-1][1]:
                merged[-1][1] = y
            else:
                merged.append([x, y])
        out.append((d, tuple(map(tuple, merged)), sum(len(b[x:y].split()) for x, y in merged)))
    return sorted(out, key=repr)


def passages_of(df, passage):
    got = suffix_dedup.remove_repeats(df, length=400, passage=passage).collect()
    return sorted(((r.doc_id, tuple((s.start, s.end) for s in r.passages), r.n_passage_words) for r in got), key=repr)


@pytest.mark.parametrize("group_rows", [256, 3])
def test_passages_equal_brute_force(documents, monkeypatch, group_rows):
    monkeypatch.setattr(suffix_dedup, "GROUP_ROWS", group_rows)
    rng = random.Random(8)
    words = ["a", "bb", "ccc", "dé", "e" * 300, "f.", "gg"]
    base = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(40):
        a = rng.randint(0, 30)
        part = base[a : a + rng.randint(5, 40)]
        if rng.random() < 0.4:
            part[rng.randrange(len(part))] = "other"
        noise = [rng.choice(words) + str(rng.randint(0, 3)) for _ in range(rng.randint(0, 9))]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join([*noise, *part, *noise[::-1]])))
    rows += [(90, "x y z " * 30), (91, None), (92, ""), (93, rows[0][1]), (94, rows[1][1]), (94, rows[1][1]), (None, rows[2][1]), (95, "all alone " * 9), (95, "all alone " * 9)]
    assert passages_of(documents(rows, lo=1, data="clash"), 8) == brute_passages(rows, 8)


def test_a_passage_under_400_bytes_is_reported_and_stays(documents):
    rng = random.Random(2)
    passage = " ".join(rng.choice(["ab", "cde", "fg", "h"]) + str(rng.randint(0, 99)) for _ in range(55))
    rows = [(1, "one two " + passage + " three"), (2, "four\n" + passage.replace(" ", "\n") + " five six"), (3, "nothing of that kind " * 3 + "end")]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(documents(rows)).collect()}
    assert len(passage.encode()) < 400 and [got[i].n_passage_words for i in (1, 2, 3)] == [55, 55, 0] and not any(r.spans for r in got.values())


def test_query_on_data(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    more = {d: (n, len(spans)) for d, spans, n in brute_passages(docs, 51)}
    want = [(d, n, sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept).hexdigest(), *more[d]) for d, n, runs, kept in brute(docs, 400)]
    got = registry.op8_suffix_dedup(spark, DATA).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    names, rows = duck(ORACLES["op8_suffix_dedup"])
    assert names == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words", "n_passages"] and sorted(rows) == sorted(want)


@pytest.mark.parametrize("part", [100, 700, 1 << 17])
def test_texts_of_any_length_have_the_same_contexts(monkeypatch, part):
    """Together, alone, or part by part: every string is in one context, and equal strings have equal anchors."""
    monkeypatch.setattr(suffix_dedup, "_PART", part)
    monkeypatch.setattr(suffix_dedup, "_hashes", [])
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.choice([0, 3, 39, 40, 300, 900]))).encode() for _ in range(30)]
    texts += [texts[4], b" ".join([b"w%d" % rng.randint(0, 9) for _ in range(400)] + [b"long" * 60]), b"w1\n\nw2\tw3 " * 40, b"w1 w2 w3 " * 40, b""]
    counts, columns = suffix_dedup.contexts(texts, 40, 24, 9, 3)
    assert len(counts) == len(texts) and sum(counts) == len(columns[0])
    owner = np.repeat(np.arange(len(texts)), counts)
    starts, anchors = [Counter() for _ in texts], {}
    for t, first, last, anchor, _, place, tail in zip(owner, *columns, strict=True):
        context = texts[t][first : last + 40]
        if anchor & 1:
            units, length, size = context.split(), 9, 3
            starts[t]["words"] += tail + 1
        else:
            units, length, size = context, 40, 24
            starts[t].update(range(first, last + 1))
        assert len(units) == tail + length and 0 <= place <= tail + length - size
        for i in range(tail + 1):
            key = (anchor & 1, bytes(units[i : i + length]) if not anchor & 1 else tuple(units[i : i + length]))
            assert anchors.setdefault(key, (anchor, place - i)) == (anchor, place - i)
    for t, text in enumerate(texts):
        want = Counter(range(len(text) - 39)) if len(text) >= 40 else Counter()
        words = max(0, len(text.split()) - 8)
        if part > 100 or len(text) < 100:
            assert starts[t] == want + Counter({"words": words} if words else {})
    begin, end, hashes = suffix_dedup.words_in(np.frombuffer(texts[31], np.uint8), texts[31])
    assert [texts[31][a:b] for a, b in zip(begin, end, strict=True)] == texts[31].split() and len(set(hashes.tolist())) == len(set(texts[31].split()))


def test_suffix_order_and_common_prefixes():
    rng = random.Random(5)
    for _ in range(120):
        symbols, group = [], []
        n_groups = rng.randint(1, 4)
        for g in range(n_groups):
            for _ in range(rng.randint(1, 5)):
                s = [rng.randint(2, 4) for _ in range(rng.randint(0, 8))]
                s.insert(rng.randint(0, len(s)), 1)
                symbols.append(np.array(s, np.uint16))
                group.append(g)
        weight = np.array([rng.randint(1, 9) for _ in range(n_groups)])
        owner, size, common = suffix_dedup.suffix_order(symbols, np.array(group), weight)
        want = sorted((group[i], [(int(x), -1) for x in s[len(s) - k :]] + [(0, i)], i, k) for i, s in enumerate(symbols) for k in range(len(s) + 1))
        assert [(w[2], w[3]) for w in want] == list(zip(owner.tolist(), size.tolist(), strict=True))
        for t in range(1, len(want)):
            (g, a, *_), (h, b, *_) = want[t - 1], want[t]
            n = 0
            for x, y in zip(a, b, strict=False):
                if g != h or x != y or x[0] == 0:
                    break
                n += weight[g] if x[0] == 1 else 1
            assert common[t] == n


def test_sequential_files():
    column = suffix_dedup.Sequential(np.int32)
    column.write(np.arange(1000))
    column.write(np.arange(500))
    assert column.read().tolist() == list(range(500))
    column.close()
