"""Operators that look at one text at a time, against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.llm import decontaminate, pii, quality_rules, registry
from tempora.llm import sql as S
from tests.oracle import DATA, assert_same

RNG = random.Random(4)


def brute_base(text):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((m.start(), m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


@pytest.mark.parametrize("alphabet", ["1234.+@a-b ()0", "0123456789- ", "ab.@-%", "25.0 1+("])
def test_base_spans(alphabet):
    for _ in range(3000):
        text = "".join(RNG.choice(alphabet) for _ in range(RNG.randint(0, 70)))
        assert pii.base_spans(text) == brute_base(text), text


def test_long_runs_are_linear():
    assert pii.base_spans("1" * 200_000 + " a@" * 50_000) == []


@pytest.mark.parametrize(("text", "kinds"), [
    ("IBAN DE89 3704 0044 0532 0130 00 ok", ["iban"]), ("IBAN DE89 3704 0044 0532 0130 01 ok", []), ("GB82WEST12345698765432 bank", ["iban"]),
    ("my ssn is 123-45-6789", ["ssn"]), ("part 123-45-6789", []), ("call 555-123-4567 now", ["local_phone"]), ("555-123-4567", []), ("ssn 000-45-6789", []),
    ("ship 4111 1111 1111 1111", ["card"]), ("é a@b.co, 10.0.0.1 +33 1 23 45 67 89", ["email", "ip", "phone"]), (None, []), ("", []),
])
def test_added_kinds_need_checks_and_context(text, kinds):
    assert [s[2] for s in pii.find_spans(text)] == kinds


def test_redaction(documents):
    rows = [(1, "mail a@b.co or 10.0.0.1."), (2, None), (3, "clean"), (1, "x@y.zz")]
    out = pii.redact_documents(documents(rows, spans="kept", __length2=1))
    assert {(r.doc_id, r.text, r.n_chars, r.spans) for r in out.collect()} == {(1, "mail [EMAIL] or [IP].", 21, "kept"), (2, None, None, "kept"), (3, "clean", 5, "kept"), (1, "[EMAIL]", 7, "kept")}
    assert out.columns == documents(rows, spans="kept", __length2=1).columns


def test_personal_data_query(spark, documents, folder):
    rows = [(i, "".join(RNG.choice("12.@a-b +é") for _ in range(80))) for i in range(200)] + [(900, None), (901, ""), (None, "a@b.co"), (5, "q@r.st")]
    got = registry.op7_personal_data(spark, folder(documents=documents(rows)))
    want = Counter()
    for i, t in rows:
        base = brute_base(t or "")
        listed = ",".join(f"{k}:{s}:{e}" for s, e, k in base)
        n = Counter(k for _, _, k in base)
        want[(i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(listed.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got.collect()) == want
    assert all(r.spans is not None for r in got.collect())


def test_personal_data_query_equals_sql(spark, documents, folder):
    alphabets = ["12.@a-b +é", "0123456789 -().tel call ", "DE89 3704004405320130ssn-", "0.5.25+ @x"]
    rows = [(i, "".join(RNG.choice(a) for _ in range(70))) for i, a in enumerate(alphabets * 60)]
    rows += [(900 + i, t) for i, t in enumerate(["IBAN DE89 3704 0044 0532 0130 00 ok", "my ssn is 123-45-6789", "tel (555) 123-4567.", "+555-123-4567 tel", "mobile: - 555 123 4567)", None, ""])]
    sf = folder(documents=documents(rows))
    assert_same(spark, registry.op7_personal_data, S.ORACLES["op7_personal_data"], sf.removeprefix("file://"))
    assert_same(spark, registry.op7_personal_data, S.ORACLES["op7_personal_data"], DATA)


def brute_repeats(words, window=8):
    grams = Counter(tuple(words[i : i + window]) for i in range(len(words) - window + 1))
    hit = set()
    for i in range(len(words) - window + 1):
        if grams[tuple(words[i : i + window])] > 1:
            hit.update(range(i, i + window))
    return len(hit)


def test_repeated_words():
    for n in (2, 3, 20):
        for _ in range(300):
            words = [RNG.choice([b"a", b"b", b"c", b"dd", b"e"][: max(2, n)]) for _ in range(RNG.randint(0, 60))]
            assert quality_rules.repeated_words(words) == (brute_repeats(words), len(set(words)))


def test_rule_queries_equal_sql(spark, documents, folder):
    odd = [(1, None), (2, ""), (3, " \n\t"), (4, "a\x0bb\x0cc\rd"), (5, "é ü " * 30), (6, "same line\nsame line\nother\n\n"), (7, "#$ x&|<> *%"), (8, "w " * 3000), (9, "a b c d e f g h " * 3)]
    odd += [(10, "½²① é"), (11, "½ ² Ⅷ ① 12 " * 9), (12, " ".join(f"w{i % 150}" for i in range(2600))), (13, " ".join(f"w{i % 90}" for i in range(1999))), (None, "x"), (9, "again")]
    sf = folder(documents=documents(odd, n_words="clash"))
    for name in ("op9_quality_rules", "rule_policies", "rule_ablations"):
        assert_same(spark, getattr(registry, name), S.ORACLES[name], sf.removeprefix("file://"))
        assert_same(spark, getattr(registry, name), S.ORACLES[name], DATA)


def test_the_same_share_of_variety_holds_at_every_length():
    for n in (500, 1999, 2000, 50_000):
        value = dict(zip(quality_rules.MEASURES, quality_rules.measure(" ".join(f"w{i % 20}" for i in range(n))), strict=True))
        assert value["n_distinct_words"] == 20 * -(-n // 1000)


def test_ablation_bits_are_those_of_rejected_texts(spark):
    rows = spark.createDataFrame([(0,), (16,), (1,)], "failed_rules long")
    got = {(r.policy, r.or_bits, r.and_bits) for r in quality_rules.ablations(rows).collect()}
    assert got == {("v1-base", 1, 1), ("v2-lenient", 1, 1), ("v3-strict", 17, 0)}
    assert {(r.kept, r.or_bits, r.and_bits) for r in quality_rules.ablations(rows.limit(0)).collect()} == {(0, 0, 0)}


def test_policies_and_ablations(spark):
    rows = spark.createDataFrame([(i, b) for i, b in enumerate([0, 0, 1, 2, 4 | 8 | 16, 4 | 8, 32])], "doc_id int, failed_rules long")
    kept = quality_rules.apply_policies(rows).agg(*[F.count_if(f"kept_{p.version}").alias(p.version) for p in quality_rules.POLICIES]).first().asDict()
    assert kept == {"v1-base": 5, "v2-lenient": 4, "v3-strict": 2}
    got = {(r.policy, r.rule): (r.kept, r.kept_without_rule) for r in quality_rules.ablations(rows).collect()}
    for p in quality_rules.POLICIES:
        for rule in p.rules:
            bits = [0, 0, 1, 2, 28, 12, 32]
            fails = lambda b, drop: (b & quality_rules.mask([x for x in p.rules if x != drop])).bit_count() >= p.reject_from or b & quality_rules.mask([x for x in p.fatal if x != drop])  # noqa: E731, B023
            assert got[(p.version, rule)] == (sum(not fails(b, None) for b in bits), sum(not fails(b, rule) for b in bits))


def brute_contamination(text, items, window=10):
    words = decontaminate.words_of(text)
    hit, found = set(), set()
    for item, other in items:
        w = decontaminate.words_of(other)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            for j in range(len(words) - m + 1):
                if words[j : j + m] == w[i : i + m]:
                    hit.update(range(j, j + m))
                    found.add(item)
    return len(words), len(hit), found


def test_contamination(spark, documents, folder):
    vocabulary = ["a", "b", "Cé", "d1"]
    text = lambda n: RNG.choice([" ", ", ", "--"]).join(RNG.choice(vocabulary) for _ in range(n))
    items = [(i, text(RNG.randint(0, 16))) for i in range(12)] + [(3, "rare word"), (50, None), (51, "!!"), (52, "B"), (53, "x y z x y z x y z x y z")]
    rows = [(i, text(RNG.randint(0, 700))) for i in range(25)] + [(90, None), (91, ""), (92, "x Y z X y z x y z x y z x"), (None, "rare WORD"), (3, "rare word")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    sf = folder(documents=documents(rows, items="clash"), benchmark=bench)
    want = Counter()
    for i, t in rows:
        n, h, found = brute_contamination(t, items)
        want[(i, n, h, len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), h > 0)] += 1
    got = registry.op4_decontaminate(spark, sf).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    assert_same(spark, registry.op4_decontaminate, S.ORACLES["op4_decontaminate"], DATA)
    # Many small blocks of patterns give the same.
    blocks = decontaminate.find_contamination(documents(rows), bench, block_bytes=40).collect()
    assert Counter((r.doc_id, r.n_words, sum(x.end - x.start for x in r.hit_runs), len(r["items"])) for r in blocks) == Counter((w[0], w[1], w[2], w[3]) for w in want.elements())
    kept = decontaminate.drop_contaminated(documents(rows, items="clash"), bench)
    assert kept.columns == documents(rows, items="clash").columns
    assert kept.count() == sum(1 for i, t in rows if not brute_contamination(t, items)[1])
    assert decontaminate.drop_contaminated(documents(rows, items="clash", k1=1, block=2), bench, block_bytes=40).count() == kept.count()
    both = decontaminate.find_contamination(documents(rows, k1=5), bench, keep=["k1", "doc_id", "n_chars"], block_bytes=40)
    assert both.columns == ["k1", "doc_id", "n_chars", "n_words", "hit_runs", "items"] and both.count() == len(rows)


def test_empty_tables(spark, documents, folder):
    bench = spark.createDataFrame([], "item_id long, text string")
    sf = folder(documents=documents([]), benchmark=bench)
    for query in (registry.op4_decontaminate, registry.op7_personal_data, registry.op9_quality_rules):
        assert query(spark, sf).collect() == []
    assert decontaminate.find_contamination(documents([(1, "a b")]), bench).first()["n_words"] == 2


def test_null_item_marks_hits_only(spark, documents):
    bench = spark.createDataFrame([(None, "a b")], "item_id long, text string")
    row = decontaminate.find_contamination(documents([(1, "x a b")]), bench).first()
    assert [(x.start, x.end) for x in row.hit_runs] == [(1, 3)] and row["items"] == []


def test_search_over_lanes():
    patterns = decontaminate.Patterns([("i", " ".join(f"w{k}" for k in range(10)))])
    at = [0, 250, 251, 255, 256, 500, 990]
    words = ["x"] * 1000
    for a in at:
        words[a : a + 10] = [f"w{k}" for k in range(10)]
    (n, runs, items), _ = patterns.search([" ".join(words), None])
    brute = brute_contamination(" ".join(words), [("i", " ".join(f"w{k}" for k in range(10)))])
    assert (n, sum(e - s for s, e in runs), items) == brute
    assert np.all([s < e for s, e in runs])
