import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tempora.llm import simhash, toxicity
from tempora.llm.registry import tokenizer_path
from tests.llm.test_packing import sequential_best_fit
from tests.llm.test_simhash import brute_components, brute_fingerprint
from tests.llm.test_simple import brute_base, brute_contamination


@pytest.fixture
def data(spark, documents, folder):
    rng = random.Random(3)
    vocabulary = [a + b for a in "bcdfgl" for b in ("a", "e", "io", "un")]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    bench = [(i, text(15)) for i in range(3)]
    rows = [(i, text(40) + (" vileword nastything" if i % 3 == 0 else "")) for i in range(90)]
    rows += [(200, bench[0][1] + " " + text(5)), (201, rows[1][1]), (202, text(30) + " a@b.co"), (203, None), (204, ""), (205, text(30)), (205, "x " + text(30))]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(90)] + [(None, None, None)], "doc_id long, quality int, toxic int")
    docs = documents(rows, extra=1, toxic="clash", component_id="clash", __id=5, __text="clash", __length=77, __fp=1)
    return folder(documents=docs, labels=labels, benchmark=spark.createDataFrame(bench, "item_id long, text string")), rows, bench, docs, labels


def brute(rows, bench, model):
    toxic = lambda t: model.probabilities(toxicity._scorer(model)([t]))[0, 0] >= toxicity.REJECT_FROM
    rows = [r for r in rows if not toxic(r[1])]
    comps = brute_components([brute_fingerprint(t) for _, t in rows])
    first = {}
    for c, (i, _) in zip(comps, rows, strict=True):
        first[c] = min(first.get(c, i), i)
    rows = [r for c, r in zip(comps, rows, strict=True) if r[0] == first[c]]
    rows = [r for r in rows if not brute_contamination(r[1], bench)[1]]
    out = []
    for i, t in rows:
        for s, e, kind in reversed(brute_base(t or "")):  # no spans overlap here
            t = f"{t[:s]}[{kind.upper()}]{t[e:]}"
        out.append((i, t))
    return out


def test_stages_equal_brute_force(spark, data):
    sf, rows, bench, docs, labels = data
    model = toxicity.fit(docs, labels)
    want = brute(rows, bench, model)
    assert any("[EMAIL]" in (t or "") for _, t in want) and len(want) < len(rows)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in want]
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter((i, 0, 0, len(x), zlib.crc32(np.asarray(x, "<u4").tobytes())) for i, x in ids)
    bins = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == bins[r.sequence_id]
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 4096 and len(bins) == sequential_best_fit([len(x) for _, x in ids], 4096)


def test_stages_keep_the_columns(spark, data):
    sf, _, _, docs, _ = data
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_empty_documents(spark, data, folder, documents):
    sf, *_ = data
    folder(documents=documents([]))
    assert corpus_pipeline.run(spark, sf).collect() == []


def test_stage_list():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]
    assert simhash.BITS == 64 and corpus_pipeline.oracle_sql() == {}
