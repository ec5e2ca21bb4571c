"""Learned operators: held-out accuracy, defined cases, and their parts against direct computation."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.llm import language, registry, toxicity, weak_quality

SF = "/root/testdata/sf0.01"


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = registry.op3_language_id(spark, SF).join(docs, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_defined_cases(spark, documents, folder):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(w) for _ in range(30)), lang, "s", 1) for i in range(60) for lang, w in [rng.choice([("aa", ["pum", "pam"]), ("bb", ["kri", "kro"])])]]
    rows += [(100, None), (101, ""), (102, "12 .. 3", None, "s", 1), (103, "PUM PAM", None, "s", 1), (104, "kri " * 9000, None, None, None), (104, "kri", None, "s", 1)]
    got = {}
    for r in registry.op3_language_id(spark, folder(documents=documents(rows, lang_pred="clash", score="clash"))).collect():
        got.setdefault(r.doc_id, []).append(r.lang_pred)
    assert got[100] == got[101] == got[102] == ["und"]
    assert got[103] == ["aa"] and got[104] == ["bb", "bb"]
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in registry.op3_language_id(spark, SF).take(50))


def test_language_without_labels(spark, documents, folder):
    assert [r.lang_pred for r in registry.op3_language_id(spark, folder(documents=documents([(1, "abc", None, "s", 1)]))).collect()] == ["und"]
    assert registry.op3_language_id(spark, folder(documents=documents([]))).collect() == []


def test_tables_are_the_convolution():
    rng = np.random.default_rng(1)
    net = language.train(np.zeros((0, language.WINDOW), np.uint8), np.zeros(0, int), ["a", "b"])
    net.bias[:] = rng.normal(size=len(net.bias))
    rows = rng.integers(0, language.SYMBOLS, (3, language.WINDOW)).astype(np.uint8)
    got = net.respond(rows, *net.tables())
    for k, w in enumerate(language.WIDTHS):
        for p in (0, 5, language.WINDOW - 4):
            want = sum(net.filters[w][j][rows[:, p + j]] for j in range(w)) + net.bias[k * 16 : k * 16 + 16]
            assert np.allclose(got[:, p, k * 16 : k * 16 + 16], want, atol=1e-4)


def test_whole_text_becomes_windows():
    text = "Ä" * 1000
    found = language.windows_of(text)
    assert found.shape == (16, language.WINDOW) and (found.ravel()[:2000] > 0).all() and (found.ravel()[2000:] == 0).all()


def test_toxicity_accuracy_on_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    learn = labels.where("doc_id % 2 = 0")
    model = toxicity.fit(docs, learn)
    rows = toxicity.score(docs, model).join(labels.where("doc_id % 2 = 1 AND quality = 1").select("doc_id", F.col("toxic").alias("label")), "doc_id").collect()
    hit = [r for r in rows if r.label]
    assert sum(r.toxic for r in hit) / len(hit) > 0.85
    assert sum(r.toxic for r in rows if not r.label) / (len(rows) - len(hit)) < 0.02
    assert all(0 <= r.severity <= toxicity.GRADES - 1 and 0 <= r.grade < toxicity.GRADES for r in rows)


def made(n=200):
    rng = random.Random(2)
    clean = ["sun", "tree", "walk", "river", "stone"]
    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        words = [rng.choice(clean) for _ in range(20)] + [rng.choice(["vileword", "awfulthing", "nastyone"]) for _ in range(rng.randint(1, 4) if bad else 0)]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_grades_rise_and_defined_cases(spark, documents):
    rows, labels = made()
    docs = documents([*rows, (900, None), (901, ""), (902, "a vileword"), (902, "vileword nastyone awfulthing vilewords nastyones"), (None, "sun")], toxic="clash", grade=7)
    frame = spark.createDataFrame([*labels, (0, None, None), (None, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, frame)
    assert (np.diff(model.thresholds) > 0).all()
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + 5
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert all(by[i][0].toxic == bool(t) for i, _, t in labels)
    assert not by[900][0].toxic and not by[901][0].toxic and not by[None][0].toxic
    assert sorted(r.severity for r in by[902])[1] > sorted(r.severity for r in by[902])[0]
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.toxic}


def test_toxicity_without_labels(spark, documents, folder):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = registry.op10_toxicity(spark, folder(documents=documents([(1, "x")]), labels=empty)).collect()
    assert [(r.toxic, r.grade) for r in got] == [(False, 0)] and got[0].severity < 1e-6


def test_quality_accuracy_on_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = registry.op2_quality_classifier(spark, SF).join(labels, "doc_id").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.keep for r in good) / len(good) > 0.97 and sum(not r.keep for r in bad) / len(bad) > 0.9


def test_estimation_recovers_accuracies():
    rng = np.random.default_rng(5)
    n, m = 20_000, len(weak_quality.LABELLERS)
    good = rng.random(n) < 0.8
    objects = np.stack([rng.uniform(0.15, 0.5, m), rng.uniform(0.001, 0.01, m)])
    votes = np.where(rng.random((n, m)) < 0.3, weak_quality.ABSTAIN, np.where(rng.random((n, m)) < objects[good.astype(int)], weak_quality.BAD, weak_quality.GOOD))
    patterns, counts = np.unique(votes @ 3 ** np.arange(m - 1, -1, -1), return_counts=True)
    assert (weak_quality.votes_of(patterns) == np.unique(votes, axis=0)).all()
    model = weak_quality.estimate(patterns, counts)
    assert abs(model.good_share - 0.8) < 0.06 and np.abs(model.objects[0] - objects[0]).max() < 0.2
    assert set(model.accuracies()) == set(weak_quality.LABELLERS)


def test_quality_defined_cases(documents):
    text = "The quick brown fox jumps over a lazy dog near the old river bank. It was a fine day for all of them. "
    rows = [(i, text + f"Then number {i} came along with some other words.") for i in range(60)] + [(100 + i, f"spam{i} " * 200) for i in range(12)]
    rows += [(900, None), (901, ""), (902, "short."), (902, "short."), (None, text)]
    got = weak_quality.classify(documents(rows, score="clash", keep=1)).collect()
    assert len(got) == len(rows)
    assert all(r.keep for r in got if r.doc_id is not None and r.doc_id < 60) and not any(r.keep for r in got if r.doc_id is not None and 100 <= r.doc_id < 112)
    assert weak_quality.classify(documents([])).collect() == []


@pytest.mark.parametrize("text", [None, "", "  ", "x", "é" * 50, "!" * 10])
def test_statistics_of_odd_texts(text):
    stats = weak_quality.statistics(text, text.encode().split() if text else [])
    assert all(np.isfinite(v) for v in stats.values()) and 0 <= weak_quality.pattern_of(stats) < weak_quality.N_VOTES


def test_samples_are_bounded_for_repeated_and_null_ids(spark):
    from tempora.llm.common import bounded_sample

    rows = spark.range(0, 200_000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.col("id")).alias("id"), F.lit("same").alias("text"))
    keyed = rows.withColumn("sample_key", F.xxhash64("id", "text"))
    got = bounded_sample(keyed, 500, 200_000).collect()
    assert len(got) <= 500 and len({r.id for r in got}) == len(got)
    different = rows.withColumn("sample_key", F.xxhash64("id", F.rand(1)))
    assert bounded_sample(different, 500, 200_000).count() == 500
    assert bounded_sample(keyed, 500, 10).count() == 500  # a wrong total never lets more through


def test_models_learn_from_bounded_samples(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(weak_quality, "train_scorer", lambda b, s, t: seen.append(len(b)) or (np.zeros(weak_quality.BUCKETS), 0.0))
    monkeypatch.setattr(language, "train", lambda w, n, names: seen.append(len(w)) or language.ByteConvNet.__new__(language.ByteConvNet))
    monkeypatch.setattr(toxicity, "train", lambda rows, t: seen.append(len(rows)) or toxicity.NEUTRAL)
    docs = spark.range(0, 30_000).select(F.when(F.col("id") % 3 > 0, F.lit(1)).when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    weak_quality.classify(docs, sample_rows=300)
    language.fit(docs, F.lit(True), per_language=40, windows_per_text=2)
    toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic")), per_class=50)
    assert 250 <= seen[0] <= 300 and 40 <= seen[1] <= 80 and 80 <= seen[2] <= 100


@pytest.mark.parametrize("text", ["½ ² Ⅷ ①", "12 .. 3", "___", "٣"])
def test_no_letters_is_undetermined(documents, text):
    net = language.train(np.zeros((0, language.WINDOW), np.uint8), np.zeros(0, int), ["a", "b"])
    assert [r.lang_pred for r in language.predict(documents([(1, text)]), net).collect()] == ["und"]


def test_prediction_equals_plain_convolution(documents):
    """Brute force: every filter at every place of every window, without tables or batches."""
    rng = np.random.default_rng(3)
    net = language.train(np.zeros((0, language.WINDOW), np.uint8), np.zeros(0, int), ["a", "b", "c"])
    for w in (*net.filters.values(), net.bias, net.out, net.out_bias):
        w[...] = rng.normal(size=w.shape)
    texts = ["Some words here. " * 40, "x", "ÄÖ ß 中文 " * 30, None]
    got = language.predict(documents(list(enumerate(texts))), net).collect()
    for r in got:
        if texts[r.doc_id] is None:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        total, weights = np.zeros(3), 0
        for window in language.windows_of(texts[r.doc_id]):
            pooled = []
            for k, w in enumerate(language.WIDTHS):
                spots = range(language.WINDOW - max(language.WIDTHS) + 1)
                pooled.append(np.max([sum(net.filters[w][j][window[p + j]] for j in range(w)) for p in spots], axis=0) + net.bias[k * 16 : k * 16 + 16])
            z = np.maximum(np.concatenate(pooled), 0) @ net.out + net.out_bias
            weight = int((window > 2).sum())
            total += weight * (z - z.max() - np.log(np.exp(z - z.max()).sum()))
            weights += weight
        mean = total / weights
        p = np.exp(mean - mean.max())
        assert r.lang_pred == "abc"[int(mean.argmax())] and abs(r.score - float(p.max() / p.sum())) < 1e-3


def test_toxicity_scores_equal_brute_force(documents):
    """Each word and prefix looked up by itself; probabilities from the formula."""
    rng = random.Random(4)
    rows, labels = made(120)
    model = toxicity.OrdinalModel({f: rng.uniform(-1, 1) for w in ("vileword", "sun", "tree", "river") for f in toxicity.word_features(w.encode())}, np.array([0.1, 0.6, 1.5]))
    for r in toxicity.score(documents(rows), model).collect():
        total = 0.0
        for word in set(dict(rows)[r.doc_id].split()):
            total += sum(model.weights.get(f, 0.0) for f in toxicity.word_features(word.encode()))
        p = [1 / (1 + np.exp(t - total)) for t in model.thresholds]
        parts = [1 - p[0], p[0] - p[1], p[1] - p[2], p[2]]
        assert abs(r.severity - sum(p)) < 1e-9 and r.grade == int(np.argmax(parts)) and r.toxic == (p[0] >= 0.5)


def test_posterior_equals_brute_force():
    """Bayes' rule vote by vote."""
    rng = np.random.default_rng(9)
    m = len(weak_quality.LABELLERS)
    model = weak_quality.LabelModel(0.7, rng.uniform(0.1, 0.9, (2, m)))
    for pattern in rng.integers(0, weak_quality.N_VOTES, 50):
        votes = weak_quality.votes_of(np.array([pattern]))[0]
        chance = [0.3, 0.7]
        for k, v in enumerate(votes):
            for c in (0, 1):
                chance[c] *= {weak_quality.ABSTAIN: 1.0, weak_quality.BAD: model.objects[c, k], weak_quality.GOOD: 1 - model.objects[c, k]}[int(v)]
        assert abs(model.posterior(np.array([pattern]))[0] - chance[1] / sum(chance)) < 1e-9
