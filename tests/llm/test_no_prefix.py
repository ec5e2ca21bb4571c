"""Rare languages and long words count like all others."""

import itertools

from pyspark.sql import functions as F

from tempora.llm import language, weak_quality


def test_rare_languages_are_learned(spark, documents):
    pairs = ["".join(p) for p in itertools.product("bdfghklmnprstvwz", repeat=2)]
    rows = [(3 * i + k, " ".join([p + "a" + p] * 20), f"l{i:03d}", "s", 1) for i, p in enumerate([*pairs, "yj", "jy"]) for k in range(3)]
    rows += [(5000 + k, "γλώσσα σπάνια " * 10, "rare", "s", 1) for k in range(2)]
    docs = documents(rows)
    net = language.fit(docs, F.lit(True))
    assert len(net.languages) == 259 and "rare" in net.languages
    got = {r.doc_id: (r.lang_pred, round(r.score, 4)) for r in language.predict(docs, net).collect()}
    assert got[5000][0] == got[5001][0] == "rare"
    alone = language.predict(docs, net, batch_scores=1).collect()
    assert {r.doc_id: (r.lang_pred, round(r.score, 4)) for r in alone} == got


def test_shape_reads_the_whole_word():
    assert weak_quality._shape("a" * 64 + "9") == weak_quality._shape("a" * 70 + "9") == b"x+9"
    assert weak_quality._shape("a" * 64) == b"x+"
