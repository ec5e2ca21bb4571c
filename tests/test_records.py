import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tempora.operators import diff, incremental, metrics, projections, ranking
from tempora.sources import files, hooks, srt


def texts(spark, *contents):
    return spark.createDataFrame([(f"{i}.srt", c) for i, c in enumerate(contents)], "path string, content string")


def test_srt_parsing(spark):
    first = "﻿1\r\n00:00:01,000 --> 00:00:03,500\r\nHello\r\n there \r\n\r\n2\r\n00:00:04,000 --> 00:00:07,250\r\nBye\r\n"
    second = "00:00:01,000 --> 00:00:01,000\nzero\n\n00:00:02,000 --> 00:00:03,000\n　\n\nbad time\nx\n\n00:00:05,000-->00:00:06,000\nkept"
    got = [(r.path, r.id, r.start_ms, r.end_ms, r.text) for r in srt.parse(texts(spark, first, second)).orderBy("path", "id").collect()]
    assert got == [("0.srt", 0, 1000, 3500, "Hello there"), ("0.srt", 1, 4000, 7250, "Bye"), ("1.srt", 0, 5000, 6000, "kept")]


def test_srt_probe(spark):
    got = {r.path: (r.cues, r.error) for r in srt.probe(texts(spark, "not a subtitle", "00:00:01,000 --> 00:00:02,000\nx", "")).collect()}
    assert got == {"0.srt": (0, srt.EMPTY), "1.srt": (1, None), "2.srt": (0, srt.EMPTY)}


def test_srt_writer_bytes(spark):
    rows = [("a", 0, "0.0004", "1.9995", " one  two"), ("a", 1, "360061.9995", "360062.5", "x")]
    df = spark.createDataFrame(rows, "k string, id int, s string, e string, text string")
    df = df.select("k", "id", F.col("s").cast("double").alias("start"), F.col("e").cast("double").alias("end"), "text")
    out = srt.render(srt.millis(df, ["k"]), ["k"]).first().content
    assert out == "﻿1\n00:00:00,000 --> 00:00:02,000\none two\n\n2\n100:01:02,000 --> 100:01:02,500\nx\n"


@pytest.mark.parametrize(("rows", "want"), [
    ([(0.0001, 0.0004, "x")], "empty_after_rounding"), ([(0.0, 1.0006, "x"), (1.0, 2.0, "y")], "overlap_after_rounding"), ([(-1.0, 1.0, "x")], "time_not_finite"),
    ([(float("nan"), 1.0, "x")], "time_not_finite"), ([(0.0, 1.0, " ")], "empty_text"), ([(0.0, 99.0, "x")], "past_duration"), ([(0.0, 1.0, "x")], None),
])
def test_srt_contract(spark, rows, want):
    df = spark.createDataFrame([("k", i, *r) for i, r in enumerate(rows)], "k string, id int, start double, end double, text string")
    assert ({r.violation for r in srt.millis(df, ["k"], F.lit(10.0)).collect()} - {None}) == ({want} - {None})


def test_markdown(spark):
    df = spark.createDataFrame([("k", 0, 0.0, 61.5, "a"), ("k", 1, 3700.0, 3701.0, "b")], "k string, id int, start double, end double, text string")
    out = srt.render_markdown(df, ["k"], {"title": F.lit("T\n1"), "url": F.lit(None).cast("string")}).first().content
    assert out == "## metadata\n\ntitle: T 1\nurl: \n\n## transcript text\n\n[00:00:00 - 00:01:01] a\n[01:01:40 - 01:01:41] b\n"


def test_correction_may_change_text_only(spark):
    kind = "id int, start double, text string"
    a = spark.createDataFrame([(0, 0.0, "x"), (1, 1.0, "y"), (2, 2.0, "z")], kind)
    b = spark.createDataFrame([(0, 0.0, "X"), (1, 1.5, "y"), (3, 2.0, "z")], kind)
    got = {r.id: (r.changed, r.violation) for r in diff.correction_diff(a, b, ["id"], ["start"]).collect()}
    assert got == {0: (True, None), 1: (False, "start_changed"), 2: (False, "row_removed"), 3: (False, "row_added")}
    keyed = diff.correction_diff(a.withColumn("k", F.lit(1)), a.withColumn("k", F.lit(1)).withColumn("text", F.upper("text")), ["k", "id"], ["start"])
    assert diff.changed_ids(keyed, ["k"], "id").first().changed_ids == [0, 1, 2]


def test_ranking(spark):
    df = spark.createDataFrame([("a", "en", 5, "n1"), ("a", "zh", 1, "n2"), ("a", "zh", 3, "n3"), ("b", "xx", 1, "n4")], "k string, lang string, t int, name string")
    ranked = df.withColumn("rank", ranking.preference_rank("lang", ["zh", "en"]))
    best = {r.k: r.name for r in ranking.first_by(ranked, ["k"], ["rank", -F.col("t"), "name"]).collect()}
    assert best == {"a": "n3", "b": "n4"}
    prefs = spark.createDataFrame([("zh", 0)], "lang string, rank int")
    assert {r.name: r.rank for r in ranking.with_preference(df, prefs, "lang", 9).collect()} == {"n1": 9, "n2": 0, "n3": 0, "n4": 9}


def test_skyline_equals_brute_force(spark):
    import random

    rng = random.Random(2)
    rows = [(i, rng.randint(-40, 40), rng.randint(0, 60)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, x int, y int")
    want = {i for i, x, y in rows if not any(a <= x and b <= y and (a < x or b < y) for _, a, b in rows)}
    assert {r.id for r in ranking.skyline(df, "x", "y", ["id"]).collect()} == want


def test_metrics(spark):
    df = spark.createDataFrame([("a", 0, 2, 0.5), ("a", 1, 4, 0.25), ("b", 0, 0, 1.0)], "k string, i int, load long, t double")
    got = {r.k: (r.chunks, r.total, r.max_load, r.msre_numerator, r.msre_denominator) for r in metrics.load_metrics(df, ["k"], "load").collect()}
    assert got == {"a": (2, 6, 4, 4, 36), "b": (1, 0, 0, 0, 1)}
    assert {r.k: r.elapsed for r in metrics.elapsed_in_order(df, ["k"], "i", "t").collect()} == {"a": [0.5, 0.25], "b": [1.0]}
    assert metrics.cpu_budget(8) == 6 and metrics.cpu_budget(1) == 1
    assert metrics.largest_worker_count(8, 10, 2) == 3 and metrics.largest_worker_count(8, 2, 2) == 2
    counts = spark.createDataFrame([(25,), (60,), (100,), (120,), (180,)], "n long").select(metrics.chunk_counts(F.col("n"), F.lit(30), F.lit(180), 4).alias("c"))
    assert [r.c for r in counts.collect()] == [[1], [2], [3], [4], [4]]
    none = spark.createDataFrame([(60,), (25,)], "n long").select(metrics.chunk_counts(F.col("n"), F.lit(30), F.lit(180), 4, "divisible").alias("c"))
    assert [r.c for r in none.collect()] == [[], [1]]


def test_status_rollup(spark):
    rows = [("a", "pass", True, None), ("a", "pass", False, "p"), ("a", "fail", False, "q"), ("b", "fail", True, None), ("b", "pass", False, "p"), ("c", "pass", False, "p"), ("d", "fail", False, "p")]
    df = spark.createDataFrame(rows, "k string, status string, core boolean, provider string")
    assert {r.k: r.overall for r in metrics.status_rollup(df, ["k"]).collect()} == {"a": "degraded", "b": "not_ready", "c": "ready", "d": "not_ready"}


def test_only_missing_chunks_run_and_good_ones_stay(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    plan = spark.createDataFrame([(i,) for i in range(4)], "chunk int")
    ran = spark.sparkContext.accumulator(0)

    def work(fail):
        def run(todo):
            def one(frames):
                for f in frames:
                    ran.add(len(f))
                    yield pd.DataFrame({"chunk": f["chunk"], "payload": [None if c in fail else f"p{c}" for c in f["chunk"]], "error": ["boom" if c in fail else None for c in f["chunk"]]})

            return todo.mapInPandas(one, "chunk int, payload string, error string")

        return run

    with pytest.raises(RuntimeError, match="boom"):
        incremental.run_missing(plan, store, ["chunk"], work({2}))
    before = ran.value
    got = {r.chunk: r.payload for r in incremental.run_missing(plan, store, ["chunk"], work(set())).collect()}
    assert got == {i: f"p{i}" for i in range(4)}
    assert ran.value - before == 1
    again = ran.value
    incremental.run_missing(plan, store, ["chunk"], work(set()))
    assert ran.value == again


def test_progress_and_completeness(spark):
    plan = spark.createDataFrame([(1,), (2,), (3,)], "c int")
    done, failed = spark.createDataFrame([(1,)], "c int"), spark.createDataFrame([(1, "x"), (2, "y")], "c int, error string")
    rows = incremental.progress(plan, done, failed, ["c"])
    assert {r.c: (r.status, r.error) for r in rows.collect()} == {1: ("succeeded", None), 2: ("failed", "y"), 3: ("pending", None)}
    with pytest.raises(ValueError):
        incremental.complete(plan, done, ["c"])


def test_publish_verify_recover(spark, tmp_path):
    folder = f"file://{tmp_path}/sealed"
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, t string")
    assert [r.valid for r in incremental.publish({"t": df}, folder).collect()] == [True]
    df.where("k = 1").write.mode("overwrite").parquet(f"{folder}/t")
    assert [r.valid for r in incremental.verify(spark, folder).collect()] == [False]
    assert not incremental.recover(spark, folder, "t", lambda: df.where("k = 2"))
    assert incremental.recover(spark, folder, "t", lambda: df)
    assert [r.valid for r in incremental.verify(spark, folder).collect()] == [True]


def test_moves(spark):
    df = spark.createDataFrame([(None, "preparing"), ("preparing", "complete"), ("prompt_ready", "complete")], "b string, a string")
    assert [r.legal for r in incremental.illegal_moves(df, "b", "a", incremental.SUMMARY_MOVES).collect()] == [True, False, True]
    jobs = spark.createDataFrame([(1,), (2,)], "id int")
    existing = spark.createDataFrame([(1, "complete"), (2, "failed")], "id int, status string")
    assert [r.id for r in incremental.not_finished(jobs, existing, "id", ["complete"]).collect()] == [2]


def test_projections(spark):
    df = spark.createDataFrame([({"a": "1", "b": None, "c": "3"}, [1, 2], ["x", "y"])], "m map<string,string>, xs array<int>, ys array<string>")
    assert df.select(projections.compact("m", ["a", "b"])).first()[0] == {"a": "1"}
    assert [(r.a, r.b) for r in df.select(projections.zip_exact("xs", "ys")).first()[0]] == [(1, "x"), (2, "y")]
    with pytest.raises(Exception, match="sizes differ"):
        df.select(projections.zip_exact("xs", F.array(F.lit("x")))).collect()
    jobs = spark.createDataFrame([("secret path",), ("known",)], "msg string").withColumn("prompt", F.lit("p"))
    got = projections.failed_job(jobs, F.lit("fetch"), F.lit("ValueError"), F.col("msg"), ["known"]).collect()
    assert [(r.prompt, r.error.message) for r in got] == [(None, "Resource preparation failed."), (None, "known")]
    nested = projections.nested(jobs, "n", ["msg", "prompt"])
    assert projections.flat(nested, "n").columns == ["msg", "prompt"]
    prompt = jobs.select(projections.metadata_prompt(F.lit("# {{title}}"), F.lit("text"), {"title": F.col("msg")})).first()[0]
    assert prompt == "# secret path\n\ntext"


class Flaky:
    def identity(self):
        return {"model": "fake"}

    def transcribe_batch(self, items):
        if any(i["k"] == 3 for i in items):
            raise RuntimeError("bad item")
        return [f"t{i['k']}" for i in items]


def test_provider_isolates_failures(spark):
    df = spark.range(6).selectExpr("cast(id as int) as k").coalesce(1)
    got = {r.k: (r.payload, r.error) for r in hooks.run_provider(df, ["k"], Flaky).collect()}
    assert got == {**{k: (f"t{k}", None) for k in (0, 1, 2, 4, 5)}, 3: (None, "RuntimeError: bad item")}


def test_content_hook_and_benchmark(spark):
    df = spark.createDataFrame([(1, b"abc"), (2, b"")], "k int, content binary")
    got = {r.k: (r.n, bool(r.error)) for r in hooks.map_content(df, ["k"], lambda b: 1 // len(b) + len(b) - 0, "int", "n").collect()}
    assert got == {1: (3, False), 2: (None, True)}
    rows = hooks.benchmark([1, 0], lambda x: 1 / x)
    assert [r["error"] is None for r in rows] == [True, False]


def test_files(spark, tmp_path):
    for name, body in {"v.en.srt": "00:00:01,000 --> 00:00:02,000\nx", "v.zh.srt": "nothing", "v.mp4.part": "z", "w.srt": "z"}.items():
        (tmp_path / name).write_text(body)
    found = files.listing(spark, f"file://{tmp_path}")
    assert {r.name for r in files.media(found).collect()} == {"v.en.srt", "v.zh.srt", "w.srt"}
    assert {r.name for r in files.of_id(found, "v").collect()} == {"v.en.srt", "v.zh.srt", "v.mp4.part"}
    probes = srt.probe(srt.read_files(spark, f"file://{tmp_path}/*.srt"))
    probes = probes.withColumn("path", F.regexp_replace("path", "^file:///", "file:/"))
    listed = found.withColumn("path", F.regexp_replace("path", "^file:///", "file:/")).withColumn("k", F.lit(1))
    assert [r.name for r in files.best_subtitle(listed, probes, ["k"], ["zh", "en"]).collect()] == ["v.en.srt"]
    raw = spark.createDataFrame([('{"a":1}',), ('{"a":1,"a":2}',)], "raw string")
    assert [r.object for r in files.strict_objects(raw, "raw").collect()] == ['{"a":1}', None]
    assert [r.object.a for r in files.lenient_objects(raw, "raw", "a int").collect()] == [1, 2]
    files.write_json(raw, f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out").count() == 2


def test_interval_cache_reasons(spark):
    kind = "found boolean, readable boolean, schema_version int, source string, wanted_source string, parameters string, wanted_parameters string, structure string"
    good = (True, True, 1, "s", "s", "p", "p", None)
    changes = [{}, {0: False}, {1: False}, {2: 2}, {3: "x"}, {5: "x"}, {7: "overlap"}]
    rows = [tuple(c.get(i, v) for i, v in enumerate(good)) for c in changes]
    got = [r.reason for r in files.vad_status(spark.createDataFrame(rows, kind)).collect()]
    assert got == [None, "missing", "unreadable", "schema_mismatch", "source_mismatch", "parameters_mismatch", "invalid_structure"]
    items = spark.createDataFrame([("x", [1]), ("", [1]), ("x", [])], "text string, items array<int>")
    assert [r.violation for r in files.workspace_rows(items).collect()] == [None, "empty_text", "no_items"]


def test_optional_side_and_plans(spark):
    rows, side = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "t")], "k int, title string")
    assert {r.k: r.title for r in files.with_optional(rows, side, "k", {"title": ""}).collect()} == {1: "t", 2: ""}
    cached = spark.createDataFrame([(1, "v", "plan")], "k int, id string, plan string")
    wanted = spark.createDataFrame([(1, "v"), (2, "v")], "k int, id string")
    assert files.matching_plan(wanted, cached, "k", ["id"]).count() == 1
    assert json.loads(cached.toJSON().first())["plan"] == "plan"


def test_chunk_results_need_their_own_name(spark, tmp_path):
    (tmp_path / "chunk_001.json").write_text('{"index": 1, "text": "a"}')
    (tmp_path / "chunk_002.json").write_text('{"index": 7, "text": "b"}')
    got = files.chunk_results(spark, f"file://{tmp_path}/chunk_*.json", "index int, text string").collect()
    assert [tuple(r) for r in got] == [(1, "a")]


def test_subtitles_to_markdown(spark):
    df = texts(spark, "00:00:01,000 --> 00:00:02,000\nHi\n\n00:00:02,000 --> 00:00:03,000\nthere.\n\n00:00:09,000 --> 00:00:10,000\nEnd")
    out = srt.to_markdown(df, ["path"], {"title": F.col("path")}).first().content
    assert out.endswith("[00:00:01 - 00:00:03] Hi there.\n[00:00:09 - 00:00:10] End\n") and "title: 0.srt" in out
