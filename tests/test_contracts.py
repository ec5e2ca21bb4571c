import pytest
from pyspark.sql import functions as F

from tempora.operators import contracts as C

SHA = "a" * 64
OTHER = "b" * 64


def broken(df, *keys):
    return {tuple(r[k] for k in keys): r.violation for r in df.collect()}


def only(spark, validator, schema, good, **change):
    row = {**good, **change}
    names = [f.split()[0] for f in schema.split(", ")]
    return validator(spark.createDataFrame([tuple(row[n] for n in names)], schema)).first().violation


def test_transcript(spark):
    rows = [("ok", 0, 0.0, 1.0, "x"), ("ok", 1, 1.0, 2.0, "y"), ("id", 1, 0.0, 1.0, "x"), ("text", 0, 0.0, 1.0, " "), ("nan", 0, float("nan"), 1.0, "x"),
            ("back", 0, 0.0, 2.0, "x"), ("back", 1, 1.0, 3.0, "x"), ("zero", 0, 1.0, 1.0, "x"), ("past", 0, 1.0, 9.0, "x")]
    got = broken(C.transcript(spark.createDataFrame(rows, "k string, id int, start double, end double, text string"), ["k"], F.lit(5.0)), "k", "id")
    assert got == {("ok", 0): None, ("ok", 1): None, ("id", 1): "id_not_continuous", ("text", 0): "empty_text", ("nan", 0): "time_not_finite", ("back", 0): None,
                   ("back", 1): "starts_before_previous_end", ("zero", 0): "not_positive_length", ("past", 0): "past_duration"}


def test_raw_timestamps_allow_zero_length(spark):
    rows = [("ok", 0, "a", 1.0, 1.0, None), ("prob", 0, "a", 0.0, 1.0, 1.5), ("neg", 0, "a", 2.0, 1.0, 0.5), ("empty", 0, "", 0.0, 1.0, 0.5)]
    df = spark.createDataFrame(rows, "k string, n int, text string, start double, end double, probability double")
    assert broken(C.raw_timestamps(df, ["k"], ["n"], F.lit(5.0)), "k") == {("ok",): None, ("prob",): "probability_out_of_range", ("neg",): "negative_length", ("empty",): "empty_text"}
    assert broken(C.raw_timestamps(df.where("k = 'neg' OR k = 'ok'").withColumns({"start": F.lit(0.0)}), ["k"], ["n"], F.lit(5.0), F.lit("qwen3-asr")), "k") == {("ok",): None, ("neg",): "unexpected_probability"}


def test_alignment_times_have_a_tolerance(spark):
    rows = [("ok", 0, 0.0, 1.0), ("ok", 1, 0.9995, 5.0005), ("bad", 0, 0.0, 1.0), ("bad", 1, 0.99, 2.0)]
    df = spark.createDataFrame(rows, "k string, n int, start double, end double")
    assert broken(C.alignment_times(df, ["k"], ["n"], F.lit(5.0)), "k", "n") == {("ok", 0): None, ("ok", 1): None, ("bad", 0): None, ("bad", 1): "starts_before_previous_end"}


GOOD_LAYOUT = [(0, 0, 40, "silence", 10), (1, 40, 100, "audio_end", 60)]


@pytest.mark.parametrize(("place", "new", "want"), [
    (None, None, None), (0, (1, 0, 40, "silence", 10), "index_not_continuous"), (1, (1, 41, 100, "audio_end", 59), "not_contiguous"), (0, (0, 0, 20, "silence", 10), "length_out_of_bounds"),
    (0, (0, 0, 40, "silence", 41), "speech_out_of_bounds"), (0, (0, 0, 40, "pause", 10), "unknown_boundary"), (0, (0, 0, 40, "audio_end", 10), "audio_end_not_last"),
    (1, (1, 40, 99, "audio_end", 59), "does_not_reach_end"),
])
def test_layout(spark, place, new, want):
    rows = list(GOOD_LAYOUT)
    if place is not None:
        rows[place] = new
    df = spark.createDataFrame([("k", *r) for r in rows], "k string, idx int, s long, e long, boundary string, speech long")
    found = {r.violation for r in C.layout(df, ["k"], shortest=F.lit(30), longest=F.lit(180), length=F.lit(100)).collect()} - {None}
    assert (want in found) if want else not found


MANIFEST = "schema_version int, status string, audio_id string, duration double, sample_count long, sample_rate int, provider string, language string, variant_id string, recomputed_variant_id string, transcript_sha256 string, raw_timestamps_sha256 string, transcript_path string, raw_timestamps_path string"
GOOD = {"schema_version": 1, "status": "complete", "audio_id": SHA, "duration": 1.0, "sample_count": 16000, "sample_rate": 16000, "provider": "qwen3-asr", "language": "en", "variant_id": SHA,
        "recomputed_variant_id": SHA, "transcript_sha256": SHA, "raw_timestamps_sha256": SHA, "transcript_path": "t.json", "raw_timestamps_path": "r/w.json"}


@pytest.mark.parametrize(("change", "want"), [
    ({}, None), ({"schema_version": 2}, "schema_version"), ({"status": None}, "status"), ({"audio_id": "A" * 64}, "audio_id"), ({"duration": float("inf")}, "duration"), ({"sample_rate": 0}, "audio_shape"),
    ({"provider": "x"}, "provider"), ({"language": ""}, "language"), ({"variant_id": OTHER}, "variant_id"), ({"transcript_sha256": None}, "artifact_sha256"), ({"transcript_path": "../t"}, "artifact_path"),
])
def test_manifest(spark, change, want):
    assert only(spark, C.manifest, MANIFEST, GOOD, **change) == want


SUMMARY = "status string, bvid string, title string, url string, fetch_manifest string, subtitle string, audio string, subtitle_skipped boolean, transcript_source string, transcript_path string, transcription_manifest string, prompt_path string, summary_path string, error_stage string, error_type string, error_message string"
READY = {"status": "prompt_ready", "bvid": "b", "title": "t", "url": "u", "fetch_manifest": "r/f.json", "subtitle": None, "audio": None, "subtitle_skipped": False, "transcript_source": "subtitle",
         "transcript_path": "t.json", "transcription_manifest": None, "prompt_path": "p.md", "summary_path": "s.md", "error_stage": None, "error_type": None, "error_message": None}
EARLY = {**READY, "status": "preparing", "transcript_source": None, "transcript_path": None, "prompt_path": None, "summary_path": None}


@pytest.mark.parametrize(("base", "change", "want"), [
    (READY, {}, None), (EARLY, {}, None), (READY, {"status": "done"}, "status"), (READY, {"title": ""}, "video"), (EARLY, {"status": "needs_transcription"}, "audio_missing"),
    (EARLY, {"status": "needs_transcription", "audio": "a.m4a"}, None), (EARLY, {"prompt_path": "p"}, "early_job_has_results"), (READY, {"transcription_manifest": "/m"}, "unexpected_manifest"),
    (READY, {"transcript_source": "audio"}, "path_not_absolute"), (READY, {"prompt_path": "/abs"}, "prompt"), (READY, {"error_stage": "x"}, "ready_job_has_error"),
    (EARLY, {"status": "failed"}, "error_shape"), (EARLY, {"status": "failed", "error_stage": "a", "error_type": "b", "error_message": "c"}, None), (READY, {"transcript_source": None}, "transcript_source"),
])
def test_summary_job(spark, base, change, want):
    assert only(spark, C.summary_job, SUMMARY, base, **change) == want


SUBTITLE = "schema_version int, job_id string, audio_id string, audio_path string, status string, changed_ids array<int>, manifest_path string, variant_id string, baseline_sha256 string, baseline_digest string, normalized_sha256 string, normalized_digest string, subtitle string, subtitle_sha256 string, subtitle_digest string, expected_changed_ids array<int>"
EDITABLE = {"schema_version": 1, "job_id": SHA, "audio_id": SHA, "audio_path": "/a", "status": "editable", "changed_ids": [0], "manifest_path": "/m", "variant_id": SHA, "baseline_sha256": SHA, "baseline_digest": SHA,
            "normalized_sha256": SHA, "normalized_digest": SHA, "subtitle": "s.srt", "subtitle_sha256": SHA, "subtitle_digest": SHA, "expected_changed_ids": [0]}


@pytest.mark.parametrize(("change", "want"), [
    ({}, None), ({"audio_id": OTHER}, "audio_id"), ({"changed_ids": [1, 1]}, "changed_ids"), ({"changed_ids": [-1]}, "changed_ids"), ({"changed_ids": [1]}, "changed_ids_differ"), ({"subtitle": None}, "derived_fields"),
    ({"baseline_digest": OTHER}, "baseline_digest"), ({"normalized_digest": OTHER}, "normalized_digest"), ({"subtitle_digest": None}, "subtitle_digest"), ({"status": "needs_transcription"}, "untranscribed_job_has_results"),
    ({"normalized_sha256": None, "subtitle": None, "subtitle_sha256": None}, "unfinalized_job_has_changes"), ({"audio_path": "a"}, "audio_path"),
])
def test_subtitle_job(spark, change, want):
    assert only(spark, C.subtitle_job, SUBTITLE, EDITABLE, **change) == want


def test_planner_input(spark):
    rows = [(10, 2, 3, 6), (10, 4, 3, 6), (0, 1, 3, 6), (2, 1, 3, 6), (2, 2, 3, 6), (10, 2, 6, 3)]
    df = spark.createDataFrame(rows, "n long, k long, shortest long, longest long")
    assert [r.violation for r in C.planner_input(df).collect()] == [None, "infeasible", "sample_count", None, "infeasible", "bounds"]


def test_identity_cache_and_files(spark):
    a = spark.createDataFrame([(1, "x", "en"), (2, "y", "en"), (3, "z", "en")], "k int, p string, l string")
    b = spark.createDataFrame([(1, "x", "en"), (2, "y", "fr")], "k int, p string, l string")
    assert broken(C.same_identity(a, b, "k", ["p", "l"]), "k") == {(1,): None, (2,): "l", (3,): "missing"}
    chunks = spark.createDataFrame([(1, 0, 0, 2, "t"), (1, 1, 2, 5, "t"), (1, 9, 0, 1, "t"), (1, 2, 4, 6, None)], "r int, idx int, s long, e long, text string")
    layouts = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 2, 4), (1, 2, 4, 6)], "r int, idx int, s long, e long")
    assert broken(C.cached_chunk(chunks, layouts, ["r"]), "idx") == {(0,): None, (1,): "other_range", (9,): "not_in_plan", (2,): "no_text"}
    index = spark.createDataFrame([("m", {"a": "1.bin", "b": "2.bin"})], "model string, weight_map map<string,string>")
    files = spark.createDataFrame([("m", "1.bin")], "model string, file string")
    assert [r.file for r in C.missing_shards(index, files, ["model"]).collect()] == ["2.bin"]
    assert C.differs_from_recomputation(b, b).count() == 0
    assert {r.side for r in C.differs_from_recomputation(a.where("k < 3"), b).collect()} == {"cached", "recomputed"}


def test_small_predicates(spark):
    df = spark.createDataFrame([({"a": 1, "b": 2}, [1, 2], 4, 2, 8, 1.0)], "m map<string,int>, xs array<int>, workers int, threads int, cpus int, elapsed double")
    assert df.select(C.exact_keys("m", ["b", "a"]), C.exact_keys("m", ["a"]), C.unique("xs")).first()[:] == (True, False, True)
    assert C.thread_options(df.withColumn("beam_size", F.lit(5))).first().violation == "cpu_budget"
    assert C.chunk_transcript(df.select("elapsed", F.lit("x").alias("text"), F.lit("").alias("language"))).first().violation == "language"


def test_strict_mode_raises(spark):
    df = spark.createDataFrame([(1, None), (2, "bad")], "k int, violation string")
    with pytest.raises(C.ContractError, match="bad: 1"):
        C.enforce(df)
    assert C.enforce(df.where("k = 1")).columns == ["k"]
