from pyspark.sql import functions as F

from tempora.functions import register
from tempora.operators import jobs
from tempora.sources import results

SEG = "audio_id string, id int, start double, end double, text string"


def test_subtitle_jobs(spark):
    files = spark.createDataFrame([("/a", b"x"), ("/b", b"x"), ("/c", b"y"), ("/d", b"z")], "path string, content binary")
    made = jobs.create_subtitle_jobs(files)
    ids = {r.audio_path: r.job_id for r in made.collect()}
    assert set(ids) == {"/a", "/c", "/d"}
    rows = [(ids["/a"], 0, 0.0, 1.0, " Hi  you "), (ids["/a"], 1, 1.0, 2.0, "　"), (ids["/a"], 2, 2.0, 3.0, "bye"), (ids["/c"], 0, 1.0, 1.0, "bad")]
    after, baseline = jobs.attach_transcription(made, spark.createDataFrame(rows, SEG))
    assert {r.audio_path: (r.status, r.violation) for r in after.collect()} == {"/a": ("editable", None), "/c": ("needs_transcription", "not_positive_length"), "/d": ("needs_transcription", None)}
    assert [(r.id, r.text) for r in baseline.orderBy("id").collect()] == [(0, "Hi you"), (1, "bye")]
    edited = baseline.withColumn("text", F.when(F.col("id") == 0, "Hello you").otherwise(F.col("text")))
    done, bad = jobs.finalize_subtitles(baseline, edited)
    row = done.first()
    assert row.changed_ids == [0] and "Hello you" in row.content and bad.count() == 0
    done, bad = jobs.finalize_subtitles(baseline, edited.withColumn("end", F.col("end") + 0.5))
    assert done.count() == 0 and bad.first().violation in ("end_changed", "overlap_after_rounding")


def test_summary_jobs(spark):
    asked = spark.createDataFrame([("https://www.bilibili.com/video/BV1?p=2&x=1",), ("https://x/video/BV2",), ("https://x/video/BV3",), ("https://x/",)], "url string")
    made = jobs.prepare_summaries(asked)
    assert {r.bvid: r.status for r in made.collect()} == {"BV1_p2": "preparing", "BV2": "preparing", "BV3": "preparing", None: None}
    sub, audio = spark.createDataFrame([("BV1_p2", "a.srt")], "bvid string, path string"), spark.createDataFrame([("BV2", "b.m4a")], "bvid string, path string")
    chosen = jobs.choose_source(made, sub, audio)
    assert {r.bvid: r.status for r in chosen.where("bvid IS NOT NULL").collect()} == {"BV1_p2": "prompt_ready", "BV2": "needs_transcription", "BV3": "failed"}
    waiting = chosen.withColumn("audio_id", F.col("bvid"))
    ready = jobs.continue_summaries(waiting, spark.createDataFrame([("BV2", "/m.json")], "audio_id string, manifest_path string"))
    assert {r.bvid: r.status for r in ready.where("bvid IS NOT NULL").collect()} == {"BV1_p2": "prompt_ready", "BV2": "prompt_ready", "BV3": "failed"}
    said = spark.createDataFrame([("BV1_p2", "x_summary_en.md", "All fine"), ("BV2", "x_summary_en.md", "{{left}}")], "bvid string, file_name string, text string")
    over = {r.bvid: r for r in jobs.complete_summaries(ready, said).where("bvid IS NOT NULL").collect()}
    assert over["BV1_p2"].status == "complete" and not over["BV1_p2"].language_warning
    assert over["BV2"].status == "prompt_ready" and over["BV2"].errors == ["placeholder remains"]
    assert over["BV3"].status == "failed"


def test_sealed_results(spark):
    sha = "c" * 64
    kind = "schema_version int, status string, audio_id string, duration double, sample_count long, sample_rate int, provider string, language string, variant_id string, transcript_sha256 string, raw_timestamps_sha256 string, transcript_path string, raw_timestamps_path string"
    base = spark.createDataFrame([(1, "complete", sha, 5.0, 80000, 16000, "faster-whisper", lang, "", sha, sha, "t.json", "r.json") for lang in ("en", "fr", "de", "it", "es")], kind)
    manifests = results.with_variant(base, ["provider", "language"]).withColumn("variant_id", F.col("recomputed_variant_id")).drop("recomputed_variant_id")
    end = F.when(F.col("language") == "fr", 9.0).otherwise(2.0)
    segment = F.array(F.struct(F.lit(0).alias("id"), F.lit(1.0).alias("start"), end.alias("end"), F.lit("x").alias("text")))
    item = F.array(F.struct(F.lit("x").alias("text"), F.lit(1.0).alias("start"), F.lit(2.0).alias("end"), F.when(F.col("language") == "de", 2.0).otherwise(0.5).alias("probability")))
    identity = manifests.select(*results.IDENTITY)
    transcripts = identity.withColumn("segments", segment).where("language <> 'it'")
    raw = identity.withColumn("items", item).withColumn("audio_id", F.when(F.col("language") == "es", "other").otherwise(F.col("audio_id")))
    got = {r.language: r.violation for r in results.load(manifests, transcripts, raw, ["provider", "language"]).collect()}
    assert got == {"en": None, "fr": "past_duration", "de": "probability_out_of_range", "it": "transcript_missing", "es": "audio_id"}


def test_sql_functions(spark):
    register.register(spark)
    row = spark.sql("SELECT srt_time(360062000) AS a, clock(-4) AS b, cut_sentences('Hi.  You there') AS c, collapse_whitespace(' a　b ') AS d").first()
    assert tuple(row) == ("100:01:02,000", "00:00:00", ["Hi.", "You there"], "a b")
    assert [tuple(r) for r in spark.sql("SELECT * FROM merge_intervals(array(5L, 0L, 2L), array(6L, 2L, 4L))").collect()] == [(0, 4), (5, 6)]
    assert [tuple(r) for r in spark.sql("SELECT * FROM parse_srt('1\n00:00:01,000 --> 00:00:02,500\nHi\nyou')").collect()] == [(0, 1000, 2500, "Hi you")]
