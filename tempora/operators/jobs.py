"""Job tables: the steps of subtitle and summary jobs as DataFrame operations.

A step joins jobs with what it needs, checks the contract, and returns the
jobs in their next status; rows that may not move keep theirs and say why in
``violation``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions import text, urls
from tempora.operators import contracts, diff, segments
from tempora.sources import srt


def create_subtitle_jobs(files: DataFrame) -> DataFrame:
    """One job per distinct content: job_id (digest), audio_path (the first), status."""
    rows = files.groupBy(F.sha2("content", 256).alias("job_id")).agg(F.min("path").alias("audio_path"))
    return rows.withColumn("status", F.lit("needs_transcription"))


def attach_transcription(jobs: DataFrame, transcripts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs made editable by transcripts of their audio, and the normalised baseline segments.

    ``transcripts`` has audio_id, id, start, end, text.  Texts are collapsed,
    empty segments go, ids are dense; a job whose transcript breaks the
    contract or leaves nothing stays as it is.
    """
    wanted = transcripts.withColumnRenamed("audio_id", "job_id").join(jobs.where("status = 'needs_transcription'").select("job_id"), "job_id", "left_semi")
    clean = segments.clean_segments(wanted, ["job_id"], ["id"]).select("job_id", "id", "start", "end", "text")
    checked = contracts.transcript(clean, ["job_id"])
    verdict = checked.groupBy("job_id").agg(F.min_by("violation", F.struct(F.col("violation").isNull(), "id")).alias("violation"), F.lit(True).alias("__found"))
    out = jobs.join(verdict, "job_id", "left")
    moves = (F.col("status") == "needs_transcription") & F.col("__found").isNotNull() & F.col("violation").isNull()
    out = out.withColumn("status", F.when(moves, "editable").otherwise(F.col("status"))).drop("__found")
    baseline = checked.drop("violation").join(verdict.where("violation IS NULL").select("job_id"), "job_id", "left_semi")
    return out, baseline


def finalize_subtitles(baseline: DataFrame, edited: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(job_id, content, changed_ids) of corrected jobs, and (job_id, violation) of the others.

    Only texts may differ from the baseline, and the edited segments must
    survive rounding to milliseconds.
    """
    found = diff.correction_diff(baseline, edited, ["job_id", "id"], ["start", "end"])
    timed = srt.millis(edited, ["job_id"])
    bad = found.select("job_id", "violation").union(timed.select("job_id", "violation")).where("violation IS NOT NULL")
    bad = bad.groupBy("job_id").agg(F.min("violation").alias("violation"))
    good = timed.join(bad, "job_id", "left_anti")
    content = srt.render(good, ["job_id"])
    changed = diff.changed_ids(found, ["job_id"], "id")
    out = content.join(changed, "job_id", "left")
    return out.withColumn("changed_ids", F.coalesce("changed_ids", F.array().cast("array<int>"))), bad


def prepare_summaries(requests: DataFrame, url: Column | str = "url") -> DataFrame:
    """Jobs from addresses: canonical url, bvid (the id), status preparing, or a violation without an id."""
    canonical = urls.canonical_video_url(url)
    out = requests.withColumn("url", canonical).withColumn("bvid", urls.video_id("url"))
    return out.withColumns({
        "status": F.when(F.col("bvid").isNotNull(), F.lit("preparing")),
        "violation": F.when(F.col("bvid").isNull(), F.lit("no_video_id")),
    })


def choose_source(jobs: DataFrame, subtitles: DataFrame, audio: DataFrame) -> DataFrame:
    """Prepared jobs become prompt_ready with a valid subtitle, needs_transcription with audio only, failed with neither.

    ``subtitles`` and ``audio`` have bvid and path, one row for each job at most.
    """
    found = jobs.join(subtitles.select("bvid", F.col("path").alias("subtitle")), "bvid", "left").join(audio.select("bvid", F.col("path").alias("audio")), "bvid", "left")
    status = F.when(F.col("subtitle").isNotNull(), "prompt_ready").when(F.col("audio").isNotNull(), "needs_transcription").otherwise("failed")
    return found.withColumn("status", F.when(F.col("status") == "preparing", status).otherwise(F.col("status")))


def continue_summaries(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Jobs that wait for a transcript become prompt_ready if a result of the same audio is there.

    Both have audio_id; results have manifest_path.
    """
    out = jobs.join(results.select("audio_id", "manifest_path"), "audio_id", "left")
    moves = (F.col("status") == "needs_transcription") & F.col("manifest_path").isNotNull()
    return out.withColumn("status", F.when(moves, "prompt_ready").otherwise(F.col("status")))


def complete_summaries(jobs: DataFrame, summaries: DataFrame) -> DataFrame:
    """Ready jobs become complete with a valid summary; complete ones whose summary fails go back.

    ``summaries`` has bvid, file_name, text.  ``errors`` lists what is wrong,
    ``language_warning`` only warns.
    """
    out = jobs.join(summaries.select("bvid", "file_name", F.col("text").alias("summary")), "bvid", "left")
    missing = F.col("summary").isNull()
    errors = F.when(missing, F.array(F.lit("summary file does not exist"))).otherwise(text.summary_errors("summary"))
    out = out.withColumn("errors", errors).withColumn("language_warning", F.coalesce(text.language_mismatch("summary", "file_name"), F.lit(False)))
    valid, ready = F.size("errors") == 0, F.col("status").isin("prompt_ready", "complete")
    return out.withColumn("status", F.when(ready & valid, "complete").when(ready, "prompt_ready").otherwise(F.col("status"))).drop("summary")
