from pyspark.sql import functions as F

from tempora.streaming import sessions as S
from tests.oracle import DATA


def test_streams_equal_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    folder = f"file://{tmp_path}/in"
    events.repartition(3).write.parquet(folder)
    batch = events.withColumn("ts", F.col("ts").cast("timestamp"))
    want = batch.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), "event_type", "n")
    out = f"file://{tmp_path}/out"
    S.drain(S.tumbling_counts(S.event_stream(spark, folder, events.schema)), out, f"file://{tmp_path}/check")
    got = spark.read.parquet(out)
    # Append mode gives out only windows that the watermark has closed.
    closed = want.where(F.col("window_start") < batch.agg(F.max("ts")).first()[0] - __import__("datetime").timedelta(days=1, hours=1))
    assert got.select("window_start", "event_type", "n").exceptAll(want).isEmpty()
    assert closed.exceptAll(got.select("window_start", "event_type", "n")).isEmpty()


def test_session_windows(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    folder = f"file://{tmp_path}/in"
    events.write.parquet(folder)
    out = f"file://{tmp_path}/out"
    S.drain(S.user_sessions(S.event_stream(spark, folder, events.schema)), out, f"file://{tmp_path}/check")
    batch = events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    want = batch.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")
    got = spark.read.parquet(out)
    assert got.count() > 0 and got.exceptAll(want).isEmpty()
