from pathlib import Path

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.llm import common


def test_stored_tables_are_read_back_and_cleaned_up(spark):
    df = spark.range(10).withColumn("x", F.lit("é"))
    stored = common.materialize(df, "trial")
    assert stored.dtypes == df.dtypes and stored.count() == 10 and common.stored_bytes(stored) > 0
    paths = [Path(p.removeprefix("file:")) for p in common._made[spark.sparkContext.applicationId]]
    assert any(p.exists() for p in paths)
    assert common.cleanup(spark) == len(paths) and not any(p.exists() for p in paths)


def test_shared_folder_is_the_sessions(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_map_keeps_columns_and_replaces_clashes(spark):
    df = spark.createDataFrame([(1, "ab", "old"), (2, None, "old")], "k int, t string, n string")
    out = common.map_text(df, "t", lambda: lambda texts: [[len(x or "") for x in texts]], [common.field("n", T.LongType())], ["k", "t", "n"])
    assert sorted(tuple(r) for r in out.collect()) == [(1, "ab", 2), (2, None, 0)]
    kept = common.filter_texts(df, "t", lambda: lambda texts: [x is not None for x in texts])
    assert kept.columns == df.columns and kept.count() == 1


def test_long_texts_pass_in_small_chunks(spark):
    df = spark.range(600).select("id", F.repeat(F.lit("x"), 5000).alias("t"))
    sizes = common.map_text(df, "t", lambda: lambda texts: [[len(texts)] * len(texts)], [common.field("n", T.LongType())], ["id"])
    assert sizes.agg(F.max("n")).first()[0] <= common.CHUNK_ROWS
