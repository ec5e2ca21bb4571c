import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A documents table from (id, text) pairs, or from whole rows; extra columns clash on purpose."""

    def make(rows, **more):
        full = [(i, t, *(rest or ("en", "s", None if t is None else len(t)))) for i, t, *rest in rows]
        df = spark.createDataFrame(full, DOCS)
        from pyspark.sql import functions as F

        return df.withColumns({name: F.lit(value) for name, value in more.items()})

    return make


@pytest.fixture
def folder(tmp_path):
    """Writes tables as a data folder and returns its path."""

    def make(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"file://{tmp_path}/{name}.parquet")
        return f"file://{tmp_path}"

    return make
