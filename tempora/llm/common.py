"""Helpers shared by the corpus operators: table loading, Arrow maps, shared storage."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.runtime import ship

#: Rows turned into Python objects at once inside an Arrow batch; bounds a worker's memory.
CHUNK_ROWS = 256

_own_dirs: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data folder, read by Spark only."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A private folder is made only where the setting is absent and all runs in
    this process, as in tests; on a cluster the setting is needed.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        import atexit

        folder = tempfile.mkdtemp(prefix="tempora-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own_dirs[app] = f"file://{folder}"
    return _own_dirs[app]


def new_path(spark: SparkSession, hint: str) -> str:
    """A path of its own in the shared folder, remembered for :func:`cleanup`."""
    path = f"{shared_dir(spark)}/tempora-{hint}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def cleanup(spark: SparkSession) -> int:
    """Delete this application's intermediate tables and archives; results that still read them must be stored first."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return len(paths)


def materialize(df: DataFrame, hint: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor never makes the rows be computed
    again in another order, and later stages survive without the earlier ones.
    """
    spark = df.sparkSession
    ship(spark)
    path = new_path(spark, hint)
    df.write.option("compression", "zstd").parquet(path, partitionBy=list(partition_by) or None)
    return spark.read.schema(df.schema).parquet(path)


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a table that :func:`materialize` returned."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def bounded_sample(rows: DataFrame, limit: int, total: int, key: str = "sample_key") -> DataFrame:
    """At most ``limit`` rows with different values of the hash column ``key``, about evenly from ``total`` rows.

    Rows that repeat a key count once, so a repeated or null id never fills the
    sample; the smallest keys are taken, so the sample does not depend on the
    order of rows.  Only about ``limit`` rows leave the tasks.
    """
    share = min(1.0, 1.2 * limit / max(1, total))
    upto = int(2**63 * (2 * share - 1)) if share < 1 else 2**63 - 1
    return rows.where(F.col(key) <= F.lit(upto)).dropDuplicates([key]).orderBy(key).limit(limit)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` lacks (whatever the case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


TextFn = Callable[[list], Sequence[Sequence]]


def map_text(
    df: DataFrame,
    text_col: str,
    make: Callable[[], TextFn],
    fields: Sequence[T.StructField],
    keep: Sequence[str],
) -> DataFrame:
    """Pass ``keep`` through and append ``fields`` computed from whole texts.

    ``make`` runs once for each partition and returns a function from a list of
    texts (or None) to one list of values for each field.  A kept column with
    the name of a new field is replaced.  Narrow: no shuffle.
    """
    ship(df.sparkSession)
    names = {f.name for f in fields}
    keep = [c for c in keep if c not in names]
    position = {c: i for i, c in enumerate(keep)}
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias(fresh(df, "__text")))
    schema = T.StructType([source.schema[c] for c in keep] + list(fields))
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in fields]
    labels = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(at, CHUNK_ROWS)
                columns = fn(part.column(part.num_columns - 1).to_pylist())
                arrays = [part.column(position[c]) for c in keep]
                arrays += [pa.array(c, type=t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *labels])

    return source.mapInArrow(run, schema)


def filter_texts(df: DataFrame, text_col: str, make: Callable[[], Callable[[list], Sequence[bool]]]) -> DataFrame:
    """The rows of ``df`` whose text the predicate keeps, with all columns as they are.  Narrow."""
    ship(df.sparkSession)
    names = df.columns
    at_text = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(at, CHUNK_ROWS)
                kept = part.filter(pa.array(list(fn(part.column(at_text).to_pylist())), pa.bool_()))
                if kept.num_rows:
                    yield kept

    return df.mapInArrow(run, df.schema)


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, True)
