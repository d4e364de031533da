"""What the training-data operators share: Arrow batches, written tables, small helpers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of a slice that an operator works on at once; a single longer text is a slice of its own.
SLICE_ROWS = 500
SLICE_BYTES = 4 << 20
#: Bytes of an Arrow batch between Spark and Python while a table is written; else Spark's own bound, 64 MB, holds.
BATCH_BYTES = 8 << 20
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of bounded rows and bytes, whatever the session's settings make of batches."""
    for batch in batches:
        n = batch.num_rows
        step = max(1, min(rows, n * size // max(1, batch.nbytes)))
        for at in range(0, n, step):
            yield batch.slice(at, step)


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Small Arrow batches for the jobs run inside; the session's own settings return afterwards."""
    before = {k: spark.conf.get(k, None) for k in _BATCH}
    for k, v in _BATCH.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session may do without one."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"/tmp/checkpoints/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more: only those whose readers have been written themselves. The
    collection lets Spark's cleaner delete the shuffle files behind them, too."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def arrow_map(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """One record batch out for each slice of those that come in, in Python workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            if batch.num_rows and (out := make(batch)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's strings, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def free_name(df: DataFrame, name: str) -> str:
    """name, or that with underscores behind, as no column of df is called, upper or lower case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(df: DataFrame, *more: str) -> DataFrame:
    """doc_id as long, text as string and the columns named; whatever else the table has is left behind."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
