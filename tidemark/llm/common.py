"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a job sends to Python at a time.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
#: ASCII white space; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    Only in local mode may that setting be absent: a temporary folder then takes its place. On
    a cluster such a folder would be another one on each machine, and lose rows: an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Jobs inside send so many rows at a time to Python: whole texts are long rows."""
    before = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH, before) if before else spark.conf.unset(BATCH)


def written(df: DataFrame, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """The rows of ``df``, written to the shared folder and read back: the lineage ends there."""
    spark = df.sparkSession
    path = shared_folder(spark)
    with batches_of(spark, batch_rows):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes the folders of frames that ``written`` returned, once what was made from them is written.

    The driver's garbage goes too: with it, Spark drops the shuffle files of finished jobs.
    """
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()


def release() -> None:
    """Gives back the memory that earlier jobs left in this Python worker, which Spark uses again."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not with every C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many ``_`` after it as tell it from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words(text: Column) -> Column:
    """The maximal runs of characters that are not ASCII white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, whatever the optimizer merges."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of text in the table: one number, which sizes partitions and blocks."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(column).cast("long")), F.lit(0)).alias("b")).first()["b"]
