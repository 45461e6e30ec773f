"""Shared pieces: readers, written intermediate tables, and column idioms."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word-based operator: blank, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Unset, a local master gets a new temporary folder; on any other master that is an error, because
    executors there cannot see the driver's disk.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor shares")
    made = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, **options)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._written_to = path
    return written


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that ``materialize`` wrote, once nothing will read them again."""
    for df in tables:
        path = getattr(df, "_written_to", None)
        if path:
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def short_batches(spark: SparkSession) -> None:
    """Fewer rows a batch to Python than Spark's standard 10,000, which of long texts are tens of MB in the executor's JVM
    and in its worker. A value that the session has set otherwise stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "2000")


def hand_back() -> None:
    """Gives memory that this process has freed back to the system; without glibc only what Arrow holds."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def handing_back(run):
    """``run``, a function for ``mapInArrow``, with ``hand_back`` at the end of each partition.

    Spark keeps a worker for later tasks, and what an idle one holds counts as its executor's memory.
    """

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            hand_back()

    return whole


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
