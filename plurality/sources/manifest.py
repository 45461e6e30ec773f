"""Manifests: the hash of every file below a folder, computed in tasks, and what differs from one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files up to this many bytes are hashed whole by Spark itself; larger ones in chunks, one at a time in a task.
WHOLE, CHUNK = 64 << 20, 1 << 20


def _chunked(frames):
    import hashlib

    from pyarrow import fs

    for rows in frames:
        hashes = []
        for uri in rows["uri"]:
            system, at = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))
            digest = hashlib.sha256()
            with system.open_input_stream(at) as f:
                while chunk := f.read(CHUNK):
                    digest.update(chunk)
            hashes.append(digest.hexdigest())
        yield rows[["uri", "bytes"]].assign(sha256=hashes)


def manifest(spark: SparkSession, folder: str, *, names: str = "*", whole: int = WHOLE) -> DataFrame:
    """``path, bytes, sha256`` of every file below ``folder`` that has bytes, paths relative to it. As Spark reads
    folders, names with a leading ``_`` or ``.`` are no data.

    Files up to ``whole`` bytes can be in any store that Spark reads; larger ones in those that pyarrow knows
    (local, HDFS, S3, GCS). No file's bytes reach the driver.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(folder)
    uri = F.col("path").alias("uri")
    small = files.filter(F.col("length") <= whole).select(uri, F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = files.filter(F.col("length") > whole).select(uri, F.col("length").alias("bytes"))
    # Dealt by name: a task streams its files one after another.
    both = small.unionByName(large.repartition("uri").mapInPandas(_chunked, "uri string, bytes bigint, sha256 string"))
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = place.getFileSystem(spark._jsc.hadoopConfiguration()).resolvePath(place).toUri().getPath().rstrip("/")
    plain = F.regexp_replace("uri", "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    inside = F.substring("_u", len(root) + 2, 1 << 30)
    return both.withColumn("_u", plain).select(F.when(F.col("_u").startswith(root + "/"), inside).otherwise(F.col("_u")).alias("path"), "bytes", "sha256")


def differences(listed: DataFrame, found: DataFrame) -> DataFrame:
    """``path, problem`` where two manifests disagree: ``missing`` or ``changed`` files of ``listed``, and ``unlisted`` ones."""
    a, b = listed.select("path", F.col("sha256").alias("_a")), found.select("path", F.col("sha256").alias("_b"))
    problem = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "unlisted").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, "path", "full").select("path", problem.alias("problem")).filter("problem IS NOT NULL")
