"""Small files and moves on whatever file system the session reads, by Hadoop's own client on the driver."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below ``spark.checkpoint.dir``, which all executors share; on a local master without that
    setting below a new temporary folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor shares")
        root = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _at(spark, path)
    return fs.exists(place)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none if it does not exist."""
    fs, place = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, place = _at(spark, path)
    fs.delete(place, True)


def replace(spark: SparkSession, source: str, target: str) -> None:
    """Moves a folder or file to ``target``. What stood there is kept aside until the move is made."""
    fs, new = _at(spark, source)
    _, old = _at(spark, target)
    aside = f"{target.rstrip('/')}.{uuid.uuid4().hex}.old" if fs.exists(old) else None
    _, kept = _at(spark, aside or target)
    if aside and not fs.rename(old, kept):
        raise OSError(f"{target} could not be set aside")
    if not fs.rename(new, old):
        if aside:
            fs.rename(kept, old)
        raise OSError(f"{source} could not be moved to {target}")
    if aside:
        fs.delete(kept, True)


def write_text(spark: SparkSession, path: str, text: str, *, only_new: bool = False) -> bool:
    """Written beside and moved into place. With ``only_new`` a file that is there stays, and the result is False."""
    fs, place = _at(spark, path)
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    _, new = _at(spark, beside)
    stream = fs.create(new)
    stream.write(bytearray(text.encode()))
    stream.close()
    if only_new:
        moved = not fs.exists(place) and fs.rename(new, place)
        if not moved:
            fs.delete(new, False)
        return moved
    replace(spark, beside, path)
    return True


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, place = _at(spark, path)
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, document, **options) -> bool:
    return write_text(spark, path, json.dumps(document, sort_keys=True, indent=2, allow_nan=False) + "\n", **options)


def read_json(spark: SparkSession, path: str):
    text = read_text(spark, path)
    return None if text is None else json.loads(text)
