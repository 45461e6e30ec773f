"""A pinned snapshot as a source: ``spark.read.format("pinned_snapshot").option("revision", ...).load(folder)``.

A snapshot is a folder of Parquet part files and ``snapshot.json``, which names its revision and has each file's
SHA-256, rows and smallest and largest values. It is written once. Reading it refuses another revision than the one
asked for, and each task checks its file's hash in chunks before it hands out a row. Comparisons of a column
with a value skip files whose range excludes it; Spark applies them to the rows that are left.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from plurality.sources import storage

ABOUT = "snapshot.json"
_RANGED = ("string", "bigint", "int", "smallint", "tinyint", "double", "float", "date")


class SnapshotError(RuntimeError):
    pass


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _about(path: str) -> dict:
    system, at = _open(f"{path}/{ABOUT}")
    with system.open_input_stream(at) as f:
        return json.loads(f.read())


class _File(InputPartition):
    def __init__(self, name: str, sha256: str) -> None:
        super().__init__(name)
        self.name, self.sha256 = name, sha256


class _Reader(DataSourceReader):
    def __init__(self, path: str, about: dict, names: list[str]) -> None:
        self.path, self.about, self.names, self.tests = path, about, names, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        kinds = (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)
        self.tests = [f for f in filters if isinstance(f, kinds) and len(f.attribute) == 1]
        yield from filters  # a file's range is no proof for its rows

    def _may_hold(self, ranges: dict, test: Filter) -> bool:
        low, high = ranges.get(test.attribute[0], (None, None))
        if low is None:
            return True
        values = [v for v in test.value] if isinstance(test, In) else [test.value]
        if not all(isinstance(v, type(low)) or isinstance(v, (int, float)) and isinstance(low, (int, float)) for v in values):
            return True
        if isinstance(test, (EqualTo, In)):
            return any(low <= v <= high for v in values)
        v = values[0]
        return {GreaterThan: high > v, GreaterThanOrEqual: high >= v, LessThan: low < v, LessThanOrEqual: low <= v}[type(test)]

    def partitions(self) -> list[InputPartition]:
        found = [_File(f["name"], f["sha256"]) for f in self.about["files"] if all(self._may_hold(f["ranges"], t) for t in self.tests)]
        return found or [_File("", "")]

    def read(self, partition: _File):
        import hashlib

        import pyarrow.parquet as pq

        if not partition.name:
            return
        system, at = _open(f"{self.path}/{partition.name}")
        digest = hashlib.sha256()
        with system.open_input_stream(at) as f:
            while chunk := f.read(1 << 20):
                digest.update(chunk)
        if digest.hexdigest() != partition.sha256:
            raise SnapshotError(f"{partition.name} is not the file of the snapshot: SHA-256 {digest.hexdigest()}, expected {partition.sha256}")
        with system.open_input_file(at) as f:
            yield from pq.ParquetFile(f).iter_batches(columns=self.names)


class PinnedSnapshot(DataSource):
    """Options: ``path``, ``revision`` (must be the snapshot's), ``columns`` (those that must be there, by comma)."""

    @classmethod
    def name(cls) -> str:
        return "pinned_snapshot"

    def _checked(self) -> dict:
        about = _about(self.options["path"])
        if "revision" not in about:
            raise SnapshotError("the snapshot does not say its revision")
        wanted = self.options.get("revision")
        if wanted is None or about["revision"] != wanted:
            raise SnapshotError(f"revision {about['revision']}, pinned {wanted}")
        missing = {c for c in self.options.get("columns", "").split(",") if c} - {f["name"] for f in json.loads(about["schema"])["fields"]}
        if missing:
            raise SnapshotError(f"missing columns: {sorted(missing)}")
        return about

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self._checked()["schema"]))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self._checked(), schema.fieldNames())


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PinnedSnapshot)


def write_snapshot(df: DataFrame, path: str, revision: str, *, order: list[str] | None = None) -> dict:
    """Writes a snapshot and returns what ``snapshot.json`` says. A snapshot that is there is never overwritten.

    ``order`` range-sorts the rows, so that files have narrow ranges. Hashes and ranges are computed in tasks.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    if storage.exists(spark, f"{path}/{ABOUT}"):
        raise SnapshotError(f"{path} holds a snapshot already")
    (df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df).write.mode("overwrite").parquet(path)
    from plurality.sources.manifest import manifest

    ranged = [c for c, t in df.dtypes if t in _RANGED]
    ends = [f(F.col(c)).cast("string" if t == "date" else t).alias(f"{n}_{i}") for i, (c, t) in enumerate(df.dtypes) if t in _RANGED for n, f in (("low", F.min), ("high", F.max))]
    name = F.regexp_extract(F.col("_metadata.file_path"), "[^/]+$", 0)
    stats = spark.read.parquet(path).groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("rows"), *ends)
    dates = {c for c, t in df.dtypes if t == "date"}
    at = {c: i for i, (c, _) in enumerate(df.dtypes)}
    # One row a file reaches the driver, as Spark's own listing of the folder does.
    listed = manifest(spark, path).filter(~F.col("path").startswith("_")).withColumnRenamed("path", "name").join(stats, "name", "left").orderBy("name").collect()
    files = [{"name": r["name"], "sha256": r["sha256"], "rows": r["rows"] or 0, "ranges": {c: [r[f"low_{at[c]}"], r[f"high_{at[c]}"]] for c in ranged if c not in dates and r[f"low_{at[c]}"] is not None and r[f"low_{at[c]}"] == r[f"low_{at[c]}"]}} for r in listed]
    about = {"revision": revision, "rows": sum(f["rows"] for f in files), "schema": df.schema.json(), "files": files}
    storage.write_json(spark, f"{path}/{ABOUT}", about, only_new=True)
    return about
