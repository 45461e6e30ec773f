"""Readers and sinks."""

from __future__ import annotations

import hashlib
import json
import math
import os
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_raw_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as text with no null inference: NA stays text, empty stays empty; gzip by name."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False).csv(path)
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def read_typed(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet, or CSV with an explicit schema; only ``columns`` are read."""
    rows = spark.read.schema(schema).parquet(path) if not path.endswith((".csv", ".csv.gz")) else spark.read.schema(schema).option("header", True).csv(path)
    return rows.select(*columns) if columns else rows


def read_json(path: str):
    return json.loads(Path(path).read_text())


def write_table(df: DataFrame, path: str, partitions: list[str] | None = None) -> None:
    df.write.mode("overwrite").partitionBy(*(partitions or [])).parquet(path)


def write_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int) -> None:
    """A table of the catalogue that is hashed and sorted by ``keys``: tables with the same keys and buckets join, and
    are grouped, without an exchange."""
    df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)


def significant(x: Column, digits: int) -> Column:
    """A number's text with so many significant digits, as C's ``%.{digits}g`` writes its exact binary value.

    Java's formats round the shortest decimal text instead, so this is a small vectorised Python function.
    """
    @F.pandas_udf("string")
    def text(values: pd.Series) -> pd.Series:
        return values.map(lambda v: f"{v:.{digits}g}", na_action="ignore")

    return F.when(F.isnan(x), "nan").otherwise(text(x.cast("double")))


def write_stamped_csv(df: DataFrame, path: str, status: str, digits: int = 10) -> None:
    """CSV whose first column says what standing its numbers have; doubles have ``digits`` significant digits."""
    own = [significant(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(F.lit(status).alias("analysis_status"), *own).write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def write_stable_csv(df: DataFrame, path: str, order: list[str], places: int | None = None, digits: int | None = None) -> None:
    """Gzip CSV whose part files, read in name order, have the same bytes for the same rows.

    Rows are range-sorted by ``order`` (all columns break ties), nulls are empty, and doubles are written with
    ``places`` decimal places, ``digits`` significant digits (17 read back to the same number everywhere) or, by
    default, as the shortest text that reads back to the same number.
    """
    text = lambda c, t: significant(F.col(c), digits) if t == "double" and digits is not None else F.format_string(f"%.{places}f", c) if t == "double" and places is not None else F.col(c).cast("string")
    rest = [c for c in df.columns if c not in order]
    rows = df.orderBy(*order, *rest).select(*[F.when(F.col(c).isNotNull(), text(c, t)).alias(c) for c, t in df.dtypes])
    rows.write.mode("overwrite").option("header", True).option("compression", "gzip").option("emptyValue", '""').option("nullValue", "").csv(path)


def require_hash(path: str, expected: str) -> None:
    """Fails unless the file's SHA-256 is the expected one."""
    found = file_hash(path)
    if found != expected:
        raise ValueError(f"{path}: SHA-256 {found}, expected {expected}")


def content_hash(df: DataFrame) -> DataFrame:
    """One row (rows, hash): a hash of the contents that no order of rows or files changes."""
    h = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda at: F.sum(F.conv(F.substring("h", at, 8), 16, 10).cast("decimal(38,0)"))
    return df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.concat_ws(":", *[part(i).cast("string") for i in (1, 9, 17, 25, 33, 41, 49, 57)]), 256).alias("hash"))


def strict_json(value):
    """Non-finite numbers as null; truth values stay what they are."""
    if isinstance(value, dict):
        return {str(k): strict_json(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [strict_json(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value


def write_json(value, path: str) -> None:
    """Written beside and moved into place, so readers see the old document or the new one."""
    beside = f"{path}.tmp"
    Path(beside).write_text(json.dumps(strict_json(value), indent=2, sort_keys=True, allow_nan=False) + "\n")
    os.replace(beside, path)


def file_hash(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def fingerprint(document) -> str:
    """SHA-256 of a document as canonical JSON."""
    return hashlib.sha256(json.dumps(document, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def markdown_table(df: DataFrame, most: int = 200) -> str:
    """A small result as Markdown; more than ``most`` rows is an error, so nothing large is collected."""
    rows = df.take(most + 1)
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    show = lambda v: "NA" if v is None or isinstance(v, float) and not math.isfinite(v) else f"{v:.6f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows]) + "\n"
