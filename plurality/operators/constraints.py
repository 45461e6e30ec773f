"""Constraints as tables of violations; ``assert_empty`` makes one loud."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurality.functions import exprs as X


class ConstraintError(ValueError):
    pass


def assert_empty(violations: DataFrame, what: str) -> None:
    found = violations.take(3)
    if found:
        raise ConstraintError(f"{what}: {[r.asDict() for r in found]}")


def require_columns(df: DataFrame, columns) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ConstraintError(f"missing columns: {missing}")


def forbid_name_parts(df: DataFrame, parts) -> None:
    """No column name may hold one of these words (privacy of exports)."""
    import re

    bad = [c for c in df.columns if set(re.split("[^a-z0-9]+", c.lower())) & set(parts)]
    if bad:
        raise ConstraintError(f"forbidden columns: {bad}")


def blank_rows(df: DataFrame, columns) -> DataFrame:
    return df.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() | (X.strip(F.col(c)) == "") for c in columns]))


def unknown_values(df: DataFrame, column: str, allowed) -> DataFrame:
    return df.select(column).distinct().filter(~F.col(column).isin(list(allowed)))


def label_spellings(df: DataFrame, column: str, wanted) -> DataFrame:
    """(label, spellings) of the wanted labels that do not occur in exactly one spelling, whatever case or blanks."""
    found = df.select(F.lower(X.strip(F.col(column))).alias("label"), F.col(column).alias("_s")).groupBy("label").agg(F.countDistinct("_s").alias("spellings"))
    labels = df.sparkSession.createDataFrame([(w.strip().lower(),) for w in wanted], "label string")
    return labels.join(found, "label", "left").select("label", F.coalesce("spellings", F.lit(0)).alias("spellings")).filter("spellings <> 1")


def join_one_to_one(left: DataFrame, right: DataFrame, key) -> DataFrame:
    """The inner join of two tables of which each has a key once; repeated keys on a side are an error before it.

    One aggregate over the keys of both sides finds them.
    """
    sides = left.select(*key, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(right.select(*key, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    counts = sides.groupBy(*key).agg(F.sum("_l").alias("left"), F.sum("_r").alias("right"))
    found = counts.filter("left > 1 OR right > 1").take(3)
    if found:
        names = [n for n in ("left", "right") if any(r[n] > 1 for r in found)]
        raise ConstraintError(f"repeated keys on the {' and '.join(names)} side: {[r.asDict() for r in found]}")
    return left.join(right, key, "inner")


def group_sizes_outside(df: DataFrame, column: str, bounds: dict[str, tuple[int, int]]) -> DataFrame:
    """(group, rows) of the groups in ``bounds`` whose number of rows lies outside its (least, most); absent groups have 0."""
    limits = df.sparkSession.createDataFrame([(k, *v) for k, v in bounds.items()], "group string, least bigint, most bigint")
    sizes = df.groupBy(F.col(column).cast("string").alias("group")).agg(F.count(F.lit(1)).alias("rows"))
    return limits.join(sizes, "group", "left").withColumn("rows", F.coalesce("rows", F.lit(0))).filter("rows < least or rows > most").select("group", "rows")


def duplicate_keys(df: DataFrame, key) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def out_of_range(df: DataFrame, columns) -> DataFrame:
    return df.filter(reduce(lambda a, b: a | b, [~X.in_unit(F.col(c)) for c in columns]))


def not_whole(df: DataFrame, column: str, least: int) -> DataFrame:
    return df.filter(~F.coalesce(X.is_whole(F.col(column)) & (F.col(column) >= least), F.lit(False)))


def unmatched(left: DataFrame, right: DataFrame, key) -> DataFrame:
    return left.join(right, key, "left_anti")


def shared_keys(left: DataFrame, right: DataFrame, key) -> DataFrame:
    return left.select(*key).intersect(right.select(*key))


def several_values(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.countDistinct(column).alias("values")).filter("values <> 1")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b).unionByName(b.subtract(a))


def exactly_one(df: DataFrame) -> DataFrame:
    """The single row of ``df``; any other number of rows is an error when it is read."""
    first = [F.first(c).alias(c) for c in df.columns]
    return df.agg(F.count(F.lit(1)).alias("_n"), *first).filter(F.assert_true(F.col("_n") == 1, F.lit("not exactly one row")).isNull()).drop("_n")
