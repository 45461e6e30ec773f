"""Constraint suites: any number of rules over one frame, decided in one aggregate or on the write itself.

A rule is an aggregate over the frame and what it must come to. ``report`` compiles a suite into a single
aggregation, so the frame is read once whatever the rules; ``write_checked`` observes the same aggregates while the
frame is written, so an export that breaks a rule never becomes visible and nothing is read again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from plurality.functions import exprs as X
from plurality.operators.constraints import ConstraintError, forbid_name_parts
from plurality.sources import storage

_COPIES = "_copies_of_key"


@dataclass(frozen=True)
class Rule:
    """``found`` is an aggregate that must equal ``wanted``; ``keys`` names the columns of a uniqueness rule instead."""

    name: str
    found: Column | None
    wanted: int
    keys: tuple[str, ...] = ()


def broken_by(name: str, bad: Column) -> Rule:
    """No row may be ``bad``; a null counts as bad."""
    return Rule(name, F.count_if(F.coalesce(bad, F.lit(True))), 0)


def row_count(rows: int) -> Rule:
    return Rule(f"{rows} rows", F.count(F.lit(1)), rows)


def unique(*keys: str) -> Rule:
    """Every row has the key, and no two rows share it: ``found`` is the rows that lack it or repeat it."""
    return Rule(f"unique {', '.join(keys)}", None, 0, keys)


def present(*columns: str) -> list[Rule]:
    return [broken_by(f"{c} present", F.col(c).isNull()) for c in columns]


def in_unit(*columns: str) -> list[Rule]:
    """Numbers from 0 to 1; null and NaN break it. Text is read as a number."""
    return [broken_by(f"{c} in [0, 1]", ~X.in_unit(F.col(c).try_cast("double"))) for c in columns]


def whole(column: str, least: int) -> Rule:
    number = F.col(column).try_cast("double")
    return broken_by(f"{column} whole, {least} or more", ~(X.is_whole(number) & (number >= least)))


def only(column: str, value: str) -> list[Rule]:
    """``value`` is the one value of the column beside null, and stands somewhere."""
    text = F.col(column).cast("string")
    return [Rule(f"{column} only {value}", F.count_if(text != value), 0), Rule(f"{column} has {value}", F.max((text == value).cast("int")), 1)]


def flagged(column: str, rows: int | None = None) -> Rule:
    """As many rows as said have the flag; by default all. Text flags count if they read true."""
    on = F.coalesce(X.as_bool(F.col(column).cast("string")), F.lit(False))
    return broken_by(f"{column} everywhere", ~on) if rows is None else Rule(f"{rows} rows {column}", F.count_if(on), rows)


def flat(rules: Iterable) -> list[Rule]:
    return [r for x in rules for r in ([x] if isinstance(x, Rule) else x)]


def _key(keys) -> Column:
    """The key as one value; null where any part is."""
    whole_key = F.when(~F.exists(F.array(*[F.col(k).isNull() for k in keys]), lambda x: x), F.struct(*keys))
    return whole_key if len(keys) > 1 else F.col(keys[0])


def report(df: DataFrame, rules: Iterable) -> DataFrame:
    """``rule, found, wanted, holds`` for each rule, from one aggregation over ``df``: one scan, whatever the rules.

    Rows of a null key and rows over the first of a repeated key count as found. Distinct counts of several
    different keys make Spark expand the rows, once for each key.
    """
    rules = flat(rules)
    found = [(F.count(F.lit(1)) - F.count_distinct(_key(r.keys)) if r.keys else F.coalesce(r.found, F.lit(0))).cast("bigint").alias(f"r{i}") for i, r in enumerate(rules)]
    wide = df.agg(*found)
    rows = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"r{i}").alias("found"), F.lit(r.wanted).cast("bigint").alias("wanted")) for i, r in enumerate(rules)])
    return wide.select(F.inline(rows)).withColumn("holds", F.col("found") == F.col("wanted"))


def _refuse(broken: list[tuple[str, int, int]]) -> None:
    if broken:
        raise ConstraintError("; ".join(f"{name}: found {found}, wanted {wanted}" for name, found, wanted in broken))


def require(df: DataFrame, rules: Iterable) -> None:
    """Fails with every broken rule of the suite."""
    _refuse([(r["rule"], r["found"], r["wanted"]) for r in report(df, rules).filter("NOT holds").collect()])


def write_checked(df: DataFrame, path: str, rules: Iterable, *, columns: list[str] | None = None, forbidden=(), format: str = "parquet", **options) -> dict[str, int]:
    """Writes ``df`` to ``path`` only if the suite holds; returns what each rule found.

    The rules are metrics of the write: it goes to a folder beside ``path`` that is moved into place when they
    hold and deleted when not, so there is no second read, and readers never see a frame that breaks a rule. Whatever
    was at ``path`` stays until then. Uniqueness costs one shuffle by the key, of the rows that are written anyway.
    """
    if columns is not None and df.columns != columns:
        raise ConstraintError(f"columns {df.columns}, expected {columns}")
    forbid_name_parts(df, forbidden)
    rules, watched = flat(rules), df
    metrics = []
    for i, r in enumerate(rules):
        if r.keys:  # an observed metric cannot count distinct values: copies are numbered in the rows
            watched = watched.withColumn(f"{_COPIES}{i}", F.row_number().over(Window.partitionBy(*r.keys).orderBy(*r.keys)))
            bad = F.greatest(F.lit(False), *[F.col(k).isNull() for k in r.keys], F.col(f"{_COPIES}{i}") > 1)
            metrics.append(F.count_if(bad).alias(f"r{i}"))
        else:
            metrics.append(r.found.alias(f"r{i}"))
    seen = Observation(f"suite-{uuid.uuid4().hex}")
    out = watched.observe(seen, *metrics).select(*df.columns)
    aside = f"{path.rstrip('/')}.{uuid.uuid4().hex}.pending"
    spark = df.sparkSession
    try:
        out.write.format(format).options(**options).save(aside)
        found = {r.name: int(seen.get[f"r{i}"] or 0) for i, r in enumerate(rules)}
        _refuse([(r.name, found[r.name], r.wanted) for r in rules if found[r.name] != r.wanted])
    except BaseException:
        storage.delete(spark, aside)
        raise
    storage.replace(spark, aside, path)
    return found
