"""Frames that leave the library, and groupings of raw labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plurality.operators.constraints import require_columns


def release_frame(df: DataFrame, columns: list[str], flags: list[str], order: str = "item_id") -> DataFrame:
    """Exactly ``columns``, in that order, those of ``flags`` as truth values, range-sorted by ``order``; a missing column is an error."""
    require_columns(df, columns)
    return df.select(*[F.col(c).cast("boolean").alias(c) if c in flags else F.col(c) for c in columns]).orderBy(order)


def in_group(labels: Column, members: list[str], unclear: Column) -> Column:
    """1 if any of the group's labels was chosen, else 0; null, not 0, where the response is unclear."""
    return F.when(~F.coalesce(unclear, F.lit(False)), F.arrays_overlap(labels, F.array(*map(F.lit, members))).cast("int"))
