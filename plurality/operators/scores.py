"""Long form of shares and probabilities: one row an item and code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEP = ["item_id", "content_id", "bucket", "source", "text", "n_annotators", "n_votes", "confidence_mean"]
SPLIT = ["split", "sensitivity"]


def join_predictions(items: DataFrame, predicted: DataFrame) -> DataFrame:
    return items.join(predicted, "item_id", "inner")


def long_scores(wide: DataFrame, codes: list[str]) -> DataFrame:
    """(item columns, code, h, p, q) from columns human_, p_ and q_ of each code; ``split`` and ``sensitivity`` are kept."""
    rows = F.array(*[F.struct(F.lit(c).alias("code"), F.col(f"human_{c}").alias("h"), F.col(f"p_{c}").alias("p"), F.col(f"q_{c}").alias("q")) for c in codes])
    return wide.select(*KEEP, *[c for c in SPLIT if c in wide.columns], F.inline(rows))


def wide_scores(long: DataFrame, codes: list[str], value: str = "p") -> DataFrame:
    return long.groupBy("item_id").pivot("code", codes).agg(F.first(value))


def any_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))
