"""Views that give the driver's tables the shape of a label panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plurality.functions import exprs as X

CODES = ["A", "N", "R", "F", "O", "BULK"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw judgments: each line of an order is a vote of its supplier on the order."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    pair = F.when(F.col("l_linenumber") % 2 == 0, F.concat_ws(",", status, flag)).otherwise(F.concat_ws(",", flag, status))
    level = F.col("l_suppkey") % 4
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("order "), F.col("o_orderkey")).alias("text"),
        F.col("o_orderpriority").alias("source"),
        F.col("o_orderstatus").alias("bucket"),
        F.col("l_suppkey").cast("string").alias("annotator"),
        F.when(F.col("l_quantity") >= 26, F.concat(pair, F.lit(",BULK"))).otherwise(pair).alias("annotation"),
        F.when(level == 0, "Not Confident").when(level == 1, "Somewhat Confident").when(level == 2, "Confident").otherwise("").alias("confidence"),
    )


def stand_in_points(code: str, votes, n):
    """A deterministic stand-in for a model's probability, in two-hundredths."""
    return F.floor(100 * votes / n) + X.hash_int(F.concat(F.lit(f"{code}:"), F.col("text"))) % 101


def prediction_columns(codes: list[str]) -> list:
    """Stand-in probabilities of the canonical (p_) and the strict (q_) wording of each code."""
    points = {c: stand_in_points(c, F.col(f"votes_{c}"), F.col("n_votes")) for c in codes}
    p = [(points[c] / 200).alias(f"p_{c}") for c in codes]
    return p + [(F.floor(4 * points[c] / 5) / 200).alias(f"q_{c}") for c in codes]


def predictions(items: DataFrame, codes: list[str]) -> DataFrame:
    return items.select("item_id", *prediction_columns(codes))


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items of (language, source) cells; texts repeat within and across cells."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.col("lang").alias("bucket"), "source", "text", X.content_id(F.col("text")).alias("content_id"))
