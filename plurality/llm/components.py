"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum and a join; nothing about the graph reaches the driver but one count a round.
Tables are written between rounds, so lineage stays short and both join sides are fresh exchanges, which lets
Spark split the rows of a hub node over tasks; a round's tables are deleted when the next stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurality.llm.common import discard, materialize

MAX_ROUNDS = 60


def _unsettled(down: DataFrame) -> DataFrame:
    """Nodes that keep ``down`` from being stars: with two nodes below them, or one below and one above."""
    end = lambda c, up: F.struct(F.col(c).alias("x"), F.lit(up).alias("up"))
    ends = down.select(F.inline(F.array(end("u", 1), end("v", 0))))
    return ends.groupBy("x").agg(F.sum("up").alias("below"), F.min("up").alias("least")).filter("below > 1 OR (below = 1 AND least = 0)")


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``: component is the smallest node reachable.

    Edges are undirected; repeats and loops do no harm; nodes without an edge are the caller's to add.
    """
    down = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    down = materialize(down, "cc-edges")
    for _ in range(MAX_ROUNDS):
        # Large star: each node hands its larger neighbours the smallest node it sees.
        both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        seen = materialize(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")), "cc-least")
        large = both.filter("v > u").join(seen, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "cc-large")
        # Small star: each node ties its smaller neighbours, and itself, to the smallest of them.
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "cc-small")
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        last, down = down, materialize(small, "cc-edges")
        discard(last, seen, large, least)
        if _unsettled(down).count() == 0:
            break
    else:
        raise RuntimeError("components did not settle")
    tops = down.select(F.col("v").alias("node")).distinct()
    return down.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops.select("node", F.col("node").alias("component")))
