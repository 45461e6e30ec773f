"""Deterministic splits that never part equal texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurality.functions import exprs as X
from plurality.functions.stats import running_total, shared


#: Up to so many chosen texts are sent to all items instead of joined by a shuffle of the items.
FEW = 20_000


def select_groups(items: DataFrame, target: int, *, seed: int = 42, namespace: str = "dev", text: str = "text") -> DataFrame:
    """Texts taken whole, in the order of their hash, while fewer than ``target`` items were taken before."""
    groups = items.groupBy(text).agg(F.count(F.lit(1)).alias("size")).withColumn("rank_key", X.hash_rank(namespace, seed, F.col(text)))
    ordered = running_total(groups, [], F.substring("rank_key", 1, 3), ["rank_key", text], "size", "taken_before", under=target)
    return ordered.filter(F.col("taken_before") < target).select(text, "size", "taken_before")


def assign(items: DataFrame, dev_target: int, sensitivity_target: int, *, seed: int = 42, text: str = "text") -> DataFrame:
    """Adds ``split`` (dev or test) and ``sensitivity`` (a subset of test)."""
    few = lambda chosen, target: F.broadcast(shared(chosen)) if target <= FEW else chosen  # noqa: E731  (at most ``target`` texts)
    dev = select_groups(items, dev_target, seed=seed, text=text).select(text, F.lit(True).alias("_dev"))
    split = items.join(few(dev, dev_target), text, "left").withColumn("split", F.when(F.col("_dev"), "dev").otherwise("test")).drop("_dev")
    strict = select_groups(split.filter("split = 'test'"), sensitivity_target, seed=seed, namespace="sensitivity", text=text).select(text, F.lit(True).alias("_s"))
    return split.join(few(strict, sensitivity_target), text, "left").withColumn("sensitivity", F.coalesce("_s", F.lit(False)) & (F.col("split") == "test")).drop("_s")


def leaks(split: DataFrame, text: str = "text") -> DataFrame:
    """Texts in more than one split; must be empty."""
    return split.groupBy(text).agg(F.countDistinct("split").alias("splits")).filter("splits > 1")


def hash_threshold(items: DataFrame, share: float, salt: str, text: str = "text") -> DataFrame:
    """Adds ``split`` by a salted hash of the text alone: no shuffle, the same for any other data."""
    key = F.sha2(F.concat(F.lit(salt), F.col(text)), 256)
    return items.withColumn("split", F.when(X.below_share(key, share), "dev").otherwise("test"))
