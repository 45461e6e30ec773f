"""Statistics as grouped aggregates over (key, value) counts.

Ranks never sort all rows of a key in one task: rows are first counted by value, values are range-sorted over as many
partitions as shuffles have, and partition totals get the running sums; rows inside a partition follow.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, keys: list[str], bucket: Column, order: list, value: str, out: str, whole: str | None = None, under: int | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the key before this one, in ``order``; and ``whole``, the key's sum.

    ``bucket`` must not fall along that order. Two windows: one over the buckets of a key, one in a bucket. ``under``
    leaves out buckets with that sum or more before them, before their rows are sorted; there must be few buckets.
    """
    placed = df.withColumn("_bucket", bucket)
    group = [*keys, "_bucket"]
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(*keys) if keys else Window.partitionBy()
    across = every.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*group).agg(F.sum(value).alias("_total")).withColumn("_before", F.coalesce(F.sum("_total").over(across), F.lit(0)))
    totals = (totals.withColumn(whole, F.sum("_total").over(every)) if whole else totals).drop("_total")
    own = F.sum(value).over(inside) - F.col(value)
    if under is None:
        met = placed.withColumn("_own", own).join(totals, group)
    else:
        met = placed.join(F.broadcast(totals.filter(F.col("_before") < under)), group).withColumn("_own", own)
    return met.withColumn(out, F.col("_own") + F.col("_before")).drop("_bucket", "_own", "_before")


def ranged(df: DataFrame, order: list) -> DataFrame:
    """``df`` range-sorted by ``order``, with ``_part`` and ``_row``: the partition, and the row's number in it from 0.

    Spark samples the bounds, so partitions are even and their number is ``spark.sql.shuffle.partitions``. The table is
    kept: bounds sampled again for another branch would part the rows differently.
    """
    at = F.monotonically_increasing_id()  # the partition above bit 33, the row's number in it below
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at)
    return shared(placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_row", F.col("_at").bitwiseAND((1 << 33) - 1)))


def global_rank(df: DataFrame, score: str | None, id_col: str, *, keys=(), descending=False, out="rank") -> DataFrame:
    """Adds ``out`` = 1, 2, ... by score, then by id; null scores stand first. ``id_col`` tells the rows of a key apart.

    All keys are ranked in one range sort: a row's place is its number in its partition, after the rows of the
    partitions before, less the place of its key's first row. Only counts of partitions meet in one window.
    """
    keys = list(keys)
    s = [] if score is None else [-F.col(score) if descending else F.col(score)]
    placed = ranged(df.withColumn("_s", s[0] if s else F.lit(0)), [*keys, "_s", id_col])
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    parts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", before.alias("_before"))
    ranked = placed.join(parts, "_part")
    if keys:
        first = placed.groupBy(*keys).agg(F.min("_at").alias("_first")).withColumn("_part", F.shiftright("_first", 33)).join(parts, "_part")
        start = first.select(*keys, (F.col("_before") + F.col("_first").bitwiseAND((1 << 33) - 1)).alias("_start"))
        ranked = ranked.join(start, keys)
    start = F.col("_start") if keys else F.lit(0)
    return ranked.withColumn(out, F.col("_before") + F.col("_row") + 1 - start).select(*df.columns, out)


def average_ranks(counts: DataFrame, keys: list[str], value: str, weight: str, out: str, *, centred: bool = False) -> DataFrame:
    """(keys, value, out): the mean rank of each distinct value, ties sharing it; ``centred``: less the mean of the key's ranks."""
    by_value = ranged(counts.groupBy(*keys, value).agg(F.sum(weight).alias("_w")), [*keys, value])
    ranked = running_total(by_value, keys, F.col("_part"), [F.col(value)], "_w", "_below", "_all" if centred else None)
    return ranked.select(*keys, value, (F.col("_below") + (F.col("_w") - (F.col("_all") if centred else F.lit(-1))) / 2).alias(out))


def shared(df: DataFrame) -> DataFrame:
    """Kept for the several branches of a query that read it; what is lost with an executor is computed again."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def counted(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, count), kept for the branches that read it: shares and probabilities lie on few values."""
    return shared(df.groupBy(*keys).count())


def usable(*cols: str) -> Column:
    """Whether all are finite numbers; one comparison each, for null and NaN fail it too (NaN is above infinity)."""
    return reduce(lambda a, b: a & b, [F.abs(c) < float("inf") for c in cols])


def spearman(df: DataFrame, keys: list[str], x: str, y: str, out: str = "rho", weight: str | None = None) -> DataFrame:
    """Rank correlation for each key over rows with both values; null below three rows or for a constant side.

    Ranks are taken less their mean, so a constant side has exactly zero variance and no sum nears the cube of the rows.
    """
    w = F.col(weight) if weight else F.lit(1)
    pairs = df.filter(usable(x, y)).select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), w.cast("bigint").alias("_n"))
    pairs = shared(pairs.groupBy(*keys, "_x", "_y").agg(F.sum("_n").alias("_n")))
    # Both sides are ranked, and meet their ranks, in one pass.
    side = lambda name: F.struct(F.lit(name).alias("_side"), F.col(f"_{name}").alias("_v"))
    sides = pairs.select(*keys, "_x", "_y", "_n", F.inline(F.array(side("x"), side("y"))))
    met = sides.join(average_ranks(sides, [*keys, "_side"], "_v", "_n", "_r", centred=True), [*keys, "_side", "_v"])
    rank_of = lambda name: F.max(F.when(F.col("_side") == name, F.col("_r")))
    ranked = met.groupBy(*keys, "_x", "_y", "_n").agg(rank_of("x").alias("_rx"), rank_of("y").alias("_ry"))
    sums = ranked.groupBy(*keys).agg(
        F.sum("_n").alias("_c"),
        F.sum(F.col("_n") * F.col("_rx") * F.col("_ry")).alias("_xy"),
        F.sum(F.col("_n") * F.col("_rx") * F.col("_rx")).alias("_xx"),
        F.sum(F.col("_n") * F.col("_ry") * F.col("_ry")).alias("_yy"),
    )
    rho = F.try_divide(F.col("_xy"), F.sqrt("_xx") * F.sqrt("_yy"))
    return sums.select(*keys, F.when(F.col("_c") >= 3, rho).alias(out))


def auc(df: DataFrame, keys: list[str], positive: str, score: str, out: str = "auc", weight: str | None = None) -> DataFrame:
    """Area under the ROC curve by mean ranks; null where a class is empty."""
    w = F.col(weight) if weight else F.lit(1)
    rows = df.filter(usable(score) & F.col(positive).isNotNull()).select(*keys, F.col(positive).cast("boolean").alias("_y"), F.col(score).cast("double").alias("_x"), w.cast("bigint").alias("_n"))
    rows = shared(rows.groupBy(*keys, "_y", "_x").agg(F.sum("_n").alias("_n")))
    ranked = rows.join(average_ranks(rows, keys, "_x", "_n", "_r"), [*keys, "_x"])
    one = F.when(F.col("_y"), F.col("_n")).otherwise(0)
    sums = ranked.groupBy(*keys).agg(F.sum(one * F.col("_r")).alias("_rank"), F.sum(one).cast("double").alias("_p"), F.sum("_n").alias("_all"))
    p, n = F.col("_p"), F.col("_all") - F.col("_p")
    return sums.select(*keys, F.try_divide(F.col("_rank") - p * (p + 1) / 2, p * n).alias(out))


def weighted_line(df: DataFrame, keys: list[str], x: str, y: str, weight: str) -> DataFrame:
    """Weighted least squares of y on x: (keys, n, weight_sum, intercept, slope); slope 0 if x hardly varies."""
    w = F.col(weight)
    means = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("weight_sum"), (F.sum(w * F.col(x)) / F.sum(w)).alias("_mx"), (F.sum(w * F.col(y)) / F.sum(w)).alias("_my"))
    dx, dy = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")
    sums = df.join(means, keys).groupBy(*keys, "n", "weight_sum", "_mx", "_my").agg(F.sum(w * dx * dy).alias("_xy"), F.sum(w * dx * dx).alias("_xx"))
    slope = F.when(F.col("_xx") <= 1e-12 * F.greatest(F.col("weight_sum"), F.lit(1)), F.lit(0.0)).otherwise(F.col("_xy") / F.col("_xx"))
    return sums.withColumn("slope", slope).select(*keys, "n", "weight_sum", (F.col("_my") - F.col("slope") * F.col("_mx")).alias("intercept"), "slope")


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(weight))


def counted_mean(value: Column, count: str = "count") -> Column:
    """The mean over rows that stand for ``count`` each; null values are left out."""
    return F.try_divide(F.sum(value * F.col(count)), F.sum(F.when(value.isNotNull(), F.col(count))))


def interval(value: str) -> list[Column]:
    """Bounds of the central 95%, linearly interpolated."""
    return [F.expr(f"percentile({value}, 0.025)").alias("ci95_low"), F.expr(f"percentile({value}, 0.975)").alias("ci95_high")]


def equal_frequency_bins(df: DataFrame, keys: list[str], score: str, id_col: str, bins: int = 10, out="bin") -> DataFrame:
    """Adds ``out``: floor(i * B / N) by (score, id), B = min(bins, N). (ntile deals remainders otherwise.)"""
    ranked = global_rank(df, score, id_col, keys=keys, out="_rank")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    b = F.least(F.lit(bins), F.col("_n"))
    return ranked.join(sizes, keys).withColumn(out, F.floor((F.col("_rank") - 1) * b / F.col("_n"))).drop("_rank", "_n")


def with_macro(df: DataFrame, key: str, values: list[str], by=()) -> DataFrame:
    """Adds rows ``macro``: the plain means of the keys' values (not a pooled statistic); ``df`` has one row a key.

    Each row goes to its own group and to the macro's, so ``df`` is computed once.
    """
    both = df.select(*by, F.explode(F.array(F.col(key), F.lit("macro"))).alias(key), *values)
    return both.groupBy(*by, key).agg(*[F.avg(v).alias(v) for v in values])
