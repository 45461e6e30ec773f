"""Uncertainty, loss, calibration and recovery statistics over long scores (item_id, code, h, p, q, ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plurality.functions import exprs as X
from plurality.functions import stats as S

CELL = ["bucket", "source"]


def _h():
    return F.col("h")


def _p():
    return F.col("p")


def _q():
    return F.col("q")


def code_metrics(long: DataFrame) -> DataFrame:
    """Losses of p and of its hard label, and how the uncertainties of p and of the votes rank together.

    Equal rows are counted first, and all else reads the counts.
    """
    counted = S.counted(long, "code", "h", "p")
    rho = S.spearman(counted.select("code", X.entropy(_h()).alias("uh"), X.entropy(_p()).alias("up"), "count"), ["code"], "uh", "up", weight="count")
    rows = counted.groupBy("code").agg(
        F.sum("count").alias("n"),
        S.counted_mean(X.squared(_p(), _h())).alias("squared_loss"),
        S.counted_mean(X.squared(X.hard(_p()), _h())).alias("hard_squared_loss"),
        S.counted_mean(X.absolute(_p(), _h())).alias("absolute_loss"),
        S.counted_mean(X.absolute(X.hard(_p()), _h())).alias("hard_absolute_loss"),
    )
    return rows.join(rho, "code")


def loss_deltas(long: DataFrame) -> DataFrame:
    """Hard label minus probability, squared and absolute, with macro rows."""
    rows = long.groupBy("code").agg(F.avg(X.squared(X.hard(_p()), _h()) - X.squared(_p(), _h())).alias("squared_delta"), F.avg(X.absolute(X.hard(_p()), _h()) - X.absolute(_p(), _h())).alias("absolute_delta"))
    return S.with_macro(rows, "code", ["squared_delta", "absolute_delta"])


def pairwise_association(long: DataFrame) -> DataFrame:
    counted = S.counted(long, "code", "h", "p", "n_annotators")
    pairs = counted.select("code", X.entropy(_p()).alias("u"), F.round(X.disagreement(_h(), F.col("n_annotators")), 12).alias("d"), "count")
    return S.with_macro(S.spearman(pairs, ["code"], "u", "d", weight="count"), "code", ["rho"])


def confidence_association(long: DataFrame) -> DataFrame:
    """One row: rank correlation of an item's mean entropy with its reverse confidence, over items that have one."""
    items = long.groupBy("item_id", "confidence_mean").agg(F.round(F.avg(X.entropy(_p())), 10).alias("u"))
    items = items.select("u", F.round(1 - F.col("confidence_mean"), 10).alias("doubt"))
    return S.spearman(items, [], "u", "doubt")


def cells(long: DataFrame, estimates: dict) -> DataFrame:
    """(bucket, source, code, n, human, and each estimate) in one aggregate."""
    return long.groupBy(*CELL, "code").agg(F.count(F.lit(1)).alias("n"), F.avg(_h()).alias("human"), *[F.avg(x).alias(k) for k, x in estimates.items()])


def cell_errors(cell_table: DataFrame, estimates) -> DataFrame:
    """(method, mae_unweighted, mae_weighted) over cells and codes."""
    rows = F.array(*[F.struct(F.lit(k).alias("method"), F.abs(F.col(k) - F.col("human")).alias("e")) for k in estimates])
    flat = cell_table.select("n", F.inline(rows))
    return flat.groupBy("method").agg(F.avg("e").alias("mae_unweighted"), S.weighted_mean(F.col("e"), F.col("n")).alias("mae_weighted"))


def clustered_cells(long: DataFrame, least: int) -> DataFrame:
    """Cells with at least ``least`` distinct texts."""
    return long.groupBy(*CELL).agg(F.countDistinct("content_id").alias("clusters")).filter(F.col("clusters") >= least)


def item_review(long: DataFrame) -> DataFrame:
    """One row an item: squared errors over all codes and the scores that order its review."""
    return long.groupBy("item_id").agg(
        F.round(F.sum(X.squared(_p(), _h())), 10).alias("sse"),
        F.round(F.avg(X.entropy(_p())), 10).alias("entropy"),
        F.round(F.avg(_p()), 10).alias("mean_p"),
    )


def review_curve(items: DataFrame, n_items: int, n_codes: int, score: str, budgets, *, keys=()) -> DataFrame:
    """(keys, budget, reviewed, mse): error left after the top items by ``score`` were replaced by their votes.

    Reviewed items add nothing, so one ranking gives every budget: the sum of what lies beyond rank k.
    """
    ranked = S.global_rank(items, score, "item_id", keys=keys, descending=True)
    steps = [(b, round(n_items * b / 100)) for b in budgets]
    left = [F.sum(F.when(F.col("rank") > k, F.col("sse")).otherwise(0.0)).alias(f"b{b}") for b, k in steps]
    wide = ranked.groupBy(*keys).agg(*left)
    rows = F.array(*[F.struct(F.lit(b).alias("budget"), F.lit(k).cast("bigint").alias("reviewed"), (F.col(f"b{b}") / (n_items * n_codes)).alias("mse")) for b, k in steps])
    return wide.select(*keys, F.inline(rows))


def wording(long: DataFrame) -> DataFrame:
    """Canonical against strict probabilities of the same items, with macro rows."""
    up, uq, uh = (X.entropy(c).alias(k) for k, c in (("up", _p()), ("uq", _q()), ("uh", _h())))
    values = long.select("code", "h", "p", "q", up, uq, uh)
    rows = values.groupBy("code").agg(
        F.avg(F.abs(_q() - _p())).alias("mean_abs_change"),
        F.avg((X.hard(_p()) != X.hard(_q())).cast("double")).alias("flip_rate"),
        F.avg(X.squared(_p(), _h())).alias("canonical_loss"),
        F.avg(X.squared(_q(), _h())).alias("strict_loss"),
    )
    # The three correlations are one computation over (code, pair).
    named = {"rho_pq": ("p", "q"), "rho_p": ("uh", "up"), "rho_q": ("uh", "uq")}
    pairs = values.select("code", F.inline(F.array(*[F.struct(F.lit(k).alias("pair"), F.col(x).alias("x"), F.col(y).alias("y")) for k, (x, y) in named.items()])))
    rows = rows.join(S.spearman(pairs, ["code", "pair"], "x", "y").groupBy("code").pivot("pair", list(named)).agg(F.first("rho")), "code")
    rows = rows.withColumn("loss_delta", F.col("strict_loss") - F.col("canonical_loss")).withColumn("rho_delta", F.col("rho_q") - F.col("rho_p"))
    return S.with_macro(rows, "code", [c for c in rows.columns if c != "code"])


def strict_summary(long: DataFrame) -> DataFrame:
    rows = long.groupBy("code").agg(F.avg(_h()).alias("mean_h"), F.avg(_p()).alias("mean_p"), F.avg(_q()).alias("mean_q"), F.avg(_p() - _h()).alias("bias_p"), F.avg(_q() - _h()).alias("bias_q"))
    rows = rows.join(S.spearman(long, ["code"], "p", "q"), "code")
    return S.with_macro(rows, "code", [c for c in rows.columns if c != "code"])


def calibration(dev: DataFrame) -> DataFrame:
    """Per code: line of h on p weighted by annotators, and two constants (plain and coder-weighted prevalence)."""
    line = S.weighted_line(dev, ["code"], "p", "h", "n_annotators")
    means = dev.groupBy("code").agg(F.avg(_h()).alias("constant"), S.weighted_mean(_h(), F.col("n_annotators")).alias("coder_constant"))
    return line.join(means, "code")


def calibrate(long: DataFrame, fitted: DataFrame) -> DataFrame:
    """Adds ``calibrated`` (clipped to [0, 1]) and ``constant``; ``fitted`` has one row a code, so it goes to the scores, not they to it."""
    own = long.join(F.broadcast(fitted.select("code", "intercept", "slope", "constant")), "code")
    return own.withColumn("calibrated", X.unit_clip(F.col("intercept") + F.col("slope") * _p())).drop("intercept", "slope")


def methods() -> dict:
    return {"raw": _p(), "hard": X.hard(_p()), "constant": F.col("constant"), "calibrated": F.col("calibrated")}


def compare_methods(calibrated: DataFrame) -> DataFrame:
    """(method, code, losses, bias, two cell errors), with macro rows; methods as rows, one aggregate each."""
    rows = F.array(*[F.struct(F.lit(k).alias("method"), x.alias("e")) for k, x in methods().items()])
    flat = calibrated.select(*CELL, "code", "h", F.inline(rows))
    e = F.col("e")
    losses = flat.groupBy("method", "code").agg(F.avg(X.squared(e, _h())).alias("squared_loss"), F.avg(X.absolute(e, _h())).alias("absolute_loss"), F.avg(e - _h()).alias("signed_bias"))
    by_cell = flat.groupBy("method", "code", *CELL).agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg(e) - F.avg(_h())).alias("error"))
    errors = by_cell.groupBy("method", "code").agg(F.avg("error").alias("cell_mae"), S.weighted_mean(F.col("error"), F.col("n")).alias("cell_mae_weighted"))
    return S.with_macro(losses.join(errors, ["method", "code"]), "code", ["squared_loss", "absolute_loss", "signed_bias", "cell_mae", "cell_mae_weighted"], by=["method"])


def marginal_calibration(split: DataFrame) -> DataFrame:
    return split.groupBy("split", "code").agg(
        F.count(F.lit(1)).alias("n"), F.avg(_h()).alias("mean_h"), F.avg(_p()).alias("mean_p"), F.avg(_p() - _h()).alias("signed_bias"),
        F.avg(X.squared(_p(), _h())).alias("squared_loss"), F.avg(X.absolute(_p(), _h())).alias("absolute_loss"), F.stddev_pop(_p()).alias("sharpness"), F.avg(X.entropy(_p())).alias("mean_entropy"),
    )


def reliability_bins(long: DataFrame, keys, bins: int = 10) -> DataFrame:
    binned = S.equal_frequency_bins(long, list(keys), "p", "item_id", bins)
    return binned.groupBy(*keys, "bin").agg(F.avg(_p()).alias("mean_p"), F.avg(_h()).alias("mean_h"), F.count(F.lit(1)).alias("n"))


def disagreement_detection(long: DataFrame) -> DataFrame:
    mixed = (_h() > 0) & (_h() < 1)
    counted = S.counted(long, "code", "h", "p")
    flagged = counted.select("code", "p", mixed.alias("mixed"), X.entropy(_p()).alias("u"), "count")
    rows = counted.groupBy("code").agg(
        S.counted_mean(mixed.cast("double")).alias("prevalence"), S.counted_mean(F.when(_h() == 0, _p())).alias("p_at_zero"),
        S.counted_mean(F.when(mixed, _p())).alias("p_at_mixed"), S.counted_mean(F.when(_h() == 1, _p())).alias("p_at_one"),
    )
    # Both areas are one computation over (code, score).
    scores = F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("x")) for k, c in (("auc_entropy", "u"), ("auc_p", "p"))]))
    areas = S.auc(flagged.select("code", "mixed", "count", scores), ["code", "kind"], "mixed", "x", weight="count")
    return rows.join(areas.groupBy("code").pivot("kind", ["auc_entropy", "auc_p"]).agg(F.first("auc")), "code")


def review_cases(long: DataFrame) -> DataFrame:
    """(code, section, place, item_id): six ordered lists, each without the items of those before it.

    Each list needs no more of its rows than all lists have places, so a code comes down to six short tops,
    found in two steps (in buckets of items, then over their tops); one fold over them deals the places.
    """
    far = lambda x: F.round(F.abs(x - 0.5), 12)
    lists = [
        ("closest", F.lit(True), far(_p()), 3),
        ("positive_disagreement", (_p() > 0.5) & (_h() < 0.5), -far(_p()), 3),
        ("negative_disagreement", (_p() < 0.5) & (_h() > 0.5), -far(_p()), 3),
        ("low", _h() < 0.5, _h(), 1),
        ("mixed", (_h() > 0) & (_h() < 1), far(_h()), 1),
        ("high", _h() > 0.5, -_h(), 1),
    ]
    most = sum(n for *_, n in lists)
    member = F.array(*[F.when(where, F.struct(F.lit(i).alias("list"), order.cast("double").alias("o"))) for i, (_, where, order, _) in enumerate(lists)])
    rows = long.select("code", "item_id", F.inline(F.filter(member, lambda x: x.isNotNull())))
    by = lambda *k: Window.partitionBy("code", "list", *k).orderBy("o", "item_id")
    tops = rows.withColumn("b", F.substring("item_id", 1, 2)).withColumn("r", F.row_number().over(by("b"))).filter(F.col("r") <= most)
    tops = tops.withColumn("r", F.row_number().over(by())).filter(F.col("r") <= most)
    quota = F.array(*[F.lit(n) for *_, n in lists])

    def deal(taken, x):
        place = F.size(F.filter(taken, lambda y: y["list"] == x["list"])) + 1
        free = ~F.exists(taken, lambda y: y["item_id"] == x["item_id"]) & (place <= F.element_at(quota, x["list"] + 1))
        return F.when(free, F.concat(taken, F.array(F.struct(x["list"].alias("list"), place.alias("place"), x["item_id"].alias("item_id"))))).otherwise(taken)

    ordered = F.array_sort(F.collect_list(F.struct("list", "r", "item_id")))
    dealt = tops.groupBy("code").agg(ordered.alias("x")).select("code", F.inline(F.aggregate("x", F.array().cast("array<struct<list:int,place:int,item_id:string>>"), deal)))
    names = F.array(*[F.lit(k) for k, *_ in lists])
    return dealt.select("code", F.element_at(names, F.col("list") + 1).alias("section"), F.col("place").cast("bigint").alias("place"), "item_id")


def brier_identity(long: DataFrame) -> DataFrame:
    """Hard-minus-soft loss to the share, and to single votes: the same number two ways."""
    n1, n0 = F.col("n_votes") * _h(), F.col("n_votes") * (1 - _h())
    brier = lambda s: (n1 * (1 - s) * (1 - s) + n0 * s * s) / F.col("n_votes")
    return long.groupBy("code").agg(
        F.avg(X.squared(X.hard(_p()), _h()) - X.squared(_p(), _h())).alias("share_delta"), F.avg(brier(X.hard(_p())) - brier(_p())).alias("vote_delta"),
        S.weighted_mean(X.coder_loss(_p(), _h()), F.col("n_votes")).alias("coder_loss"), F.avg((n1 * (1 - _p()) + n0 * _p()) / F.col("n_votes")).alias("vote_absolute"),
    )


def union_all(frames) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
