"""From raw judgments to vote shares: exact and semantic dedupe, conflicts, eligibility, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurality.functions import exprs as X

RAW = ["text", "source", "bucket", "annotator", "annotation", "confidence"]
ITEM = ["bucket", "source", "text"]


def exact_dedupe(votes: DataFrame) -> DataFrame:
    return votes.select(*RAW).distinct()


def semantic_dedupe(votes: DataFrame) -> DataFrame:
    """One row for each item, annotator, set of labels and confidence, whatever the order of the labels.

    Raw votes are dealt once, by item and annotator: label sets are then read in all tasks however few files
    hold the votes, and neither this step nor a count by item and annotator shuffles again. Repeated votes are
    rare, so little is lost by not merging them before the shuffle.
    """
    dealt = votes.select(*RAW).repartition(*ITEM, "annotator")
    return dealt.select(*ITEM, "annotator", X.label_signature(F.col("annotation")).alias("labels"), "confidence").distinct()


def conflicting_pairs(deduped: DataFrame) -> DataFrame:
    """(item, annotator) pairs that still have more than one judgment."""
    return deduped.groupBy(*ITEM, "annotator").agg(F.count(F.lit(1)).alias("judgments")).filter("judgments > 1")


def conflicted_items(deduped: DataFrame) -> DataFrame:
    return conflicting_pairs(deduped).select(*ITEM).distinct()


def retained_votes(deduped: DataFrame) -> DataFrame:
    """Votes on items without any conflict: a conflict excludes the whole item."""
    return deduped.join(conflicted_items(deduped), ITEM, "left_anti")


def by_annotator(votes: DataFrame, codes: list[str]) -> DataFrame:
    """One row for each item and annotator: judgments, sum and count of confidence values, votes_ of each code."""
    labels, level = F.split("labels", ","), X.confidence_value(F.col("confidence"))
    counts = [F.count_if(F.array_contains(labels, c)).alias(f"votes_{c}") for c in codes]
    return votes.groupBy(*ITEM, "annotator").agg(F.count(F.lit(1)).alias("judgments"), F.sum(level).alias("sure"), F.count(level).alias("n_sure"), *counts)


def vote_counts(votes: DataFrame, codes: list[str], *, without_conflicts: bool = False) -> DataFrame:
    """One row an item: identity, n_annotators, n_votes, confidence_mean, and votes_ of each code.

    Votes are summed by item and annotator, then by item, so an item that very many judged stays no one task's.
    ``without_conflicts`` leaves out items of which an annotator has several judgments: what
    ``vote_counts(retained_votes(votes), codes)`` gives, without its join.
    """
    sums = [F.count("annotator").alias("n_annotators"), F.sum("judgments").alias("n_votes"), F.try_divide(F.sum("sure"), F.sum("n_sure")).alias("confidence_mean"), F.max("judgments").alias("_most")]
    items = by_annotator(votes, codes).groupBy(*ITEM).agg(*sums, *[F.sum(f"votes_{c}").alias(f"votes_{c}") for c in codes])
    if without_conflicts:
        items = items.filter("_most = 1")
    return items.drop("_most")


def with_shares(counts: DataFrame, codes: list[str]) -> DataFrame:
    """Adds ``item_id``, ``content_id`` and human_ of each code: of columns in one row, so a table need not be kept with them."""
    shares = [(F.col(f"votes_{c}") / F.col("n_votes")).alias(f"human_{c}") for c in codes]
    return counts.select(X.item_id(*[F.col(c) for c in ITEM]).alias("item_id"), X.content_id(F.col("text")).alias("content_id"), "*", *shares)


def vote_shares(votes: DataFrame, codes: list[str], *, without_conflicts: bool = False) -> DataFrame:
    """One row an item: ``vote_counts`` with the identities and shares of ``with_shares``."""
    return with_shares(vote_counts(votes, codes, without_conflicts=without_conflicts), codes)


def eligible(items: DataFrame, least: int = 3) -> DataFrame:
    if least < 3:
        raise ValueError("an item needs at least three annotators")
    return items.filter(F.col("n_annotators") >= least)


def audit(votes: DataFrame, codes: list[str], least: int = 3) -> DataFrame:
    """One row of counts over every step of the clean-up, from sums by item and annotator, then by item."""
    pair = [*ITEM, "annotator"]
    signature = X.label_signature(F.col("annotation"))
    exact = votes.select(*RAW).repartition(*pair).groupBy(*RAW).agg(F.count(F.lit(1)).alias("rows"))
    semantic = exact.groupBy(*pair, signature.alias("labels"), "confidence").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("exact"))
    judged = semantic.groupBy(*pair).agg(F.sum("rows").alias("rows"), F.sum("exact").alias("exact"), F.count(F.lit(1)).alias("judgments"))
    items = judged.groupBy(*ITEM).agg(
        F.sum("rows").alias("rows"), F.sum("exact").alias("exact"), F.sum("judgments").alias("judgments"),
        F.count_if(F.col("judgments") > 1).alias("pairs"), F.count("annotator").alias("n_annotators"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    whole = F.col("pairs") == 0
    return items.agg(
        total("rows").alias("raw_rows"), total("exact").alias("after_exact"), total("judgments").alias("after_semantic"),
        total("pairs").alias("conflicting_pairs"), F.count_if(~whole).alias("conflicted_items"),
        total(F.when(whole, F.col("judgments"))).alias("retained_votes"), F.count_if(whole).alias("retained_items"),
        F.count_if(whole & (F.col("n_annotators") >= least)).alias("eligible_items"),
    )
