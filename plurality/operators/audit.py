"""The record of a clean-up: what every step removed, what is left, how it was split, and what the votes say."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurality.functions import exprs as X
from plurality.functions import stats as S
from plurality.operators import cleaning as C
from plurality.operators import split as G
from plurality.sources import files

VERSION = "1"


def _fields(row: DataFrame) -> DataFrame:
    """(field, value) of a single row: numbers and truth values as text, lists and maps as JSON."""
    text = lambda c, t: F.to_json(c) if t.startswith(("array", "map")) else F.col(c).cast("string")
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), text(c, t).alias("value")) for c, t in row.dtypes])))


def _steps(votes: DataFrame, least: int) -> DataFrame:
    """One row of counts over the steps, from sums by item and annotator, then by item: one shuffle of the votes."""
    pair = [*C.ITEM, "annotator"]
    exact = votes.select(*C.RAW).repartition(*pair).groupBy(*C.RAW).agg(F.count(F.lit(1)).alias("rows"))
    signature = X.label_signature(F.col("annotation")).alias("labels")
    semantic = exact.groupBy(*pair, signature, "confidence").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("exact"))
    judged = semantic.groupBy(*pair).agg(F.sum("rows").alias("rows"), F.sum("exact").alias("exact"), F.count(F.lit(1)).alias("judgments"))
    items = judged.groupBy(*C.ITEM).agg(
        F.sum("rows").alias("rows"), F.sum("exact").alias("exact"), F.sum("judgments").alias("judgments"),
        F.count_if(F.col("exact") > F.col("judgments")).alias("respelt"), F.count_if(F.col("judgments") > 1).alias("pairs"),
        F.count("annotator").alias("n_annotators"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    whole, enough = F.col("pairs") == 0, F.col("n_annotators") >= least
    rows, exact, judgments = F.col("rows"), F.col("exact"), F.col("judgments")
    return items.agg(
        total(rows).alias("raw_rows_before_exact_dedup"), total(exact).alias("raw_rows_after_exact_dedup"),
        total(rows - exact).alias("exact_duplicate_rows_removed"), total(exact - judgments).alias("semantic_duplicates_removed"),
        total("respelt").alias("semantic_duplicate_groups"), total("pairs").alias("conflicting_item_annotator_groups"),
        F.count_if(~whole).alias("items_excluded_for_conflicts"), total(F.when(~whole, judgments)).alias("rows_excluded_for_conflicting_items"),
        F.count(F.lit(1)).alias("items_before_conflict_exclusion"), F.count_if(whole).alias("items_remaining_after_conflict_exclusion"),
        (F.count_if(whole & (judgments != F.col("n_annotators"))) == 0).alias("retained_item_annotator_pairs_unique"),
        F.count_if(whole & ~enough).alias("items_excluded_lt_min_annotators"), F.count_if(whole).alias("unique_items_all"),
        F.count_if(whole & enough).alias("eligible_items"),
    )


def _vocabulary(votes: DataFrame) -> DataFrame:
    """One row of the sorted values that occur: as many as there are cells and labels, whatever the number of votes."""
    cell = X.cell_name(F.col("bucket"), F.col("source"))
    seen = lambda c: F.array_sort(F.collect_set(c))
    # Rows that agree in all four are merged first, so label sets are read once for each combination.
    kinds = votes.groupBy("bucket", "source", "confidence", "annotation").agg(F.count(F.lit(1)).alias("n"))
    labels = kinds.withColumn("label", F.explode_outer(F.split(X.label_signature(F.col("annotation")), ",")))
    return labels.agg(
        seen("source").alias("sources"), seen("bucket").alias("buckets"), seen(cell).alias("source_cells"), F.count_distinct(cell).alias("source_cell_count"),
        seen(F.when(F.col("confidence") != "", F.col("confidence"))).alias("confidence_values"), seen(F.when(F.col("label") != "", F.col("label"))).alias("atomic_labels"),
    )


def audit_record(votes: DataFrame, codes: list[str], *, dev: int, sensitivity: int, least: int = 3, seed: int = 42, **provenance: str) -> DataFrame:
    """(field, value): the clean-up's whole record, one row a field, values as text or JSON.

    Counts of every step; items by number of annotators; dev, test and sensitivity items against their targets; texts in
    several cells; whether equal texts stay in one split; the sources, buckets, cells, confidences and labels that
    occur; ties at one half of each code. ``provenance`` names what only the caller knows, such as the hashes of the
    files read and written (``sources.manifest``). Of an empty table all counts are 0 and all lists are empty.
    """
    votes = votes.select(*C.RAW)
    every = S.shared(C.vote_shares(C.semantic_dedupe(votes), codes, without_conflicts=True))
    eligible = C.eligible(every, least)
    counted = every.groupBy(F.col("n_annotators").cast("bigint").alias("k")).agg(F.count(F.lit(1)).alias("v"))
    spread = counted.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("annotator_count_distribution_all"))
    half = F.create_map(*[x for c in codes for x in (F.lit(c), F.count_if(F.col(f"human_{c}") == 0.5))])
    parted = G.assign(eligible, dev, sensitivity, seed=seed).groupBy("text").agg(
        F.count_if(F.col("split") == "dev").alias("dev"), F.count_if(F.col("split") == "test").alias("test"), F.count_if("sensitivity").alias("strict")
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    splits = parted.agg(
        total("dev").alias("dev_items"), total("test").alias("test_items"), total("strict").alias("sensitivity_items"),
        (F.count_if((F.col("dev") > 0) & (F.col("test") > 0)) == 0).alias("exact_text_grouped_across_splits"),
    )
    crossing = votes.select(*C.ITEM).distinct().groupBy("text").agg((F.count(F.lit(1)) > 1).alias("many")).agg(F.count_if("many").alias("cross_source_exact_text_groups"))
    settings = {"min_annotators_required": least, "dev_items_target": dev, "sensitivity_items_target": sensitivity}
    config = files.fingerprint({**settings, "codes": codes, "seed": seed})
    known = {"pipeline_version": VERSION, "config_fingerprint": config, **{k: str(v) for k, v in settings.items()}, **provenance}
    fixed = votes.sparkSession.createDataFrame(sorted(known.items()), "field string, value string")
    parts = [_steps(votes, least), _vocabulary(votes), spread, eligible.agg(half.alias("exact_half_ties_by_code")), splits, crossing]
    return reduce(DataFrame.unionByName, map(_fields, parts), fixed)
