"""Registered queries over the driver's tables; ``plurality.plans.oracles`` has their independent SQL."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plurality.functions import exprs as X
from plurality.functions import stats as S
from plurality.operators import analysis as A
from plurality.operators import audit as D
from plurality.operators import cache as H
from plurality.operators import cleaning as C
from plurality.operators import constraints as K
from plurality.operators import inference as I
from plurality.operators import release as R
from plurality.operators import resample as B
from plurality.operators import scores as L
from plurality.operators import split as G
from plurality.operators import suite as U
from plurality.plans import oracles
from plurality.plans.panel import CODES, document_items, order_votes, prediction_columns, predictions, table
from plurality.sources import storage

DEV, SENSITIVITY, BUDGETS = 1000, 1000, (0, 5, 10, 20, 30)
#: Repetitions of bootstraps of means, of clusters, of rank correlations, and of random reviews.
REPS, CLUSTER_REPS, RANK_REPS, REVIEW_REPS = 1000, 2000, 20, 200
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to some places: sums of doubles depend on the order of their rows."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c).cast("bigint").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes])


def deduped(spark, sf_dir):
    return C.semantic_dedupe(order_votes(spark, sf_dir))


def kept(spark, sf_dir):
    return C.retained_votes(deduped(spark, sf_dir))


def all_items(spark, sf_dir):
    return C.vote_shares(deduped(spark, sf_dir), CODES, without_conflicts=True)


def items(spark, sf_dir):
    return C.eligible(all_items(spark, sf_dir))


def counts(spark, sf_dir):
    """Vote counts of the eligible items: all that is kept for the branches of a query."""
    return S.shared(C.eligible(C.vote_counts(deduped(spark, sf_dir), CODES, without_conflicts=True)))


def scored(counts):
    """Identities, shares and stand-in probabilities: of columns in one row, so nothing is joined or kept for them."""
    return C.with_shares(counts, CODES).select("*", *prediction_columns(CODES))


def wide(spark, sf_dir):
    return scored(counts(spark, sf_dir))


def long(spark, sf_dir):
    return L.long_scores(wide(spark, sf_dir), CODES)


def split_long(spark, sf_dir):
    return L.long_scores(scored(G.assign(counts(spark, sf_dir), DEV, SENSITIVITY)), CODES)


def part(spark, sf_dir, split):
    return split_long(spark, sf_dir).filter(F.col("split") == split)


# Clean-up


@query
def uncertainty_validity(spark, sf_dir):
    return rounded(A.code_metrics(long(spark, sf_dir)).select("code", "n", "rho", "squared_loss", "hard_squared_loss"))


@query
def exact_dedup_counts(spark, sf_dir):
    raw = order_votes(spark, sf_dir)
    a, b = raw.agg(F.count(F.lit(1)).alias("raw_rows")), C.exact_dedupe(raw).agg(F.count(F.lit(1)).alias("distinct_rows"))
    return a.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k").drop("k")


@query
def semantic_dedup(spark, sf_dir):
    return deduped(spark, sf_dir).groupBy("bucket", "source").agg(F.count(F.lit(1)).alias("votes"), F.countDistinct("text").alias("texts"))


@query
def conflict_items(spark, sf_dir):
    return C.conflicted_items(deduped(spark, sf_dir))


@query
def conflict_pairs(spark, sf_dir):
    return C.conflicting_pairs(deduped(spark, sf_dir))


@query
def retained_votes(spark, sf_dir):
    return kept(spark, sf_dir).groupBy("labels", "confidence").agg(F.count(F.lit(1)).alias("votes"))


@query
def vote_shares(spark, sf_dir):
    return rounded(all_items(spark, sf_dir).select("item_id", "n_annotators", "n_votes", "confidence_mean", *[f"human_{c}" for c in CODES]))


@query
def eligible_items(spark, sf_dir):
    return items(spark, sf_dir).groupBy("bucket", "source").agg(F.count(F.lit(1)).alias("items"))


@query
def excluded_items(spark, sf_dir):
    few = all_items(spark, sf_dir).filter("n_annotators < 3").select("item_id", F.lit("few annotators").alias("reason"))
    own = C.conflicted_items(deduped(spark, sf_dir))
    return few.unionByName(own.select(X.item_id(*[F.col(c) for c in C.ITEM]).alias("item_id"), F.lit("conflict").alias("reason")))


@query
def annotator_histogram(spark, sf_dir):
    return all_items(spark, sf_dir).groupBy("n_annotators").agg(F.count(F.lit(1)).alias("items"))


@query
def half_ties(spark, sf_dir):
    return long(spark, sf_dir).groupBy("code", X.majority(F.col("h")).alias("side")).agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("h") == 0.5).alias("at_half"))


@query
def audit_summary(spark, sf_dir):
    return C.audit(order_votes(spark, sf_dir), CODES)


@query
def audit_record(spark, sf_dir):
    return D.audit_record(order_votes(spark, sf_dir), CODES, dev=DEV, sensitivity=SENSITIVITY)


@query
def source_cells(spark, sf_dir):
    names = items(spark, sf_dir).select(X.cell_name(F.col("bucket"), F.col("source")).alias("cell")).distinct()
    return names.agg(F.count(F.lit(1)).alias("cells"), F.concat_ws("|", F.array_sort(F.collect_set("cell"))).alias("names"))


@query
def atomic_labels(spark, sf_dir):
    return deduped(spark, sf_dir).select(F.explode(F.split("labels", ",")).alias("label"), F.struct("bucket", "source", "text").alias("i")).groupBy("label").agg(F.count(F.lit(1)).alias("votes"), F.countDistinct("i").alias("items"))


@query
def confidence_levels(spark, sf_dir):
    votes = deduped(spark, sf_dir)
    return rounded(votes.groupBy("confidence").agg(F.count(F.lit(1)).alias("votes"), F.avg(X.confidence_value(F.col("confidence"))).alias("value")))


@query
def unknown_labels(spark, sf_dir):
    labels = deduped(spark, sf_dir).select(F.explode(F.split("labels", ",")).alias("label"))
    return K.unknown_values(labels, "label", ["A", "N", "F", "O", "BULK"])


@query
def release_frame(spark, sf_dir):
    own = items(spark, sf_dir).withColumn("unanimous", (F.col("human_BULK") % 1 == 0).cast("int"))
    return R.release_frame(own, ["item_id", "content_id", "bucket", "source", "n_annotators", "n_votes", "unanimous"], ["unanimous"])


@query
def label_groups(spark, sf_dir):
    """Votes of each group of labels; a vote without a confidence counts as unclear."""
    labels, unclear = F.split("labels", ","), F.col("confidence") == ""
    groups = {"returned": ["A", "R"], "open": ["O", "N"]}
    own = deduped(spark, sf_dir).select("bucket", *[R.in_group(labels, m, unclear).alias(g) for g, m in groups.items()])
    counts = [f(F.col(g)).cast("bigint").alias(f"{g}_{n}") for g in groups for n, f in (("chosen", F.sum), ("answered", F.count))]
    return own.groupBy("bucket").agg(F.count(F.lit(1)).alias("votes"), *counts)


# Identities and splits


@query
def item_ids(spark, sf_dir):
    d = document_items(spark, sf_dir)
    return d.select(X.item_id(F.col("bucket"), F.col("source"), F.col("doc_id").cast("string")).alias("item_id"))


@query
def content_ids(spark, sf_dir):
    return document_items(spark, sf_dir).groupBy("content_id").agg(F.count(F.lit(1)).alias("documents"))


@query
def label_signatures(spark, sf_dir):
    return order_votes(spark, sf_dir).groupBy(X.label_signature(F.col("annotation")).alias("signature"), X.label_signature(X.strip(F.concat(F.lit("\t "), F.col("annotation"), F.lit(" ,,")))).alias("again")).agg(F.count(F.lit(1)).alias("rows"))


@query
def grouped_split(spark, sf_dir):
    chosen = G.select_groups(document_items(spark, sf_dir), 100)
    return chosen.select(X.content_id(F.col("text")).alias("content_id"), "size", F.col("taken_before").cast("bigint").alias("taken_before"))


@query
def sensitivity_subset(spark, sf_dir):
    own = G.assign(document_items(spark, sf_dir), 100, 50)
    return own.groupBy("split", "sensitivity").agg(F.count(F.lit(1)).alias("documents"), F.countDistinct("content_id").alias("texts"))


@query
def leak_check(spark, sf_dir):
    """A sound split has no leak; here every tenth document is put into a split of its own, whatever its text's copies."""
    own = G.assign(document_items(spark, sf_dir), 100, 50)
    planted = own.withColumn("split", F.when(F.col("doc_id") % 10 == 0, "planted").otherwise(F.col("split")))
    return G.leaks(planted).select("text", "splits").unionByName(G.leaks(own).select("text", "splits"))


@query
def cross_source_texts(spark, sf_dir):
    cells = document_items(spark, sf_dir).select("content_id", "bucket", "source").distinct()
    return cells.groupBy("content_id").agg(F.count(F.lit(1)).alias("cells")).filter("cells > 1")


@query
def hash_threshold_split(spark, sf_dir):
    return G.hash_threshold(document_items(spark, sf_dir), 0.1, "next:").groupBy("split").agg(F.count(F.lit(1)).alias("documents"))


# Shapes and joins


@query
def long_scores(spark, sf_dir):
    return rounded(long(spark, sf_dir).select("item_id", "code", "h", "p", "q"))


@query
def wide_scores(spark, sf_dir):
    return rounded(L.wide_scores(long(spark, sf_dir), CODES))


@query
def prediction_join(spark, sf_dir):
    own = items(spark, sf_dir)
    joined = L.join_predictions(own, predictions(own, CODES))
    return rounded(L.long_scores(joined, CODES).groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("h").alias("mean_h")))


@query
def prediction_completeness(spark, sf_dir):
    own = items(spark, sf_dir)
    some = predictions(own, CODES).filter(F.substring("item_id", 1, 1) != "0")
    return K.unmatched(own, some, "item_id").select("item_id", "n_annotators")


@query
def key_disjointness(spark, sf_dir):
    """Keys that two sides share: none of a sound split's, and those of dev items that are put into the test side too."""
    split = G.assign(items(spark, sf_dir), DEV, SENSITIVITY)
    dev, test = split.filter("split = 'dev'"), split.filter("split = 'test'")
    planted = test.unionByName(dev.filter(F.substring("item_id", 1, 1) == "a"))
    return A.union_all([K.shared_keys(dev, other, ["item_id"]).withColumn("side", F.lit(name)) for name, other in (("sound", test), ("planted", planted))])


@query
def cell_joins(spark, sf_dir):
    """Three cell tables joined on their three-column key; the wide aggregate gives the same."""
    rows = long(spark, sf_dir)
    key = ["bucket", "source", "code"]
    human, soft, hard = (rows.groupBy(*key).agg(F.avg(e).alias(n)) for n, e in (("human", F.col("h")), ("soft", F.col("p")), ("hard", X.hard(F.col("p")))))
    return rounded(human.join(soft, key).join(hard, key))


# Uncertainty and loss


@query
def foundation_metrics(spark, sf_dir):
    return rounded(S.with_macro(A.code_metrics(part(spark, sf_dir, "test")), "code", ["squared_loss", "hard_squared_loss", "absolute_loss", "hard_absolute_loss", "rho"]))


@query
def loss_deltas(spark, sf_dir):
    return rounded(A.loss_deltas(part(spark, sf_dir, "test")))


@query
def pairwise_disagreement_rho(spark, sf_dir):
    return rounded(A.pairwise_association(part(spark, sf_dir, "test")))


@query
def confidence_vs_uncertainty(spark, sf_dir):
    return rounded(A.confidence_association(part(spark, sf_dir, "test")))


@query
def brier_identity(spark, sf_dir):
    return rounded(A.brier_identity(long(spark, sf_dir)))


# Review and recovery


def review_items(spark, sf_dir):
    return S.shared(A.item_review(part(spark, sf_dir, "test")))


@query
def triage_targeted(spark, sf_dir):
    own = review_items(spark, sf_dir)
    return rounded(A.review_curve(own, own.count(), len(CODES), "entropy", BUDGETS))


@query
def triage_methods(spark, sf_dir):
    own = review_items(spark, sf_dir)
    n = own.count()
    methods = F.array(*[F.struct(F.lit(s).alias("method"), F.col(s).alias("score")) for s in ("entropy", "mean_p", "sse")])
    return rounded(A.review_curve(own.select("item_id", "sse", F.inline(methods)), n, len(CODES), "score", BUDGETS, keys=["method"]))


@query
def triage_random(spark, sf_dir):
    own = review_items(spark, sf_dir)
    n = own.count()
    curve = B.random_curve(own, "sse", n, BUDGETS, REVIEW_REPS).withColumn("mse", F.col("sse") / (n * len(CODES)))
    return rounded(curve.groupBy("budget").agg(F.avg("mse").alias("mse_mean"), *S.interval("mse")))


def reviewed_long(spark, sf_dir):
    """Test scores with the rank of their item in the targeted review."""
    rows = part(spark, sf_dir, "test")
    reviewed = S.shared(A.item_review(rows))
    ranked = S.global_rank(reviewed, "entropy", "item_id", descending=True).select("item_id", "rank")
    return rows.join(ranked, "item_id"), reviewed.count()


def recovery(spark, sf_dir):
    rows, n = reviewed_long(spark, sf_dir)
    targeted = {f"targeted_{b}": F.when(F.col("rank") <= round(n * b / 100), F.col("h")).otherwise(F.col("p")) for b in BUDGETS if b}
    return A.cells(rows, {"soft": F.col("p"), "hard": X.hard(F.col("p")), **targeted})


@query
def cell_recovery(spark, sf_dir):
    return rounded(recovery(spark, sf_dir))


@query
def cell_recovery_summary(spark, sf_dir):
    own = recovery(spark, sf_dir)
    return rounded(A.cell_errors(own, [c for c in own.columns if c not in ("bucket", "source", "code", "n", "human")]))


def random_recovery(spark, sf_dir):
    rows = part(spark, sf_dir, "test")
    return S.shared(B.random_recovery(rows, CODES, A.CELL, BUDGETS, REVIEW_REPS))


@query
def random_cell_recovery(spark, sf_dir):
    """Mean over repetitions of the cell errors of random reviews, for each budget."""
    error = F.abs(F.col("estimate") - F.col("human"))
    errors = random_recovery(spark, sf_dir).groupBy("rep", "budget").agg(F.avg(error).alias("a"), S.weighted_mean(error, F.col("n")).alias("w"))
    return rounded(errors.groupBy("budget").agg(F.avg("a").alias("mae_unweighted"), F.avg("w").alias("mae_weighted")))


@query
def random_cell_means(spark, sf_dir):
    """What random reviews of each budget recover of each cell, on average."""
    return rounded(random_recovery(spark, sf_dir).groupBy(*A.CELL, "code", "budget").agg(F.first("n").alias("n"), F.avg("estimate").alias("random_mean")))


@query
def cell_min_clusters(spark, sf_dir):
    """Cells with enough distinct texts, for two bounds."""
    rows = long(spark, sf_dir)
    return A.union_all([A.clustered_cells(rows, least).withColumn("least", F.lit(least).cast("bigint")) for least in (200, 700)])


# Wording and calibration


@query
def wording_sensitivity(spark, sf_dir):
    return rounded(A.wording(split_long(spark, sf_dir).filter("sensitivity")))


@query
def strict_sensitivity_summary(spark, sf_dir):
    return rounded(A.strict_summary(split_long(spark, sf_dir).filter("sensitivity")))


@query
def calibration_fit(spark, sf_dir):
    return rounded(A.calibration(part(spark, sf_dir, "dev")).select("code", "n", "weight_sum", "intercept", "slope", "constant"))


def calibrated(spark, sf_dir):
    return A.calibrate(part(spark, sf_dir, "test"), A.calibration(S.shared(part(spark, sf_dir, "dev"))))


@query
def calibration_apply(spark, sf_dir):
    return rounded(calibrated(spark, sf_dir).select("item_id", "code", F.round("calibrated", 4).alias("calibrated")))


@query
def method_comparison(spark, sf_dir):
    return rounded(A.compare_methods(calibrated(spark, sf_dir)))


@query
def prevalence_baselines(spark, sf_dir):
    return rounded(A.calibration(part(spark, sf_dir, "dev")).select("code", "constant", "coder_constant"))


@query
def marginal_calibration(spark, sf_dir):
    return rounded(A.marginal_calibration(split_long(spark, sf_dir)))


@query
def reliability_bins(spark, sf_dir):
    return rounded(A.reliability_bins(part(spark, sf_dir, "test"), ["code"]))


@query
def disagreement_auc(spark, sf_dir):
    return rounded(A.disagreement_detection(part(spark, sf_dir, "test")))


def labelled(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").withColumn("score", F.col("n_chars").cast("double"))


@query
def quality_toxicity_auc(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    return rounded(A.union_all([S.auc(rows, ["lang"], t, "score").withColumn("target", F.lit(t)) for t in ("quality", "toxic")]))


@query
def labels_reliability(spark, sf_dir):
    rows = labelled(spark, sf_dir).select(F.lit("all").alias("code"), F.col("score").alias("p"), F.col("quality").cast("double").alias("h"), F.lpad(F.hex("doc_id"), 16, "0").alias("item_id"))
    return rounded(A.reliability_bins(rows, ["code"], 7))


# Resampling


@query
def bootstrap_loss_ci(spark, sf_dir):
    rows = part(spark, sf_dir, "test").select("item_id", "code", (X.squared(X.hard(F.col("p")), F.col("h")) - X.squared(F.col("p"), F.col("h"))).alias("squared_delta"), (X.absolute(X.hard(F.col("p")), F.col("h")) - X.absolute(F.col("p"), F.col("h"))).alias("absolute_delta"))
    return rounded(B.bootstrap_means(rows, ["squared_delta", "absolute_delta"], REPS))


@query
def bootstrap_spearman_ci(spark, sf_dir):
    rows = part(spark, sf_dir, "test").select("item_id", "code", X.entropy(F.col("h")).alias("uh"), X.entropy(F.col("p")).alias("up"))
    return rounded(B.bootstrap_spearman(rows, "uh", "up", RANK_REPS))


@query
def paired_bootstrap(spark, sf_dir):
    rows, own = calibrated(spark, sf_dir), F.col("calibrated")
    h, columns = F.col("h"), []
    for name in ("raw", "hard", "constant"):
        other = A.methods()[name]
        columns += [(X.squared(own, h) - X.squared(other, h)).alias(f"squared_{name}"), (X.absolute(own, h) - X.absolute(other, h)).alias(f"absolute_{name}"), (own - other).alias(f"bias_{name}")]
    values = [f"{m}_{n}" for n in ("raw", "hard", "constant") for m in ("squared", "absolute", "bias")]
    return rounded(B.bootstrap_means(rows.select("item_id", "code", *columns), values, REPS))


@query
def strict_bootstrap(spark, sf_dir):
    h, p, q = F.col("h"), F.col("p"), F.col("q")
    rows = split_long(spark, sf_dir).filter("sensitivity").select("item_id", "code", (X.squared(q, h) - X.squared(p, h)).alias("squared_delta"), (X.absolute(q, h) - X.absolute(p, h)).alias("absolute_delta"), (p - h).alias("bp"), (q - h).alias("bq"))
    size = lambda df: df.withColumn("bias_size", F.abs("bq") - F.abs("bp")).drop("bp", "bq")
    return rounded(B.bootstrap_means(rows, ["squared_delta", "absolute_delta", "bp", "bq"], REPS, after=size), 8)  # on the grid of p, six places would cut many values in half


@query
def cluster_bootstrap(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(document_items(spark, sf_dir), "doc_id").select("content_id", "quality")
    return rounded(B.cluster_bootstrap(rows, "content_id", "quality", CLUSTER_REPS))


@query
def review_cases(spark, sf_dir):
    return A.review_cases(part(spark, sf_dir, "dev"))


# Jobs and their cache


def jobs(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        F.lit("e1").alias("experiment"), F.lit("offline").alias("provider"), F.concat_ws(":", "conv_id", "turn").alias("item_id"),
        F.when(F.col("role") == "assistant", "strict").otherwise("canonical").alias("variant"), F.lit("h1").alias("prompt_hash"), F.lit("m1").alias("model"),
        F.sha2("text", 256).alias("state"), "text",
    )


def cache(spark, sf_dir):
    done = jobs(spark, sf_dir).filter(X.hash_int(F.concat(F.lit("done:"), F.col("item_id"))) % 3 != 0)
    returned = F.when(X.hash_int(F.concat(F.lit("drift:"), F.col("item_id"))) % 50 == 0, "m2").otherwise("m1")
    answer = F.struct(returned.alias("model"), F.create_map(F.lit("A"), F.struct(F.lit("p").alias("type"), ((F.length("text") % 101) / 100).alias("noul"))).alias("answers"), F.struct(F.length("text").cast("bigint").alias("input_tokens"), F.lit(7).cast("bigint").alias("output_tokens")).alias("usage"))
    return done.withColumn("response", F.to_json(answer)).drop("text")


@query
def pending_jobs(spark, sf_dir):
    return I.pending(jobs(spark, sf_dir), cache(spark, sf_dir)).groupBy("variant").agg(F.count(F.lit(1)).alias("jobs"), F.min("item_id").alias("first_item"))


@query
def next_jobs(spark, sf_dir):
    """The call budget: the first 25 pending jobs."""
    return I.pending(jobs(spark, sf_dir), cache(spark, sf_dir), most=25).select("item_id", "variant")


@query
def completed_jobs(spark, sf_dir):
    return I.completed(jobs(spark, sf_dir), cache(spark, sf_dir)).groupBy("variant").agg(F.count(F.lit(1)).alias("jobs"))


@query
def response_records(spark, sf_dir):
    return rounded(I.flatten(cache(spark, sf_dir), ["A"]).groupBy("returned_model", "consistent").agg(F.count(F.lit(1)).alias("calls"), F.avg("p_A").alias("mean_p"), F.sum("input_tokens").alias("tokens")))


@query
def usage_rollup(spark, sf_dir):
    return I.usage(I.flatten(cache(spark, sf_dir), ["A"]))


@query
def model_drift(spark, sf_dir):
    return I.drifted(I.flatten(cache(spark, sf_dir), ["A"]), "m1")


@query
def payload_flatten(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.sum(k).alias("k_sum"), F.max(k).alias("k_max"))


@query
def evidence_fingerprint(spark, sf_dir):
    return I.evidence_fingerprint(jobs(spark, sf_dir), ["item_id", "variant", "state"])


@query
def committed_calls(spark, sf_dir):
    """Two batches with keys in common, and the second again, through a new cache: what it holds and what is left."""
    calls = H.CallCache(spark, storage.scratch(spark, "calls"))
    done, half = cache(spark, sf_dir), F.pmod(F.crc32("item_id"), F.lit(4))
    for batch, part in (("first", half < 3), ("second", half > 0), ("second", half > 0)):
        with contextlib.suppress(H.ModelDrift):  # the stand-in answers drift, which is found after they are committed
            calls.commit(done.filter(part), batch)
    place = {"experiment": "e1", "provider": "offline", "model": "m1"}
    held = calls.calls(**place).select("variant", "item_id", F.lit(1).alias("held"))
    left = calls.pending(jobs(spark, sf_dir), **place).select("variant", "item_id", F.lit(0).alias("held"))
    return held.unionByName(left).groupBy("variant", F.col("held").cast("bigint").alias("held")).agg(F.count(F.lit(1)).alias("calls"), F.min("item_id").alias("first_item"))


# Constraints and functions


def suite_report(df, rules):
    return U.report(df, rules).select(F.col("rule"), "found", "wanted", "holds")


@query
def release_validation(spark, sf_dir):
    """The release suite over the panel's frame, in one scan of it; the last five rules are broken on purpose."""
    own = wide(spark, sf_dir).withColumn("unanimous", F.col("human_BULK") % 1 == 0).withColumn("model", F.lit("m1"))
    shares = [f"{k}_{c}" for c in CODES for k in ("human", "p")]
    good = [U.unique("item_id"), U.present("content_id", "bucket", "source"), U.in_unit(*shares), U.whole("n_annotators", 3), U.only("model", "m1")]
    bad = [U.row_count(-1), U.unique("bucket"), U.whole("n_annotators", 4), U.only("bucket", "O"), U.flagged("unanimous")]
    return suite_report(own, [*U.flat(good), *U.flat(bad)])


@query
def line_validation(spark, sf_dir):
    """Raw rows break rules of their own accord: keys that repeat, quantities outside [0, 1], fractional prices."""
    rules = [U.unique("l_orderkey", "l_linenumber"), U.present("l_returnflag"), U.in_unit("l_discount", "l_tax", "l_quantity"), U.whole("l_quantity", 1), U.whole("l_extendedprice", 1), U.only("l_linestatus", "O")]
    return suite_report(table(spark, sf_dir, "lineitem"), rules)


@query
def range_violations(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_quantity")
    bad = K.out_of_range(lines, ["l_discount", "l_quantity"])
    return bad.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~X.is_whole(F.col("l_quantity"))).alias("fractional"))


@query
def constant_columns(spark, sf_dir):
    t = table(spark, sf_dir, "orders")
    return A.union_all([K.several_values(t, c).select(F.lit(c).alias("column"), "values") for c in ("o_orderstatus", "o_orderpriority")])


@query
def duplicate_keys(spark, sf_dir):
    return K.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def blank_identity(spark, sf_dir):
    return K.blank_rows(order_votes(spark, sf_dir), ["confidence"]).groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))


@query
def vocabulary_difference(spark, sf_dir):
    """(language, source) cells with toxic documents or with poor ones, but not with both."""
    docs = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return K.symmetric_difference(docs.filter("toxic = 1").select("lang", "source").distinct(), docs.filter("quality = 0").select("lang", "source").distinct())


@query
def one_to_one_join(spark, sf_dir):
    """Orders and the sums of their lines, each key once on either side."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity"))
    joined = K.join_one_to_one(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), lines, ["o_orderkey"])
    return rounded(joined.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"), F.sum("lines").alias("lines"), F.sum("quantity").alias("quantity")))


@query
def spelling_check(spark, sf_dir):
    """Labels that lack a single spelling: flags stand in either case by the parity of their line, one label is absent."""
    flags = table(spark, sf_dir, "lineitem").select(F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1), " r").otherwise(F.col("l_returnflag")).alias("flag"))
    return K.label_spellings(flags, "flag", ["A", "N", "R", "X"])


@query
def annotator_counts(spark, sf_dir):
    """Items whose number of annotators is not whole or below three."""
    return K.not_whole(all_items(spark, sf_dir), "n_annotators", 3).groupBy("n_annotators").agg(F.count(F.lit(1)).alias("items"))


@query
def split_sizes(spark, sf_dir):
    """Splits outside their bounds: dev is sound, test is told to be small, a third does not exist."""
    own = G.assign(items(spark, sf_dir), DEV, SENSITIVITY)
    return K.group_sizes_outside(own, "split", {"dev": (DEV, DEV + 50), "test": (1, 10), "absent": (1, 5)})


@query
def unlabelled_documents(spark, sf_dir):
    """Documents with a null in any of their label columns."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return L.any_null(docs, ["quality", "toxic"]).groupBy("lang").agg(F.count(F.lit(1)).alias("documents"))


@query
def single_row(spark, sf_dir):
    """The one region whose name begins with EU."""
    return rounded(K.exactly_one(table(spark, sf_dir, "region").filter(F.col("r_name").startswith("EU"))))


@query
def scalar_functions(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", X.one_line(F.col("text")).alias("line"), X.number_text(F.col("n_chars") / 7, 3).alias("number"), F.initcap(F.lower(F.col("lang"))).alias("title"),
        F.bround(F.col("n_chars") / 10).cast("bigint").alias("half_even"), X.as_bool(F.when(F.col("n_chars") % 2 == 0, " TRUE ").otherwise("no")).alias("flag"),
        F.array_join(X.name_parts(F.lit("Source-Cell Name_2")), "+").alias("parts"),
    )


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {k: v for k, v in oracles.SQL.items() if k in QUERIES}
