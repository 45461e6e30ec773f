import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from plurality.functions import exprs as X
from plurality.functions import stats as S
from plurality.operators import analysis as A
from plurality.operators import audit as D
from plurality.operators import cleaning as C
from plurality.operators import constraints as K
from plurality.operators import inference as I
from plurality.operators import release as R
from plurality.operators import split as G
from plurality.sources import files


def row(text, who, labels, confidence="Confident", source="s", bucket="b"):
    return (text, source, bucket, who, labels, confidence)


def votes(spark, rows, seed=None):
    rows = list(rows)
    if seed is not None:
        random.Random(seed).shuffle(rows)
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in C.RAW))


BASE = [row("t1", w, "care,loyal") for w in "abc"] + [row("t2", w, "care") for w in "abc"] + [row("t3", "a", "care"), row("t3", "b", "none")]


def shares(spark, rows, seed=None):
    kept = C.retained_votes(C.semantic_dedupe(votes(spark, rows, seed)))
    return sorted((r["text"], r["n_annotators"], r["human_care"], r["human_loyal"]) for r in C.vote_shares(kept, ["care", "loyal"]).collect())


def test_cleaning_steps_and_row_order(spark):
    rows = BASE + [row("t1", "a", "care,loyal"), row("t1", "b", "loyal, care"), row("t2", "c", "loyal")]
    once = shares(spark, rows, 1)
    assert once == shares(spark, rows, 2) == [("t1", 3, 1.0, 1.0), ("t3", 2, 0.5, 0.0)]
    audit = C.audit(votes(spark, rows), ["care", "loyal"]).first().asDict()
    assert audit == {"raw_rows": 11, "after_exact": 10, "after_semantic": 9, "conflicting_pairs": 1, "conflicted_items": 1, "retained_votes": 5, "retained_items": 2, "eligible_items": 1}


def test_audit_record_names_every_step_and_takes_an_empty_table(spark):
    rows = BASE + [row("t1", "a", "care,loyal"), row("t1", "b", "loyal, care"), row("t2", "c", "loyal")]
    found = dict(D.audit_record(votes(spark, rows, 3), ["care", "loyal"], dev=1, sensitivity=1, raw_sha256="abc").collect())
    want = {
        "raw_rows_before_exact_dedup": "11", "raw_rows_after_exact_dedup": "10", "exact_duplicate_rows_removed": "1", "semantic_duplicates_removed": "1",
        "semantic_duplicate_groups": "1", "conflicting_item_annotator_groups": "1", "items_excluded_for_conflicts": "1", "rows_excluded_for_conflicting_items": "4",
        "items_before_conflict_exclusion": "3", "items_remaining_after_conflict_exclusion": "2", "items_excluded_lt_min_annotators": "1", "eligible_items": "1",
        "retained_item_annotator_pairs_unique": "true", "annotator_count_distribution_all": '{"2":1,"3":1}', "dev_items": "1", "test_items": "0", "sensitivity_items": "0",
        "atomic_labels": '["care","loyal","none"]', "exact_half_ties_by_code": '{"care":0,"loyal":0}', "raw_sha256": "abc", "exact_text_grouped_across_splits": "true",
    }
    assert {k: found[k] for k in want} == want and len(found) == 33
    empty = dict(D.audit_record(votes(spark, []), ["care"], dev=1, sensitivity=1).collect())
    assert empty["raw_rows_before_exact_dedup"] == empty["dev_items"] == "0" and empty["sources"] == "[]" and empty["annotator_count_distribution_all"] == "{}"
    crossed = [row("same", w, "care") for w in "abc"] + [row("same", w, "care", source="other") for w in "abc"]
    both = dict(D.audit_record(votes(spark, crossed), ["care"], dev=1, sensitivity=1).collect())
    assert (both["cross_source_exact_text_groups"], both["source_cell_count"], both["dev_items"]) == ("1", "2", "2")


def test_conflict_in_confidence_excludes_the_item_and_nothing_else(spark):
    assert shares(spark, BASE + [row("t3", "a", "care", "Not Confident")]) == [x for x in shares(spark, BASE) if x[0] != "t3"]
    with pytest.raises(ValueError):
        C.eligible(None, 2)


def test_expressions(spark):
    d = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (0.3,), (0.7,), (1.5,), (None,)], "p double")
    h = [r[0] for r in d.select(X.entropy(F.col("p"))).collect()]
    assert h[0] == 0 and abs(h[1] - math.log(2)) < 1e-12 and h[2] == 0 and h[3] == h[4] and h[5] is None and h[6] is None
    pairs = spark.createDataFrame([(0.0, 3), (1.0, 3), (1 / 3, 3), (2 / 3, 3), (0.5, 4), (0.5, 1)], "h double, n int")
    got = [r[0] for r in pairs.select(X.disagreement(F.col("h"), F.col("n"))).collect()]
    assert got[:2] == [0, 0] and all(abs(g - 2 / 3) < 1e-12 for g in got[2:5]) and got[5] is None
    labels = spark.createDataFrame([(" b,a ,,a\t",)], "x string").select(X.label_signature(F.col("x"))).first()[0]
    assert labels == "a,b"


def test_statistics(spark):
    line = spark.createDataFrame([("c", 0.0, 0.0, 1), ("c", 0.5, 0.0, 1), ("c", 1.0, 1.0, 10)], "code string, p double, h double, w int")
    fit = S.weighted_line(line, ["code"], "p", "h", "w").first()
    assert abs(fit["intercept"] + 0.196078431372549) < 1e-12 and abs(fit["slope"] - 1.1764705882352942) < 1e-12
    area = lambda rows: S.auc(spark.createDataFrame(rows, "y int, s double"), [], "y", "s").first()[0]
    assert area([(0, 0.5), (1, 0.5), (0, 0.1), (1, 0.9)]) == 0.875
    assert area([(0, 0.1), (1, 0.9)]) == 1.0 and area([(1, 0.1), (1, 0.9)]) is None
    rho = lambda rows: S.spearman(spark.createDataFrame(rows, "x double, y double"), [], "x", "y").first()[0]
    assert abs(rho([(1.0, 2.0), (2.0, 3.0), (3.0, 9.0), (None, 1.0), (4.0, float("nan"))]) - 1) < 1e-12
    assert rho([(1.0, 2.0), (1.0, 3.0), (1.0, 9.0)]) is None and rho([(1.0, 2.0), (2.0, 3.0)]) is None


def test_weighted_ranks_equal_resampled_rows(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 9) / 10, rng.randint(0, 9) / 10, rng.randint(0, 3)) for _ in range(60)]
    weighted = spark.createDataFrame([r for r in rows if r[2]], "x double, y double, m int")
    copied = spark.createDataFrame([r[:2] for r in rows for _ in range(r[2])], "x double, y double")
    assert abs(S.spearman(weighted, [], "x", "y", weight="m").first()[0] - S.spearman(copied, [], "x", "y").first()[0]) < 1e-12


def test_rank_correlation_of_millions_of_rows(spark):
    # Their cube is above 2^63 at 2,097,152 rows; the rank of a value is the same multiple of the rows in both tables.
    rows = [("a", 1.0, 4.0, 3), ("a", 2.0, 4.0, 2), ("a", 2.0, 7.0, 1), ("a", 5.0, 1.0, 4), ("flat", 1.0, 3.0, 3), ("flat", 2.0, 3.0, 7), ("flat", 3.0, 3.0, 1)]
    rho = lambda times, keys: {r[0] if keys else "": r["rho"] for r in S.spearman(spark.createDataFrame([(*r[:3], r[3] * times) for r in rows if keys or r[0] == "a"], "k string, x double, y double, m long"), keys, "x", "y", weight="m").collect()}
    few, many = rho(1, ["k"]), rho(1_000_003, ["k"])
    assert abs(few["a"] - many["a"]) < 1e-12 and few["flat"] is None and many["flat"] is None
    assert abs(rho(1_000_003, [])[""] - few["a"]) < 1e-12


def test_scores_are_not_shuffled_to_meet_few_rows(spark):
    rows = [(f"t{i % 70}", f"i{i}", "ab"[i % 2], (i % 9) / 8, (i % 5) / 4, 3 + i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "text string, item_id string, code string, h double, p double, n_annotators int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parted = G.assign(df, 20, 10)
        fitted = spark.createDataFrame(A.calibration(parted.filter("split = 'dev'")).collect())
        out = A.calibrate(parted.filter("split = 'test'"), fitted)
        joins = [x for x in (parted, out) if "SortMergeJoin" in x._jdf.queryExecution().sparkPlan().toString()]
        assert not joins and out.count() == parted.filter("split = 'test'").count()
        order = sorted({r[0] for r in rows}, key=lambda t: hashlib.sha256(f"dev:42:{t}".encode()).hexdigest())
        sizes, taken, dev = {t: sum(r[0] == t for r in rows) for t in order}, 0, set()
        for t in order:
            if taken >= 20:
                break
            taken, dev = taken + sizes[t], dev | {t}
        assert {r["text"] for r in parted.filter("split = 'dev'").collect()} == dev
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_split_keeps_texts_together(spark):
    docs = spark.createDataFrame([(i, f"text {i % 30}") for i in range(100)], "id long, text string")
    split = G.assign(docs, 20, 10)
    K.assert_empty(G.leaks(split), "leak")
    sizes = {(r["split"], r["sensitivity"]): r["count"] for r in split.groupBy("split", "sensitivity").count().collect()}
    assert sizes["dev", False] >= 20 and sizes["test", True] >= 10 and ("dev", True) not in sizes


def test_constraints(spark):
    d = spark.createDataFrame([(1, "0.5", " \t"), (1, "1.5", "x"), (2, "no", "y")], "k int, p string, s string")
    assert K.duplicate_keys(d, ["k"]).count() == 1 and K.out_of_range(d, ["p"]).count() == 2 and K.blank_rows(d, ["s"]).count() == 1
    with pytest.raises(K.ConstraintError, match="twice"):
        K.assert_empty(K.duplicate_keys(d, ["k"]), "twice")
    with pytest.raises(K.ConstraintError):
        K.forbid_name_parts(spark.range(1).withColumnRenamed("id", "annotator_name"), ["annotator"])
    with pytest.raises(Exception, match="exactly one"):
        K.exactly_one(d).collect()


def test_inference_resumes_and_flattens(spark, tmp_path):
    def make():
        return lambda texts, variants: ['{"model":"m1","answers":{"A":{"type":"p","noul":0.25}},"usage":{"input_tokens":3,"output_tokens":1}}' for _ in texts]

    jobs = spark.createDataFrame([("e", "p", str(i), "v", "h", "m1", "s", f"t{i}") for i in range(6)], ", ".join(f"{c} string" for c in [*I.KEY, "text"]))
    path = str(tmp_path / "cache")
    I.append_calls(I.call(jobs.filter("item_id < '4'"), make), path)
    cache = spark.read.parquet(path)
    assert sorted(r["item_id"] for r in I.pending(jobs, cache).collect()) == ["4", "5"]
    assert I.pending(jobs, cache, most=1).count() == 1 and I.completed(jobs, cache).count() == 4
    flat = I.flatten(cache, ["A"])
    assert {(r["p_A"], r["consistent"]) for r in flat.collect()} == {(0.25, True)}
    assert I.drifted(flat, "m1").count() == 0 and I.drifted(flat, "m2").count() == 1


def test_files(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text('a,b\nNA,"x, ""q""\nnext"\n,\n')
    assert [tuple(r) for r in files.read_raw_csv(spark, str(path), ["a", "b"]).collect()] == [("NA", 'x, "q"\nnext'), ("", "")]
    d = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert files.content_hash(d).first() == files.content_hash(d.orderBy(F.desc("k")).repartition(2)).first()
    files.write_json({"x": float("nan"), "ok": True}, str(tmp_path / "x.json"))
    assert files.read_json(str(tmp_path / "x.json")) == {"x": None, "ok": True}
    assert "| 1 | a |" in files.markdown_table(d)


def test_planted_violations_are_found(spark):
    split = spark.createDataFrame([("t1", "dev"), ("t1", "test"), ("t2", "dev")], "text string, split string")
    assert [tuple(r) for r in G.leaks(split).collect()] == [("t1", 2)]
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert [r[0] for r in K.shared_keys(a, b, ["k"]).collect()] == [2] and sorted(r[0] for r in K.symmetric_difference(a, b).collect()) == [1, 3]
    with pytest.raises(K.ConstraintError, match="right"):
        K.join_one_to_one(a, b.unionByName(b), ["k"])
    assert K.join_one_to_one(a, b, ["k"]).count() == 1
    labels = spark.createDataFrame([("Care",), (" care",), ("loyal",)], "x string")
    assert sorted(tuple(r) for r in K.label_spellings(labels, "x", ["care", "loyal", "purity"]).collect()) == [("care", 2), ("purity", 0)]
    assert sorted(tuple(r) for r in K.group_sizes_outside(split, "split", {"dev": (1, 1), "test": (1, 5), "none": (1, 2)}).collect()) == [("dev", 2), ("none", 0)]
    numbers = spark.createDataFrame([(1.0,), (2.5,), (3.0,), (None,)], "n double")
    assert K.not_whole(numbers, "n", 2).count() == 3
    with pytest.raises(K.ConstraintError, match="missing"):
        K.require_columns(a, ["k", "v"])


def test_stable_csv_and_checksums(spark, tmp_path):
    import gzip

    rows = [(i % 7, i / 3, None if i % 5 == 0 else f"v{i}") for i in range(200)]
    bytes_of = lambda p: [gzip.decompress(f.read_bytes()) for f in sorted(p.glob("*.gz"))]
    for name, own in (("a", rows), ("b", rows[::-1])):
        files.write_stable_csv(spark.createDataFrame(own, "k int, x double, v string").repartition(3), str(tmp_path / name), ["k"])
    first, again = b"".join(bytes_of(tmp_path / "a")), b"".join(bytes_of(tmp_path / "b"))
    assert first == again
    back = spark.read.option("header", True).schema("k int, x double, v string").csv(str(tmp_path / "a"))
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(rows, key=repr)
    one = tmp_path / "one"
    one.write_text("x")
    files.require_hash(str(one), files.file_hash(str(one)))
    with pytest.raises(ValueError, match="expected"):
        files.require_hash(str(one), "0")


def test_ranks_of_continuous_and_tied_scores(spark):
    """Ranks equal a plain sort, and the buckets that meet in one window do not grow with the distinct scores."""
    rnd = random.Random(7)
    scores = [rnd.lognormvariate(0, 4) for _ in range(3000)] + [0.25] * 1500 + [-1e6, 1e9, None, None]
    rows = [(k, f"{rnd.getrandbits(64):016x}", s) for k in "ab" for s in scores]
    df = spark.createDataFrame(rows, "k string, id string, s double").cache()
    for down in (False, True):
        sign = -1 if down else 1
        own = sorted(rows, key=lambda r: (r[2] is not None, sign * (r[2] or 0), r[1]))
        ranked = {r["id"]: r["rank"] for r in S.global_rank(df, "s", "id", descending=down).collect()}
        assert [ranked[r[1]] for r in own] == list(range(1, len(rows) + 1))
        ranked = {r["id"]: r["rank"] for r in S.global_rank(df, "s", "id", keys=["k"], descending=down).collect()}
        assert all([ranked[r[1]] for r in own if r[0] == k] == list(range(1, len(scores) + 1)) for k in "ab")
    with_null = S.global_rank(df.filter("k = 'a'").unionByName(spark.createDataFrame([(None, "00", 1.0), (None, "01", 0.5)], "k string, id string, s double")), "s", "id").collect()
    assert sorted(r["rank"] for r in with_null) == list(range(1, len(scores) + 3))


def test_ranks_part_the_work_evenly_at_any_size(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for n, parts in ((4000, 4), (16000, 16)):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            skewed = spark.range(n).select(F.when(F.col("id") % 3 == 0, 0.25).otherwise(F.exp(F.rand(1) * 20)).alias("s"), F.sha2(F.col("id").cast("string"), 256).alias("id"))
            sizes = [r["count"] for r in S.ranged(skewed, ["s", "id"]).groupBy("_part").count().collect()]
            assert len(sizes) == parts and max(sizes) < 3 * n / parts
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_mean_ranks_outside_the_unit_interval(spark):
    rnd = random.Random(8)
    values = [rnd.choice([-3.5, 0.0, 17.0, 4e5]) if rnd.random() < 0.5 else rnd.gauss(0, 1e4) for _ in range(2000)]
    got = {r["v"]: r["r"] for r in S.average_ranks(spark.createDataFrame([("x", v, 1) for v in values], "k string, v double, w int"), ["k"], "v", "w", "r").collect()}
    own = sorted(values)
    assert all(abs(got[v] - (own.index(v) + 1 + (own.count(v) - 1) / 2)) < 1e-9 for v in set(values))


def test_release_frame_and_label_groups(spark):
    df = spark.createDataFrame([("b", 1, ["x"], False), ("a", 0, ["y"], None), ("c", None, ["x"], True)], "item_id string, f int, labels array<string>, unclear boolean")
    out = R.release_frame(df, ["f", "item_id"], ["f"])
    assert out.columns == ["f", "item_id"] and [tuple(r) for r in out.collect()] == [(False, "a"), (True, "b"), (None, "c")]
    with pytest.raises(ValueError):
        R.release_frame(df, ["item_id", "absent"], [])
    got = {r[0]: r[1] for r in df.select("item_id", R.in_group(F.col("labels"), ["x", "z"], F.col("unclear"))).collect()}
    assert got == {"b": 1, "a": 0, "c": None}
