"""The constraint suite, manifests, snapshots and sinks."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from plurality.operators import suite as U
from plurality.operators.constraints import ConstraintError
from plurality.sources import files, snapshot
from plurality.sources import manifest as M

COLUMNS = ["item_id", "content_id", "bucket", "n_annotators", "p_A", "human_A", "variant", "model", "sensitivity"]


def frame(spark, change=None, rows=8):
    own = [{"item_id": f"i{k}", "content_id": f"c{k}", "bucket": "b", "n_annotators": 3.0, "p_A": k / 10, "human_A": 0.5, "variant": "canonical", "model": "m1", "sensitivity": k < 2} for k in range(rows)]
    for k, values in (change or {}).items():
        own[k].update(values)
    return spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in own], "item_id string, content_id string, bucket string, n_annotators double, p_A double, human_A double, variant string, model string, sensitivity boolean").repartition(3)


def rules(rows=8):
    return [U.row_count(rows), U.unique("item_id"), U.present("content_id", "bucket"), U.in_unit("p_A", "human_A"), U.whole("n_annotators", 1), U.only("variant", "canonical"), U.only("model", "m1"), U.flagged("sensitivity", 2)]


PLANTED = [
    ({0: {"item_id": "i1"}}, "unique item_id"), ({0: {"item_id": None}}, "unique item_id"), ({0: {"bucket": None}}, "bucket present"), ({0: {"p_A": None}}, "p_A in"), ({0: {"p_A": 1.01}}, "p_A in"),
    ({0: {"p_A": float("nan")}}, "p_A in"), ({0: {"human_A": -0.01}}, "human_A in"), ({0: {"n_annotators": 2.5}}, "n_annotators whole"), ({0: {"n_annotators": 0.0}}, "n_annotators whole"),
    ({0: {"variant": "strict"}}, "variant only"), ({k: {"model": None} for k in range(8)}, "model has"), ({0: {"sensitivity": False}}, "2 rows sensitivity"), ({0: {"sensitivity": None}}, "2 rows sensitivity"),
]


def test_a_suite_is_one_scan_and_finds_each_planted_fault(spark, tmp_path):
    whole = frame(spark)
    whole.write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    found = U.report(read, rules())
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert found.filter("NOT holds").count() == 0
    U.require(read, rules())
    for change, name in PLANTED:
        broken = [r["rule"] for r in U.report(frame(spark, change), rules()).filter("NOT holds").collect()]
        assert len(broken) == 1 and broken[0].startswith(name), (change, broken)
    with pytest.raises(ConstraintError, match="found 8, wanted 3"):
        U.require(read, rules(3))
    empty = U.report(read.limit(0), rules())
    assert {r["rule"] for r in empty.filter("NOT holds").collect()} == {"8 rows", "variant has canonical", "model has m1", "2 rows sensitivity"}


def test_a_bad_export_never_becomes_visible(spark, tmp_path):
    at = str(tmp_path / "out")
    found = U.write_checked(frame(spark), at, rules(), columns=COLUMNS, forbidden={"text", "annotator"})
    assert found["8 rows"] == 8 and spark.read.parquet(at).columns == COLUMNS
    for change, name in PLANTED[::3]:
        with pytest.raises(ConstraintError, match=name.split()[0]):
            U.write_checked(frame(spark, change), at, rules())
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"] and spark.read.parquet(at).count() == 8
    for bad in ("raw_text", "annotator_id"):
        with pytest.raises(ConstraintError, match="forbidden"):
            U.write_checked(frame(spark).withColumn(bad, F.lit("x")), at, [], forbidden={"text", "annotator"})
    with pytest.raises(ConstraintError, match="columns"):
        U.write_checked(frame(spark).select("item_id"), at, [], columns=COLUMNS)
    U.write_checked(frame(spark, rows=3), at, [U.row_count(3)])
    assert spark.read.parquet(at).count() == 3


def test_manifest_of_part_files(spark, tmp_path):
    (tmp_path / "data" / "sub").mkdir(parents=True)
    (tmp_path / "data" / "a.csv").write_bytes(b"x\n1\n")
    (tmp_path / "data" / "sub" / "big part.bin").write_bytes(bytes(range(256)) * 20_000)
    for whole in (1 << 30, 100):
        found = {r["path"]: (r["bytes"], r["sha256"]) for r in M.manifest(spark, str(tmp_path / "data"), whole=whole).collect()}
        assert {k.replace("%20", " ") for k in found} == {"a.csv", "sub/big part.bin"}
        assert found["a.csv"] == (4, hashlib.sha256(b"x\n1\n").hexdigest())
        assert {v for k, v in found.items() if "big" in k} == {(5_120_000, hashlib.sha256(bytes(range(256)) * 20_000).hexdigest())}
    M.manifest(spark, str(tmp_path / "data")).write.parquet(str(tmp_path / "listed"))
    listed = spark.read.parquet(str(tmp_path / "listed"))
    assert M.differences(listed, M.manifest(spark, str(tmp_path / "data"))).count() == 0
    (tmp_path / "data" / "a.csv").write_bytes(b"x\n2\n")
    (tmp_path / "data" / "new").write_bytes(b"n")
    (tmp_path / "data" / "sub" / "big part.bin").unlink()
    assert sorted(r["problem"] for r in M.differences(listed, M.manifest(spark, str(tmp_path / "data"))).collect()) == ["changed", "missing", "unlisted"]


def test_pinned_snapshot(spark, tmp_path):
    snapshot.register(spark)
    at = str(tmp_path / "snap")
    rows = spark.range(1000).select("id", (F.col("id") % 7).cast("string").alias("kind"), (F.col("id") / 3).alias("x"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        about = snapshot.write_snapshot(rows, at, "r1", order=["id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert about["rows"] == 1000 and len(about["files"]) > 2
    read = lambda revision="r1", **o: spark.read.format("pinned_snapshot").options(revision=revision, **o).load(at)
    assert read().schema == rows.schema and sorted(map(tuple, read().collect())) == sorted(map(tuple, rows.collect()))
    assert read().filter("id >= 990 AND kind = '3'").count() == rows.filter("id >= 990 AND kind = '3'").count()
    assert read().filter("id > 5000").count() == 0
    with pytest.raises(snapshot.SnapshotError, match="already"):
        snapshot.write_snapshot(rows, at, "r2")
    with pytest.raises(Exception, match="pinned r2"):
        read("r2").count()
    with pytest.raises(Exception, match="missing columns"):
        read(columns="id,absent").count()
    # Files that a filter excludes are not opened: a broken one does no harm until it is needed.
    first = min(about["files"], key=lambda f: f["ranges"]["id"])
    with open(f"{at}/{first['name']}", "ab") as f:
        f.write(b"!")
    assert read().filter("id >= 900").count() == 100
    with pytest.raises(Exception, match="not the file of the snapshot"):
        read().count()
    said = json.loads((tmp_path / "snap" / "snapshot.json").read_text())
    del said["revision"]
    (tmp_path / "snap" / "snapshot.json").write_text(json.dumps(said))
    with pytest.raises(Exception, match="does not say its revision"):
        read().count()


def test_significant_digits(spark, tmp_path):
    values = [0.1, 1 / 3, 2.5, 1e22, 123456789.125, 1e-5, 0.0001, -0.0, 5e-324, 1e100, 1e16, 123456.7890625, float("inf"), float("nan"), None, 100.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k int, x double")
    for digits in (17, 10):
        found = {r[0]: r[1] for r in df.select("k", files.significant(F.col("x"), digits)).collect()}
        assert found == {i: None if v is None else f"%.{digits}g" % v for i, v in enumerate(values)}
    files.write_stamped_csv(df.filter("k < 2").coalesce(1), str(tmp_path / "s"), "exploratory")
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "s")).orderBy("k").collect()] == [("exploratory", "0", "0.1"), ("exploratory", "1", "0.3333333333")]
    files.write_stable_csv(df.filter("k < 2"), str(tmp_path / "t"), ["k"], digits=17)
    assert [r["x"] for r in spark.read.option("header", True).csv(str(tmp_path / "t")).orderBy("k").collect()] == ["0.10000000000000001", "0.33333333333333331"]


def test_bucketed_tables_join_without_an_exchange(spark):
    left, right = spark.range(500).select(F.col("id").alias("item_id"), F.rand(1).alias("h")), spark.range(500).select(F.col("id").alias("item_id"), F.rand(2).alias("p"))
    files.write_bucketed(left, "bucketed_left", ["item_id"], 4)
    files.write_bucketed(right, "bucketed_right", ["item_id"], 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("bucketed_left").join(spark.table("bucketed_right"), "item_id").groupBy("item_id").agg(F.sum("h"), F.sum("p"))
        assert joined.count() == 500
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange hashpartitioning(item_id" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_left")
        spark.sql("DROP TABLE bucketed_right")
