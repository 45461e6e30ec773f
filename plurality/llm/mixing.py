"""Mixing sources to target weights by weighted fair queueing.

Every document of a source waits in that source's shuffled queue, and again behind it for each further
epoch. Its virtual finish time is (tokens of its source up to and with it) / (its source's target), so
all sources advance at rates in proportion to their targets. The mix is the prefix, in the order of
finish times over all sources, whose tokens fit the budget.

Both running sums are two-level: a queue is cut into about sqrt(n) buckets of its shuffle hash (then of
finish time), bucket totals get the prefix sums, and rows are only summed inside a bucket. So a source
with a third of all rows is spread over as many tasks as any. Rows that share an id, or have none, are told
apart by their text's hash and a number, so each has a place of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plurality.llm.common import WORD, materialize, table, text_or_empty

CYCLE = (1, 2, 3)
EPOCHS = 3
SEED = 7
#: Equal rows are written out in chunks of so many.
CHUNK = 10_000
#: Virtual time from which all entries are one bucket: targets sum to the budget, which so ends near time 1 (speed only).
FAR = 2.0
NULL_KEY, KEY = "null", "="


def source_targets(sized: DataFrame, cycle=CYCLE, epochs: int = EPOCHS, budget: float | None = None) -> DataFrame:
    """One row for each source: ``skey, n, source_size, sid, weight, target``.

    Sources by code point, null last, get the weights of ``cycle`` in turn and share the budget (default:
    all sizes). A target stops at ``epochs`` times its source's size and the excess is shared again by
    weight; with sources ordered by cap/weight that has a closed form, which running sums over the source
    table give: the level at the first source whose share stays under its cap, from where levels only fall.
    """
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    share = F.lit(float(budget)) if budget is not None else F.sum("source_size").over(Window.partitionBy()).cast("double")
    cycle_at = F.array(*[F.lit(float(w)) for w in cycle])
    rows = (
        sized.groupBy("skey", "source")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
        .withColumn("sid", F.row_number().over(by_source))
        .withColumn("weight", F.element_at(cycle_at, ((F.col("sid") - 1) % len(cycle) + 1).cast("int")))
        .withColumn("cap", (F.col("source_size") * epochs).cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("whole", share)
    )
    up = Window.orderBy("ratio", "sid")
    level = (F.col("whole") - F.col("cap_before")) / F.col("weight_left")
    rows = (
        rows.withColumn("cap_before", F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
        .withColumn("weight_left", F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.when(level <= F.col("ratio"), level))
        .withColumn("level", F.max("level").over(Window.partitionBy()))
    )
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return rows.select("skey", "source", "n", "source_size", "sid", "weight", F.round(target, 6).alias("target"))


def _key(id_col: str, text_col: str, source_col: str) -> list:
    """What tells rows apart: ``idkey, skey, t, size``, none of them null."""
    key = lambda c: F.coalesce(F.concat(F.lit(KEY), F.col(c).cast("string")), F.lit(NULL_KEY))
    text = text_or_empty(text_col)
    return [key(id_col).alias("idkey"), key(source_col).alias("skey"), F.xxhash64(text).alias("t"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size")]


def _numbered(rows: DataFrame, seed: int) -> DataFrame:
    """``rows`` with the shuffle hash ``h``: of the id where its source has it once, else of id, text and number.

    Equal rows are counted, which a hot one does map-side, and numbered by writing the count out again, in
    chunks that meet different tasks.
    """
    counted = materialize(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")), "mix-counted")
    shared = materialize(counted.groupBy("idkey", "skey").agg(F.sum("n").alias("rows")).filter("rows > 1").select("idkey", "skey", F.lit(True).alias("shared")), "mix-shared")
    once = counted.filter("n = 1").withColumn("number", F.lit(0).cast("long"))
    chunks = counted.filter("n > 1").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {CHUNK}")))).repartition("idkey", "skey", "t", "chunk")
    start = F.col("chunk") * CHUNK
    more = chunks.withColumn("number", F.explode(F.sequence(start, F.least(start + CHUNK, F.col("n")) - 1))).drop("chunk")
    own = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    told = F.concat_ws(":", own, F.col("idkey"), F.col("t").cast("string"), F.col("number").cast("string"))
    numbered = once.unionByName(more).join(shared, ["idkey", "skey"], "left")
    return numbered.withColumn("h", F.md5(F.when(F.col("shared"), told).otherwise(own))).drop("n", "number", "shared")


def fair_queue(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", cycle=CYCLE, epochs=EPOCHS, budget=None, seed=SEED) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, source, skey, h, size, source_size, target, copies, taken``.

    ``copies`` is how many epochs of the document the mix takes, ``taken`` its words times that. Null text:
    size 0, never taken. Null source: a source of its own, last. Rows that repeat an id, or have none, are shuffled
    apart by text and number, rows that repeat whole by number. Empty table: no rows. Only named columns are read,
    so others cannot clash.
    """
    sized = materialize(_numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), *_key(id_col, text_col, source_col)), seed), "mix-sized")
    sources = materialize(source_targets(sized, cycle, epochs, budget), "mix-sources")
    unit = F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / float(2**32)
    placed = sized.join(sources.drop("source"), "skey").withColumn("bucket", F.floor(unit * F.ceil(F.sqrt("n"))))
    # Running tokens of each queue: inside a bucket, plus the totals of the buckets before.
    key = ["skey", "bucket"]
    inside = Window.partitionBy(*key).orderBy("h", "doc_id", "size").rangeBetween(Window.unboundedPreceding, 0)  # equal rows: one place
    before = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*key).agg(F.sum("size").alias("tokens")).withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0))).drop("tokens")
    queued = placed.withColumn("own", F.sum("size").over(inside)).join(totals, key).withColumn("upto", F.col("own") + F.col("before"))
    queued = materialize(queued.select("doc_id", "source", "skey", "idkey", "t", "h", "size", "source_size", "sid", "target", "upto"), "mix-queued")

    finish = lambda e: (F.col("upto") + F.lit(e) * F.col("source_size")) / F.col("target")
    place = lambda e: F.struct(finish(e).alias("finish"), F.col("sid"), F.lit(e).alias("epoch"), F.col("h"), F.col("doc_id"), F.col("size"))
    waiting = (F.col("size") > 0) & (F.col("target") > 0)
    cut = _cut(queued.filter(waiting).select("size", F.explode(F.array(*[place(e) for e in range(epochs)])).alias("at")), sources, budget)
    if cut is None:
        copies = F.lit(0)
    else:
        last = F.struct(F.lit(cut["finish"]).alias("finish"), F.lit(cut["sid"]).alias("sid"), F.lit(cut["epoch"]).alias("epoch"), F.lit(cut["h"]).alias("h"), F.lit(cut["doc_id"]).cast(docs.schema[id_col].dataType).alias("doc_id"), F.lit(cut["size"]).cast("long").alias("size"))
        copies = F.when(waiting, sum(F.when(place(e) <= last, 1).otherwise(0) for e in range(epochs))).otherwise(0)
    return queued.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))


def _bucketed(entries: DataFrame, steps: int) -> DataFrame:
    return entries.withColumn("bucket", F.floor(F.least("at.finish", F.lit(FAR)) * steps))


def _cut(entries: DataFrame, sources: DataFrame, budget: float | None):
    """The place of the last entry that fits the budget, or None; two single rows reach the driver."""
    facts = sources.agg(F.sum("source_size").alias("all"), F.sum("n").alias("n")).first()
    if not facts["n"] or not facts["all"]:
        return None
    limit = facts["all"] if budget is None else budget
    # All queues together pass equal amounts of tokens in equal spans of virtual time: even buckets.
    steps = max(1, int(facts["n"] ** 0.5))
    entries = _bucketed(entries, steps)
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    reached = entries.groupBy("bucket").agg(F.sum("size").alias("tokens")).withColumn("upto", F.sum("tokens").over(upto))
    # The budget may end inside a bucket, or with its last row: rows of that bucket are sorted and summed.
    edge = reached.filter(F.col("upto") > limit).orderBy("bucket").limit(1)
    done = edge.first()
    if done is None:
        last = entries.agg(F.max("at").alias("at")).first()
        return last["at"]
    inside = Window.partitionBy("bucket").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    rows = entries.filter(F.col("bucket") == done["bucket"]).withColumn("run", F.sum("size").over(inside) + F.lit(done["upto"] - done["tokens"]))
    found = rows.filter(F.col("run") <= limit).agg(F.max("at").alias("at")).first()["at"]
    if found is None:
        found = entries.filter(F.col("bucket") < done["bucket"]).agg(F.max("at").alias("at")).first()["at"]
    return found


def op7_weighted_fair_mix(spark, sf_dir):
    mixed = fair_queue(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: each row as many times as epochs were taken, zero-word rows never.

    Rows with the same id, source and text share what the mix takes of them evenly; where it does not divide,
    which of them stands once more is not fixed.
    """
    key = ["idkey", "skey", "t", "size"]
    mixed = fair_queue(docs, **options)
    copies = mixed.groupBy(*key).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n")).filter("copies > 0")
    id_col, text_col, source_col = options.get("id_col", "doc_id"), options.get("text_col", "text"), options.get("source_col", "source")
    keyed = docs.select(F.struct("*").alias("_row"), *_key(id_col, text_col, source_col))
    out = keyed.join(copies.filter("n = 1"), key).select("_row", "copies")
    several = materialize(copies.filter("n > 1"), "mix-several")
    if not several.isEmpty():
        # Rows are numbered inside the written parts, whose totals give each part its offset.
        repeats = keyed.join(several, key).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
        repeats = materialize(repeats, "mix-repeats")
        before = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = repeats.groupBy(*key, "part").agg(F.count(F.lit(1)).alias("own")).withColumn("before", F.coalesce(F.sum("own").over(before), F.lit(0))).drop("own")
        number = F.row_number().over(Window.partitionBy(*key, "part").orderBy("at")) + F.col("before")
        numbered = repeats.join(offsets, [*key, "part"]).withColumn("number", number)
        share = F.expr("copies div n") + F.when(F.col("number") <= F.col("copies") % F.col("n"), 1).otherwise(0)
        out = out.unionByName(numbered.select("_row", share.alias("copies")).filter("copies > 0"))
    return out.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long")))).select("_row.*")


#: The mix in DuckDB SQL over a relation {docs}; shared with the pipeline's oracle.
MIX_SQL = r"""
sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  md5('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM {docs}),
src AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid, sum(source_size) OVER ()::DOUBLE AS whole
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)),
weighed AS (SELECT *, ((sid - 1) % 3 + 1)::DOUBLE AS weight, (source_size * 3)::DOUBLE AS cap FROM src),
filled AS (SELECT *, cap / weight AS ratio,
  sum(cap) OVER (ORDER BY cap / weight, sid ROWS UNBOUNDED PRECEDING) - cap AS cap_before,
  sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left FROM weighed),
levels AS (SELECT *, max(CASE WHEN (whole - cap_before) / weight_left <= ratio THEN (whole - cap_before) / weight_left END) OVER () AS level FROM filled),
targets AS (SELECT source, sid, source_size, round(least(cap, coalesce(level * weight, cap)), 6) AS target FROM levels),
queued AS (SELECT s.doc_id, s.source, s.size, s.h, t.sid, t.source_size, t.target,
  sum(s.size) OVER (PARTITION BY t.sid ORDER BY s.h, s.doc_id, s.size RANGE UNBOUNDED PRECEDING) AS upto
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
entries AS (SELECT q.*, e.epoch, (upto + e.epoch * source_size)::DOUBLE / target AS finish
  FROM queued q, (VALUES (0), (1), (2)) e(epoch) WHERE size > 0 AND target > 0),
ordered AS (SELECT *, sum(size) OVER (ORDER BY finish, sid, epoch, h, doc_id, size RANGE UNBOUNDED PRECEDING) AS run FROM entries),
taken AS (SELECT doc_id, h, sid, size, count(*) AS copies FROM ordered WHERE run <= (SELECT sum(size) FROM sized) GROUP BY ALL)
"""

ORACLE = "WITH " + MIX_SQL.format(docs="documents") + """
SELECT q.doc_id, q.size, q.source_size, q.target, (coalesce(k.copies, 0) * q.size)::BIGINT AS taken
FROM queued q LEFT JOIN taken k ON q.h = k.h AND q.sid = k.sid AND q.size = k.size
"""
