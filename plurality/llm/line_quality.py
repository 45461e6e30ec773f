"""Quality rules with cross-document line frequency.

Each host's boilerplate is what many of its documents say: lines are normalised and hashed, distinct
documents are counted for each (host, line), lines above the limit are taken out, and a document that
loses most of its words is rejected. A few rules on the document itself are computed in the same scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plurality.llm.common import WORD, let, materialize, table, text_or_empty

WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: A line is boilerplate in more than MIN_DOCS documents of its host that are more than 1/SHARE of them, and in
#: more than MANY_DOCS of them whatever the host's size.
MIN_DOCS, SHARE, MANY_DOCS = 20, 50, 10_000
#: A document is depleted when more than this percentage of its words stood in such lines.
MAX_REMOVED_PERCENT = 50
#: Least number of tasks that a frequent line is met in, and documents for which one more is added.
SALTS, SALT_DOCS = 16, 1_000_000


def repeated_words(words: Column) -> Column:
    """How many words stand in an eight-word window that the array has twice or more.

    Window hashes come by doubling (1, 2, 4, 8 words), so no window is ever copied; only texts with a
    repeated hash sort theirs, and the sorted positions of such windows give the words they cover.
    """
    beside = lambda h, by: F.zip_with(h, F.slice(h, by + 1, F.size(h)), lambda a, b: F.xxhash64(a, b))
    count = F.size(words) - (WINDOW - 1)

    def positions(windows: Column) -> Column:
        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        equal = let(pairs, lambda s: F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"]))))
        return F.array_sort(F.array_distinct(F.flatten(F.filter(equal, lambda x: x.isNotNull()))))

    def covered(at: Column) -> Column:
        steps = F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    windows = let(F.transform(words, lambda w: F.xxhash64(w)), lambda one: let(beside(one, 1), lambda two: let(beside(two, 2), lambda four: F.slice(beside(four, 4), 1, count))))
    some = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), let(positions(w), covered)).otherwise(0))
    return F.when(count > 1, some).otherwise(0)


def normalised(text: Column) -> Column:
    """Lower case, digit runs as one 0, blanks other than line feeds as one space."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "0"), r"[\x20\x09\x0B-\x0D]+", " ")


def _host(host_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit("null"))


def _line_hashes(text: Column) -> Column:
    """(h, w) of each line: the hash of its normalised form, null for a blank one, and its words."""
    return F.transform(
        F.transform(F.split(normalised(text), "\n", -1), lambda x: F.trim(x)),
        lambda x: F.struct(F.when(x != "", F.xxhash64(x)).alias("h"), (F.length(x) - F.length(F.replace(x, F.lit(" "))) + 1).alias("w")),
    )


def _scan(docs: DataFrame, *, id_col="doc_id", text_col="text", host_col="source", min_docs=MIN_DOCS, share=SHARE) -> tuple[DataFrame, DataFrame]:
    """Counts and lines of every row, and which of its lines are boilerplate of its host.

    Rows bound documents from above, so lines of few rows fall out in one map-side combined count; of the rest
    the distinct ids are counted. Rows with a null id are documents of their own.
    """
    text = text_or_empty(text_col)
    dup_lines = let(F.filter(F.split(F.col("text"), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    in_words = let(
        F.regexp_extract_all(F.col("text"), F.lit(WORD), 0),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words")),
    )
    lines = F.filter(_line_hashes(F.col("text")), lambda x: x["h"].isNotNull())
    scanned = materialize(
        docs.select(F.col(id_col).alias("doc_id"), _host(host_col).alias("host"), text.alias("text")).select(
            "doc_id",
            "host",
            F.xxhash64("doc_id", "host", "text").alias("row_key"),
            in_words.alias("c"),
            F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            dup_lines.cast("long").alias("n_dup_lines"),
            lines.alias("lines"),
        ),
        "line-scan",
    )
    hosts = materialize(scanned.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs")), "line-hosts")
    often = lambda docs: (F.col(docs) > min_docs) & ((F.col(docs) * share > F.col("host_docs")) | (F.col(docs) > MANY_DOCS))
    candidates = (
        scanned.select("host", "doc_id", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
        .groupBy("host", "h")
        .agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("doc_id").isNull()).alias("unnamed"))
        .filter(F.col("rows") > min_docs)
        .join(hosts, "host")
        .filter(often("rows"))
    )
    salts = SALTS + (hosts.agg(F.sum("host_docs")).first()[0] or 0) // SALT_DOCS
    met = materialize(_met(scanned, candidates.select("host", "h", "unnamed", "host_docs"), salts), "line-met")
    frequent = (
        met.groupBy("host", "h")
        .agg((F.count_distinct("doc_id") + F.max("unnamed")).alias("docs"), F.max("host_docs").alias("host_docs"))
        .filter(often("docs"))
    )
    return scanned, met.join(_spread(frequent.select("host", "h"), salts), ["host", "h", "salt"]).select("host", "row_key", "h", "w")


def _spread(lines: DataFrame, salts: int) -> DataFrame:
    return lines.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))


def _met(scanned: DataFrame, candidates: DataFrame, salts: int) -> DataFrame:
    """Every line of ``scanned`` that is a candidate, with its row and id; a hot line meets its rows in many tasks."""
    lines = scanned.select("host", "row_key", "doc_id", F.pmod("row_key", F.lit(salts)).cast("int").alias("salt"), F.explode("lines").alias("line"))
    return lines.select("host", "row_key", "doc_id", "salt", F.col("line.h").alias("h"), F.col("line.w").alias("w")).join(_spread(candidates, salts), ["host", "h", "salt"])


def line_quality(docs: DataFrame, *, max_removed=MAX_REMOVED_PERCENT, **options) -> DataFrame:
    """One row for each row of ``docs`` with its counts, ``removed_words``, ``base_failed`` and ``kept``.

    Null text counts as empty (0 words: fails), null hosts are one host. A line's documents are distinct ids, so
    rows that repeat an id count once; rows with a null id count each. A host's documents are its rows. Rows that
    repeat whole get equal results, an empty table gives no rows. Only named columns are
    read. Very long texts are single rows: their arrays are bounded by their own length. Options: ``id_col``,
    ``text_col``, ``host_col``, ``min_docs``, ``share``.
    """
    scanned, met = _scan(docs, **options)
    removed = met.groupBy("host", "row_key").agg(F.sum("w").cast("long").alias("lost"))
    # Rows that repeat whole share a key, and so a sum: each has its part of it.
    copies = scanned.groupBy("host", "row_key").agg(F.count(F.lit(1)).alias("copies"))
    removed = removed.join(copies, ["host", "row_key"]).select("host", "row_key", F.expr("lost div copies").alias("lost"))
    base_failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return (
        scanned.drop("lines")
        .join(removed, ["host", "row_key"], "left")
        .select("doc_id", F.col("c.n_words").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("c.n_repeat_words").alias("n_repeat_words"), F.coalesce("lost", F.lit(0)).alias("removed_words"))
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("removed_words") * 100 <= F.col("n_words") * max_removed))
    )


def without_boilerplate(docs: DataFrame, *, id_col="doc_id", text_col="text", host_col="source", **options) -> DataFrame:
    """``docs`` with the boilerplate lines of each host cut out of ``text_col``; all other lines, blank ones too, as they were.

    Null stays null. A row brings the hashes of its own boilerplate lines to its text, so nothing larger than a
    document is gathered.
    """
    scanned, met = _scan(docs, id_col=id_col, text_col=text_col, host_col=host_col, **options)
    gone = met.groupBy(F.col("host").alias("_host"), F.col("row_key").alias("_key")).agg(F.collect_set("h").alias("_gone"))
    keyed = docs.withColumn("_host", _host(host_col)).withColumn("_key", F.xxhash64(F.col(id_col), F.col("_host"), text_or_empty(text_col)))
    lines = F.arrays_zip(F.split(F.col(text_col), "\n", -1).alias("line"), F.transform(_line_hashes(F.col(text_col)), lambda x: x["h"]).alias("h"))
    kept = F.filter(lines, lambda x: x["h"].isNull() | ~F.array_contains("_gone", x["h"]))
    cut = F.array_join(F.transform(kept, lambda x: x["line"]), "\n")
    out = keyed.join(gone, ["_host", "_key"], "left").withColumn(text_col, F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(cut))
    return out.select(*docs.columns)


def op6_line_frequency_quality(spark, sf_dir):
    return line_quality(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM d),
win AS (SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS g FROM w),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win WHERE len(g) = 8) WHERE n > 1),
rep AS (SELECT doc_id, sum(step)::BIGINT AS n FROM (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS step FROM twice) GROUP BY 1),
raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
norm AS (SELECT doc_id, source, trim(unnest(string_split(regexp_replace(regexp_replace(lower(text), '[0-9]+', '0', 'g'), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), chr(10)))) AS line FROM d),
hosts AS (SELECT source, count(*) AS n FROM d GROUP BY 1),
freq AS (SELECT n.source, n.line FROM norm n JOIN hosts h ON n.source IS NOT DISTINCT FROM h.source WHERE line <> ''
  GROUP BY n.source, n.line, h.n HAVING count(DISTINCT doc_id) > 20 AND (count(DISTINCT doc_id) * 50 > h.n OR count(DISTINCT doc_id) > 10000)),
lost AS (SELECT n.doc_id, sum(len(n.line) - len(replace(n.line, ' ', '')) + 1)::BIGINT AS n
  FROM norm n JOIN freq f ON n.source IS NOT DISTINCT FROM f.source AND n.line = f.line GROUP BY 1),
r AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS removed_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id)),
b AS (SELECT *, n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed FROM r)
SELECT *, NOT base_failed AND removed_words * 100 <= n_words * 50 AS kept FROM b
"""
