"""Source divergence audit: how far the word use of each source lies from its peers', by systolic rotation.

Smoothed term probabilities of every (language, source) group are whole numbers on a grid of ``GRID``. Groups of a
language are dealt into blocks and its kept terms into shards; a cell (language, shard, block) holds one dense
matrix, so its size is bounded by two parameters whatever the number of sources or terms. Cells stay in their
partitions; packed copies of their peers travel to them in the rounds of a round-robin tournament, in which every
two blocks of a language meet exactly once and a meeting serves both directions. ``LAP`` rounds are one Spark job,
so what is under way at a time is bounded too. Each cell keeps a heap of the terms its groups favour most.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plurality.llm.common import discard, materialize, short_batches, table, text_or_empty

GRID, SMOOTH, LEAST_DOCS, TOP = 1_000_000_000, 5, 30, 50
#: Terms of a shard and groups of a block on average; rounds of a job; distinct terms and bytes a counting task holds.
TERMS, GROUPS, LAP, HELD, SLICE = 1024, 8, 16, 400_000, 1 << 20

#: Bytes of terms, A-Z lower-cased; all others part terms.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_GAP = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")


def _slices(text: bytes):
    """The text in parts of about ``SLICE`` bytes, cut where no term is."""
    at = 0
    while len(text) - at > SLICE and (gap := _GAP.search(text, at + SLICE)):
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:]


def _counts(batches):
    """(lang, source, term, n, docs) summed over some documents; a group also gets a row without a term."""
    import pyarrow as pa

    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush():
        while held:
            (lang, source), (counts, docs) = held.popitem()
            size = len(counts) + 1
            terms, n = pa.array([*counts, None], pa.binary()).cast(pa.string()), np.fromiter(counts.values(), np.int64, size - 1)
            own = np.fromiter(map(docs.__getitem__, counts), np.int64, size - 1)
            yield pa.record_batch([pa.repeat(lang, size), pa.repeat(source, size), terms, pa.array(np.append(n, 0)), pa.array(np.append(own, 0))], ["lang", "source", "term", "n", "docs"])

    size = 0
    for batch in batches:
        langs, sources, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())
        for lang, source, text in zip(langs, sources, texts, strict=True):
            counts, docs = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(counts)
            seen: set[bytes] = set()
            for part in _slices(text.as_py()):
                words = part.translate(_LOWER).split()
                counts.update(words)
                seen.update(words)
            docs.update(seen)
            size += len(counts)
            if size > HELD:
                yield from flush()
                size = 0
    yield from flush()


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(GRID (n + SMOOTH) / (total + SMOOTH terms)) in exact arithmetic: ``div`` of whole decimals."""
    wide = lambda c: c.cast("decimal(38,0)")
    return F.call_function("div", wide(F.lit(GRID)) * wide(n + SMOOTH), wide(total + SMOOTH * terms)) + 1


_CELL = "lang string, s int, b int, blocks int, v long, sources array<string>, p0 array<long>, width int, packed binary, source string, term string, value long"


def _cell(batches, top):
    """The rows of one cell as a packed matrix, and as many of each group's most favoured terms as ``top``."""
    import pyarrow as pa

    rows = pa.Table.from_batches(batches)
    col = {c: rows.column(c).to_pylist() for c in rows.column_names}
    base = {s: p for s, p, i in zip(col["source"], col["p"], col["idx"], strict=True) if i is None}
    sources = sorted(base)
    place = {s: k for k, s in enumerate(sources)}
    width = max((i for i in col["idx"] if i is not None), default=-1) + 1
    matrix = np.zeros((len(sources), width), np.int64)
    heaps: dict[str, list] = {s: [] for s in sources}
    for source, idx, p, q, term in zip(col["source"], col["idx"], col["p"], col["q"], col["term"], strict=True):
        if idx is None:
            continue
        matrix[place[source], idx] = p - base[source]
        if p > q:
            heaps[source].append((q - p, term))
    head = [col[c][0] for c in ("lang", "s", "b", "blocks", "v")]
    out = [(*head, sources, [base[s] for s in sources], width, zlib.compress(matrix.astype("<i4").tobytes(), 1), None, None, None)]
    out += [(*head, None, None, None, None, s, term, -f) for s in sources for f, term in heapq.nsmallest(top, heaps[s])]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.string(), pa.string(), pa.int64()]
    names = ["lang", "s", "b", "blocks", "v", "sources", "p0", "width", "packed", "source", "term", "value"]
    return pa.table([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _open(packed: bytes, p0: np.ndarray, width: int, wider: int) -> np.ndarray:
    out = np.zeros((len(p0), wider), np.int64)
    out[:, :width] = np.frombuffer(zlib.decompress(packed), "<i4").reshape(len(p0), width)
    return out + p0[:, None]


def _meetings(batches):
    """(lang, a, b, value): a meeting's part of the difference of every two groups, those of one block among themselves too."""
    import pyarrow as pa

    for batch in batches:
        for row in batch.to_pylist():
            home, away = row["home"], row["away"]
            wide = max(home["width"], away["width"])
            p, q = np.array(home["p0"], np.int64), np.array(away["p0"], np.int64)
            ours, theirs = _open(home["packed"], p, home["width"], wide), _open(away["packed"], q, away["width"], wide)
            own = home["sources"] == away["sources"]
            found: list[tuple] = []
            for i, name in enumerate(home["sources"]):
                apart = np.abs(p[i] - q)
                # Terms beyond the matrices have both base values; shard 0 stands in for all terms of the language.
                values = np.abs(ours[i] - theirs).sum(1) - wide * apart + (row["v"] * apart if row["s"] == 0 else 0)
                found += [(row["lang"], min(name, other), max(name, other), int(v)) for other, v in zip(away["sources"], values, strict=True) if not own or name < other]
            if found:
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*found, strict=True), (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "a", "b", "value"])


def _rounds(cells: DataFrame, rounds: range) -> DataFrame:
    """Each cell as the visitor it is in ``rounds``: with ``home``, the block it travels to.

    The circle method with n = blocks - 1 turning places and a fixed last one: in round r places x and y meet where
    x + y = r (mod n), and the place that would meet itself meets the last. Homes alternate.
    """
    n, r, b = F.col("blocks") - 1, F.col("r"), F.col("b")
    across = F.pmod(r - b, n)
    peer = F.when(b == n, F.pmod(r * (F.col("blocks") / 2).cast("int"), n)).when(across == b, n).otherwise(across)
    turns = cells.filter("blocks > 1").withColumn("r", F.explode(F.sequence(F.lit(rounds.start), F.lit(rounds.stop - 1)))).filter(r < n)
    home = F.when((peer + b) % 2 == 1, F.least(peer, b)).otherwise(F.greatest(peer, b))
    return turns.withColumn("home_block", home.cast("int")).filter(F.col("home_block") != b)


def term_counts(docs: DataFrame, *, text_col="text", lang_col="lang", source_col="source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group and the documents that hold it; null
    text, lang and source read ''. Every group also has a row with a null term."""
    short_batches(docs.sparkSession)
    rows = docs.select(text_or_empty(lang_col).alias("lang"), text_or_empty(source_col).alias("source"), text_or_empty(text_col).alias("text"))
    parts = rows.mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def divergence(docs: DataFrame, *, text_col="text", lang_col="lang", source_col="source", least_docs=LEAST_DOCS, top=TOP, terms=TERMS, groups=GROUPS, lap=LAP) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every (lang, source) group of ``docs``.

    ``pair`` rows hold every other source of the language with the sum of absolute differences over all kept terms;
    ``term`` rows the ``top`` kept terms that the group has more of than its language. Null text, lang and source
    count as ''. Groups without a term are compared like others; a language without a kept term gives 0 for each
    pair. Repeated rows count as often as they stand. Empty table: no rows. Only named columns are read.
    """
    counts = materialize(term_counts(docs, text_col=text_col, lang_col=lang_col, source_col=source_col), "div-counts")
    seen = counts.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    seen = materialize(seen.select("lang", "term", "total"), "div-kept")
    sized = seen.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("all"))
    shards = F.greatest(F.lit(1), F.ceil(F.col("v") / terms)).cast("int")
    langs = counts.filter("term IS NULL").groupBy("lang").agg(F.count(F.lit(1)).alias("g")).join(sized, "lang", "left").fillna(0, ["v", "all"])
    langs = langs.withColumn("shards", shards).withColumn("blocks", F.when(F.col("g") <= groups, 1).otherwise(2 * F.ceil(F.col("g") / (2 * groups))).cast("int"))
    langs = materialize(langs, "div-langs")
    shard = Window.partitionBy("lang", "s").orderBy("term")
    kept = seen.join(langs, "lang").withColumn("s", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int"))
    kept = kept.select("lang", "term", "s", (F.row_number().over(shard) - 1).alias("idx"), _share(F.col("total"), F.col("all"), F.col("v")).alias("q"))
    rows = materialize(counts.filter("term IS NOT NULL").select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "div-rows")
    totals = rows.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    group = counts.filter("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").fillna(0, ["own"]).join(langs, "lang")
    p0 = F.when(F.col("v") > 0, _share(F.lit(0), F.col("own"), F.col("v"))).otherwise(0)
    group = materialize(group.select("lang", "source", "own", "v", "shards", "blocks", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("b"), p0.alias("p0")), "div-groups")

    head = ["lang", "s", "b", "blocks", "v", "source"]
    filled = rows.join(group, ["lang", "source"]).select(*head, "idx", _share(F.col("n"), F.col("own"), F.col("v")).alias("p"), "q", "term")
    base = group.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select(*head, F.lit(None).cast("int").alias("idx"), F.col("p0").alias("p"), F.lit(None).cast("long").alias("q"), F.lit(None).cast("string").alias("term"))

    def cell(part):
        return _cell(part.to_batches(), top)

    made = materialize(filled.unionByName(base).groupBy("lang", "s", "b").applyInArrow(cell, _CELL), "div-cells")
    cells = made.filter("packed IS NOT NULL").select("lang", "s", "b", "blocks", "v", F.struct("sources", "p0", "width", "packed").alias("cell"))
    # The residents: dealt out once, so that only visitors move.
    size = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    residents = cells.repartition(size, "lang", "s", "b").persist(StorageLevel.MEMORY_AND_DISK)
    pair = "lang string, a string, b string, value long"
    parts = [materialize(residents.select("lang", "s", "v", F.col("cell").alias("home"), F.col("cell").alias("away")).mapInArrow(_meetings, pair).groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "div-pairs")]
    most = langs.agg(F.max("blocks")).first()[0] or 1
    for start in range(0, most - 1, lap):
        visitors = _rounds(cells, range(start, min(start + lap, most - 1))).select("lang", "s", F.col("home_block").alias("b"), F.col("cell").alias("away"))
        met = residents.withColumnRenamed("cell", "home").join(visitors, ["lang", "s", "b"]).select("lang", "s", "v", "home", "away")
        parts.append(materialize(met.mapInArrow(_meetings, pair).groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "div-pairs"))
    residents.unpersist()
    discard(counts, seen, rows, group, langs)
    pairs = parts[0]
    for more in parts[1:]:
        pairs = pairs.unionByName(more)
    both = lambda x, y: F.struct(F.col(x).alias("source"), F.lit("pair").alias("part"), F.col(y).alias("item"), F.col("value"))
    found = pairs.select("lang", F.inline(F.array(both("a", "b"), both("b", "a"))))
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    favoured = made.filter("packed IS NULL").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    ranked = favoured.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top)
    return found.withColumn("rank", F.row_number().over(place)).unionByName(ranked)


def op12_systolic_divergence(spark, sf_dir):
    return divergence(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
words AS (SELECT row_id, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT row_id) >= 30),
groups AS (SELECT DISTINCT lang, source FROM docs),
counted AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept USING (lang, term) GROUP BY ALL),
filled AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN counted c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, (1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)))::BIGINT AS p FROM filled),
q AS (SELECT lang, term, (1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)))::BIGINT AS q
  FROM (SELECT lang, term, sum(n) AS n FROM filled GROUP BY ALL)),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
own AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, p.p - q.q AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM own))
WHERE part = 'pair' OR rank <= 50
"""
