"""Near copies by word shingles: texts whose sets of five-word shingles have similarity 0.8 or more.

Candidates come from the SimHash pigeonhole index first (``llm/simhash.py``, fingerprints of the five-word shingles
at most four bits apart): it ties the close copies. Its bits cannot find all: at similarity 0.8 about 9.7 of 64 bits differ
on average, and a distance that holds nearly all such pairs leaves that index next to nothing to part rows by. The rest
are therefore texts that agree in one of ``BANDS`` bands of ``ROWS`` minimum hashes (99.96% of pairs at similarity 0.8, more
above). Every link, of either index, is verified on the shingles themselves.

Equal sets are one row throughout. In a band's bucket rows are first tied to one centre, then to the most typical row,
which is like all that are not far from the rest; only pairs that are still apart, and whose shingles outside
their own text are enough for the similarity, are compared one by one. Buckets of few rows skip the rounds: all their pairs that
are still apart are compared, at most ``(FEW_ROWS - 1) / 2`` a row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plurality.llm import simhash
from plurality.llm.common import handing_back, materialize, short_batches, text_or_empty
from plurality.llm.components import components

SHINGLE, SEED, BANDS, ROWS = 5, 42, 20, 5
#: Similarity as a fraction: linked at 4/5 or more.
OVER, UNDER = 4, 5
#: Rounds that tie buckets to a centre before the rest is compared; pairs, in rows, that are compared at once; the share of
#: the pairs that a round must settle for another to follow (speed only: what is not tied is compared).
CENTRES, FEW_PAIRS, SETTLED = 6, 4, 0.25
#: Rows of a bucket up to which its pairs cost less than a round and the prefix filter, which writes out every shingle (speed only).
FEW_ROWS = 16
#: The round whose centres are the most typical rows of their buckets; the others' are drawn by hash.
TYPICAL = 1
_LAST = 2**63 - 1  # stands for a null id
_CHUNK, _SLICE = 4096, 128  # shingles mixed and texts held at a time in a task
_MULTIPLIERS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the text's five-word shingles; a shorter text is one shingle, a wordless one has none."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(SHINGLE, len(words))
    n, digest = len(words) - width + 1, xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, n))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One key for each band of minimum hashes."""
    import xxhash

    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _CHUNK):
        mixed = hashes[at : at + _CHUNK, None] * _MULTIPLIERS
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(0))
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set of shingles, as a signed number: the bits that over half of them have."""
    votes = np.zeros(simhash.BITS, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        votes += np.unpackbits(hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def _key(hashes: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def _signed(values) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _texts(batches, column: int):
    """Batches in parts of a few texts, with the shingles of each: only so much is held at a time."""
    import pyarrow as pa

    for whole in batches:
        for at in range(0, whole.num_rows, _SLICE):
            batch = whole.slice(at, _SLICE)
            yield batch, [shingles(t) for t in batch.column(column).cast(pa.binary()).to_pylist()]


def _sketches(batches):
    import pyarrow as pa

    for batch, sets in _texts(batches, 1):
        keys = pa.array(_signed([_key(s) for s in sets]))
        yield pa.record_batch([batch.column(0), batch.column(2), keys, pa.array([len(s) for s in sets], pa.int32()), pa.array([_signed(bands(s)) for s in sets], pa.list_(pa.int64())), pa.array([fingerprint(s) for s in sets])], ["doc", "th", "k", "size", "bands", "fp"])


def _sets(batches):
    import pyarrow as pa

    for _, sets in _texts(batches, 0):
        yield pa.record_batch([pa.array(_signed([_key(s) for s in sets])), pa.array([_signed(s) for s in sets], pa.list_(pa.int64()))], ["k", "hashes"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` with enough shingles in common."""
    left, right = sets.select(F.col("k").alias("a"), F.col("hashes").alias("ha")), sets.select(F.col("k").alias("b"), F.col("hashes").alias("hb"))
    both = F.size(F.array_intersect("ha", "hb")).cast("long")
    return pairs.join(right, "b").join(left, "a").filter(both * UNDER >= (F.size("ha") + F.size("hb") - both) * OVER).select("a", "b")


def _alike(a: str, b: str):
    """Whether two sets of these sizes can be similar enough at all."""
    return F.least(a, b).cast("long") * UNDER >= F.greatest(a, b).cast("long") * OVER


def _pair(x: str, y: str):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _labelled(met: DataFrame, edges: DataFrame) -> DataFrame:
    member = components(edges).select(F.col("node").alias("k"), "component")
    return met.select("bucket", "k", "size").join(member, "k", "left").select("bucket", "k", "size", F.coalesce("component", "k").alias("c"))


def _by_fingerprint(prints: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of sets whose fingerprints are at most ``simhash.DISTANCE`` bits apart: each set with the first of its
    fingerprint, and such firsts along the forest of the pigeonhole index."""
    first = materialize(prints.groupBy("fp").agg(F.min(F.struct("k", "size")).alias("m")), "near-prints")
    pairs = prints.join(first, "fp").filter((F.col("k") != F.col("m.k")) & _alike("size", "m.size")).select(*_pair("k", "m.k"))
    if first.isEmpty():
        return pairs
    x, y = (first.select(F.col("fp").alias(c), F.col("m").alias("m" + c)) for c in "ab")
    tied = simhash.links(first.select(F.col("fp").alias("id"), "fp")).distinct()
    across = tied.join(x, "a").join(y, "b").filter(_alike("ma.size", "mb.size")).select(*_pair("ma.k", "mb.k"))
    return pairs.unionByName(across)


def links(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` between sets that tie together what similar candidates tie together.

    ``rows(doc, th, k, size, bands, fp)`` has one row a document, ``docs(doc, text, th)`` the texts.
    """
    one = rows.groupBy("k").agg(F.min(F.struct("doc", "th")).alias("row"), F.min("size").alias("size"), F.min("bands").alias("bands")).filter("size > 0")
    placed = materialize(one.select("k", "row", "size", F.explode("bands").alias("bucket")), "near-bands")
    several = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    met = materialize(placed.join(several, "bucket"), "near-met")
    prints = rows.filter("size > 0").groupBy("k").agg(F.min(F.struct("doc", "th")).alias("row"), F.min("size").alias("size"), F.min("fp").alias("fp"))
    prints = materialize(prints, "near-one")
    close = materialize(_by_fingerprint(prints), "near-close")
    ends = close.select(F.explode(F.array("a", "b")).alias("k")).distinct()
    named = materialize(met.select("k", "row").unionByName(ends.join(prints, "k").select("k", "row")).distinct(), "near-named")
    wanted = named.select("row.doc", "row.th").distinct()
    sets = docs.join(wanted, ["doc", "th"], "left_semi").select("text").mapInArrow(handing_back(_sets), "k long, hashes array<long>")
    sets = materialize(sets.join(named.select("k").distinct(), "k", "left_semi").groupBy("k").agg(F.min("hashes").alias("hashes")), "near-sets")
    edges, often = materialize(_verified(close, sets), "near-tied"), None
    open_rows = materialize(_labelled(met, edges), "near-labels")
    before, many = float("inf"), False
    for turn in range(CENTRES):
        # Buckets whose rows are still apart; the rounds are for the crowded ones, and the pairs left in them.
        by_label = open_rows.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("n"))
        apart = by_label.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
        total = apart.filter(F.col("n") > FEW_ROWS).agg(F.sum(F.col("n") * F.col("n") - F.col("own")) / 2, F.sum("n")).first()
        many = bool(total[1]) and total[0] > FEW_PAIRS * total[1]
        if not many or (turn != TYPICAL and total[0] > (1 - SETTLED) * before):
            break
        before = total[0]
        open_rows = open_rows.join(apart.select("bucket", "n"), "bucket")
        crowded, open_rows = open_rows.filter(F.col("n") > FEW_ROWS).drop("n"), open_rows.drop("n")
        if turn == TYPICAL:
            often = _often(crowded, sets)
            typical = often.groupBy("k").agg(F.avg("n").alias("typical"))
            centre = crowded.join(typical, "k").groupBy("bucket").agg(F.min_by(F.struct("k", "size", "c"), F.struct(-F.col("typical"), F.col("k"))).alias("m"))
        else:
            centre = crowded.groupBy("bucket").agg(F.min_by(F.struct("k", "size", "c"), F.xxhash64(F.lit(turn), F.col("k"))).alias("m"))
        tied = crowded.join(centre, "bucket").filter((F.col("c") != F.col("m.c")) & _alike("size", "m.size")).select(*_pair("k", "m.k")).distinct()
        found = materialize(_verified(tied, sets), "near-tied")
        edges = materialize(edges.unionByName(found), "near-edges")
        open_rows = materialize(_labelled(open_rows, edges), "near-labels")
    if many and often is not None:
        few, crowded = _by_rows(open_rows)
        pairs = _any_apart(few).unionByName(_apart(crowded, often)).distinct()
    else:
        pairs = _any_apart(open_rows)
    return edges.unionByName(_verified(pairs, sets))


def _by_rows(open_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of buckets of at most ``FEW_ROWS`` rows, and the others that are not of one label alone."""
    of = open_rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), (F.min("c") < F.max("c")).alias("apart")).filter("apart").select("bucket", (F.col("n") > FEW_ROWS).alias("crowded"))
    dealt = open_rows.join(of, "bucket")
    return dealt.filter("NOT crowded").drop("crowded"), dealt.filter("crowded").drop("crowded")


def _often(open_rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(k, s, n): each open set's shingles, and how many open sets hold them."""
    each = sets.join(open_rows.select("k").distinct(), "k", "left_semi").select("k", F.explode("hashes").alias("s"))
    return materialize(each.join(each.groupBy("s").agg(F.count(F.lit(1)).alias("n")), "s").select("k", "s", "n"), "near-often")


def _any_apart(open_rows: DataFrame) -> DataFrame:
    """All pairs that are still apart; a pair of a bucket that is tied elsewhere needs no link."""
    other = open_rows.select("bucket", F.col("k").alias("k2"), F.col("size").alias("size2"), F.col("c").alias("c2"))
    return open_rows.join(other, "bucket").filter((F.col("k") < F.col("k2")) & (F.col("c") != F.col("c2")) & _alike("size", "size2")).select(*_pair("k", "k2")).distinct()


def _apart(open_rows: DataFrame, often: DataFrame) -> DataFrame:
    """The same pairs where buckets are crowded, by an exact prefix filter.

    A similarity of 4/5 takes an overlap of 4/9 of both sizes. A set's overlap with another lies within the ``most``
    shingles that any other set holds, so it may lack ``most - need`` of them: of one more than that, the rarest, a
    partner holds at least one. Of two sets the one of the smaller group looks for the other.
    """
    group = open_rows.select("k", "c").distinct().groupBy("c").agg(F.count(F.lit(1)).alias("members"))
    open_rows = open_rows.join(group.select("c", F.struct("members", "c").alias("g")), "c")
    tops = open_rows.groupBy("bucket").agg(F.max("g").alias("top"), F.min("size").alias("small"))
    seekers = open_rows.join(tops, "bucket").filter("g < top").groupBy("k").agg(F.first("size").alias("size"), F.first("g").alias("g"), F.min("small").alias("small"))
    held = often.filter("n > 1")
    least = F.greatest(F.col("small").cast("long"), F.ceil(F.col("size") * F.lit(OVER) / UNDER))
    need = F.ceil((F.col("size") + least) * F.lit(OVER) / (OVER + UNDER))
    most = held.groupBy("k").agg(F.count(F.lit(1)).alias("most"))
    seekers = seekers.join(most, "k").withColumn("slack", F.col("most") - need).filter("slack >= 0")
    rarest = held.join(seekers, "k").withColumn("at", F.row_number().over(Window.partitionBy("k").orderBy("n", "s"))).filter(F.col("at") <= F.col("slack") + 1)
    partners = held.select("s", F.col("k").alias("k2")).join(open_rows.groupBy(F.col("k").alias("k2")).agg(F.first("size").alias("size2"), F.first("g").alias("g2")), "k2")
    # The partner's own size says how many more of the rarest may be looked at.
    within = F.col("at") <= F.col("most") - F.ceil((F.col("size") + F.col("size2")).cast("long") * F.lit(OVER) / (OVER + UNDER)) + 1
    met = rarest.select("s", "k", "size", "g", "at", "most").join(partners, "s").filter((F.col("g") < F.col("g2")) & _alike("size", "size2") & within)
    return met.select(*_pair("k", "k2")).distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, th, k, c) of each row: id (null: after all others), hash of the text, its set, and what similar sets share."""
    short_batches(docs.sparkSession)
    texts = docs.select(_place(id_col).alias("doc"), text_or_empty(text_col).alias("text"), F.xxhash64(text_or_empty(text_col)).alias("th"))
    rows = materialize(texts.mapInArrow(handing_back(_sketches), "doc long, th long, k long, size int, bands array<long>, fp long"), "near-sketches")
    member = materialize(components(links(rows, texts)), "near-members")
    return rows.select("doc", "th", "k").join(member, F.col("k") == F.col("node"), "left").select("doc", "th", F.coalesce("component", "k").alias("c"))


def _place(id_col: str):
    return F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))


def near_copies(docs: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """``doc_id, component_id`` for each row of ``docs``: the smallest id that similar texts tie it to.

    Null, empty and wordless texts are one group. Rows with a null id link like others and stand after them; a
    group of such rows alone has no component id. Repeated rows share their component. An empty table gives no rows.
    """
    rows = materialize(_grouped(docs, id_col, text_col), "near-groups")
    known = lambda c: F.when(F.col(c) != _LAST, F.col(c))
    return rows.join(rows.groupBy("c").agg(F.min("doc").alias("least")), "c").select(known("doc").alias("doc_id"), known("least").alias("component_id"))


def keep_one(docs: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """One row of each group of ``docs``: that with the smallest id (null last), then the smallest hash of its text.

    Rows are told apart by id and text, so ids that stand on several texts lose none of them, and of rows that
    repeat whole one stays.
    """
    rows = _grouped(docs, id_col, text_col).groupBy("c", "doc", "th").agg(F.count(F.lit(1)).alias("n"))
    kept = materialize(rows.groupBy("c").agg(F.min(F.struct("doc", "th", "n")).alias("m")).select(F.col("m.doc").alias("_doc"), F.col("m.th").alias("_th"), F.col("m.n").alias("_n")), "near-kept")
    out = docs.withColumn("_doc", _place(id_col)).withColumn("_th", F.xxhash64(text_or_empty(text_col))).join(kept, ["_doc", "_th"])
    if not kept.filter("_n > 1").isEmpty():  # only rows that repeat whole are brought together
        out = out.filter("_n = 1").unionByName(out.filter("_n > 1").dropDuplicates(["_doc", "_th"]))
    return out.select(*docs.columns)
