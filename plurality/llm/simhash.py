"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are 64 sign bits over the XXH64 hashes of a text's four-word shingles. Two fingerprints at
most ``DISTANCE`` bits apart must, for any split of the bits into partitions with thresholds t_i whose
(t_i + 1) sum to DISTANCE + 1, lie within t_i bits of each other in some partition i. Correlated bits are
put into the same partition and the thresholds are dealt by dynamic programming on the candidates each
would cause; rows then probe every value within t_i of theirs, and candidates are verified on all bits.

Equal fingerprints are one row throughout. What lies in one bucket is tied together by a forest of verified
links, not by all its pairs; buckets above ``BLOCK`` rows are cut into blocks whose pairs are compared in
tasks of their own.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurality.llm.common import materialize, table, text_or_empty
from plurality.llm.components import components

SHINGLE, SEED, BITS, DISTANCE = 4, 42, 64, 4
#: Numbers of partitions tried, rows of a block, fingerprints whose distances plan the index (speed only).
PARTITIONS, BLOCK, PLAN_ROWS = (2, 3, 4, 5), 1024, 2048
FEW = 64
_CHUNK = 1 << 18


def fingerprint(text: bytes) -> int:
    """The SimHash of a whole text; zero without words."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(SHINGLE, len(words))
    n = len(words) - width + 1
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(BITS, np.int64)
    first, last = starts[:n].tolist(), ends[width - 1 :].tolist()
    for at in range(0, n, _CHUNK):
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(first[at : at + _CHUNK], last[at : at + _CHUNK], strict=True)), np.uint64, min(_CHUNK, n - at))
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << i for i in range(BITS) if votes[i] * 2 > n))


def _fingerprints(batches):
    import pyarrow as pa

    for batch in batches:
        fps = np.array([fingerprint(t) for t in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64)
        yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """``(doc_id, fp)``; fp holds the 64 bits as a signed long."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long")


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.astype(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _co_set(batches):
    """Counts of rows with both of two bits set, as 64 rows of 64; the diagonal has the single bits."""
    total, n = np.zeros((BITS, BITS), np.int64), 0
    for batch in batches:
        b = _bits(batch["fp"].to_numpy()).astype(np.float32)
        total += (b.T @ b).astype(np.int64)
        n += len(b)
    yield pd.DataFrame({"i": np.repeat(np.arange(BITS), BITS), "j": np.tile(np.arange(BITS), BITS), "both": total.ravel(), "n": n})


def correlations(fps: DataFrame) -> np.ndarray:
    """Absolute correlations of the bits over all fingerprints: 4096 sums reach the driver."""
    sums = fps.select("fp").mapInPandas(_co_set, "i int, j int, both long, n long").groupBy("i", "j").agg(F.sum("both").alias("both"), F.sum("n").alias("n")).toPandas()
    both, n = np.zeros((BITS, BITS)), max(1, int(sums["n"].max()) if len(sums) else 1)
    both[sums["i"], sums["j"]] = sums["both"]
    p = both.diagonal() / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return np.abs((both / n - np.outer(p, p)) / np.outer(spread, spread))


def group_bits(corr: np.ndarray, m: int) -> list[list[int]]:
    """``m`` partitions of near equal width, each grown by the bit most correlated with it."""
    left, out = set(range(BITS)), []
    for i in range(m):
        width = len(left) // (m - i)
        off = corr - np.eye(BITS)
        members = [max(sorted(left), key=lambda b: off[b, sorted(left)].max())]
        left.discard(members[0])
        while len(members) < width:
            best = max(sorted(left), key=lambda b: corr[b, members].sum())
            members.append(best)
            left.discard(best)
        out.append(sorted(members))
    return out


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def allocate(costs: list[list[float]], units: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = units and the least sum of costs[i][t_i + 1]."""
    best = {0: (0.0, [])}
    for row in costs:
        step: dict = {}
        for used, (cost, chosen) in best.items():
            for take in range(min(len(row) - 1, units - used) + 1):
                new = (cost + row[take], [*chosen, take - 1])
                if used + take not in step or new < step[used + take]:
                    step[used + take] = new
        best = step
    return best[units]


def plan(fps: DataFrame, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(mask, threshold) of each partition that is probed.

    The bits are grouped by correlations over all fingerprints. Candidate counts are estimated from the
    distances, partition by partition, between at most ``PLAN_ROWS`` fingerprints, smallest hashes first;
    they choose how fast the search is, never what it finds.
    """
    corr, n = correlations(fps), fps.count()
    sample = fps.select("fp").distinct().orderBy(F.xxhash64("fp"), "fp").limit(PLAN_ROWS).toPandas()["fp"].to_numpy().astype(np.int64).view(np.uint64)
    pairs = max(1, len(sample) * (len(sample) - 1) // 2)
    upper = np.triu_indices(len(sample), 1)
    apart = (sample[:, None] ^ sample[None, :])[upper]
    best = None
    for m in PARTITIONS:
        groups = group_bits(corr, m)
        costs = []
        for g in groups:
            # Rows probe to half of t, so those up to twice that apart meet.
            reach = [(t + 1) // 2 for t in range(distance + 1)]
            seen = np.bincount(np.bitwise_count(apart & np.uint64(_mask(g))), minlength=2 * BITS).cumsum() / pairs
            ball = np.cumsum([comb(len(g), r) for r in range(2 * BITS)])
            meet = np.array([max(seen[2 * r], ball[2 * r] / 2.0 ** len(g)) for r in reach])
            # A probed row costs about as much as forty comparisons.
            costs.append([0.0, *(40.0 * n * ball[reach] + 0.5 * n * n * meet)])
        cost, thresholds = allocate(costs, distance + 1)
        if best is None or cost < best[0]:
            best = (cost, [(_mask(g), t) for g, t in zip(groups, thresholds, strict=True) if t >= 0])
    return best[1]


def probes(fps: DataFrame, parts: list[tuple[int, int]]) -> DataFrame:
    """``(part, value, id, fp)``: each row at every value within half of t (rounded up) of its own.

    Two rows within t bits of each other both reach the values half way between them.
    """

    def spread(batches):
        for batch in batches:
            fp, ids = batch["fp"].to_numpy().astype(np.int64), batch["id"].to_numpy()
            for part, (mask, t) in enumerate(parts):
                bits = [b for b in range(BITS) if mask >> b & 1]
                home = fp & np.uint64(mask).astype(np.int64)
                for r in range((t + 1) // 2 + 1):
                    for flips in combinations(bits, r):
                        value = home ^ np.uint64(_mask(list(flips))).astype(np.int64)
                        yield pd.DataFrame({"part": part, "value": value, "id": ids, "fp": fp})

    return fps.select("id", "fp").mapInPandas(spread, "part int, value long, id long, fp long")


class Forest:
    """Union of places 0..n-1, smaller place on top."""

    def __init__(self, n):
        self.up = list(range(n))

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _tied(left, right, distance, same):
    """Forest edges (places in left+right) of the pairs across two blocks, or within one, within ``distance``."""
    n = len(left)
    forest, out = Forest(n if same else n + len(right)), []
    for i in range(n):
        against = left[i + 1 :] if same else right
        near = np.flatnonzero(np.bitwise_count(against ^ left[i]) <= distance)
        for j in near + (i + 1 if same else n):
            if forest.join(i, int(j)):
                out.append((i, int(j)))
    return out


def _edges_of(distance):
    def edges(frame: pd.DataFrame) -> pd.DataFrame:
        one = frame.sort_values(["side", "id"])
        fp, ids, side = one["fp"].to_numpy().astype(np.int64).view(np.uint64), one["id"].to_numpy(), one["side"].to_numpy()
        left, right = fp[side == 0], fp[side == 1]
        found = _tied(left, right, distance, same=len(right) == 0)
        return pd.DataFrame({"a": [ids[i] for i, _ in found], "b": [ids[j] for _, j in found]}, dtype="int64")

    return edges


def _small_buckets(distance):
    """Edges of whole buckets, from rows sorted by bucket; a bucket may run on into the next batch."""

    def edges(batches):
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            key = batch[["part", "value"]].to_numpy()
            last = int(np.flatnonzero((key[1:] != key[:-1]).any(1))[-1]) + 1 if len(key) > 1 and (key[1:] != key[:-1]).any() else 0
            rest = batch.iloc[last:]
            if last:
                yield _bucket_edges(batch.iloc[:last], distance)
        if rest is not None and len(rest):
            yield _bucket_edges(rest, distance)

    return edges


def _bucket_edges(rows: pd.DataFrame, distance: int) -> pd.DataFrame:
    key = rows[["part", "value"]].to_numpy()
    fp, ids = rows["fp"].to_numpy().astype(np.int64).view(np.uint64), rows["id"].to_numpy()
    starts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1])
    sizes = np.diff(np.append(starts, len(rows)))
    a, b = [], []
    # Nearly all buckets are small: every row meets the k-th after it, all of these buckets at once.
    few = int(min(FEW, sizes.max()))
    of = np.repeat(np.arange(len(starts)), sizes)
    forest = Forest(len(rows))
    for k in range(1, few):
        hit = (of[k:] == of[:-k]) & (sizes[of[:-k]] <= few) & (np.bitwise_count(fp[k:] ^ fp[:-k]) <= distance)
        for i in np.flatnonzero(hit).tolist():
            if forest.join(i, i + k):
                a.append(i), b.append(i + k)
    for at in np.flatnonzero(sizes > few).tolist():
        s = int(starts[at])
        for i, j in _tied(fp[s : s + sizes[at]], fp[:0], distance, same=True):
            a.append(s + i), b.append(s + j)
    return pd.DataFrame({"a": ids[a], "b": ids[b]}).query("a != b")


def links(unique: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges ``(a, b)`` that tie together what links of at most ``distance`` bits tie together; ``unique(id, fp)``."""
    parts = plan(unique, distance)
    placed = materialize(probes(unique, parts), "simhash-probes")
    sizes = placed.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    large = materialize(sizes.filter(F.col("n") > BLOCK), "simhash-large")
    found = (
        placed.join(sizes.filter(F.col("n") <= BLOCK).select("part", "value"), ["part", "value"])
        .select("part", "value", "id", "fp")
        .repartition("part", "value")
        .sortWithinPartitions("part", "value")
        .mapInPandas(_small_buckets(distance), "a long, b long")
    )
    hot = placed.join(large, ["part", "value"]).withColumn("blocks", F.ceil(F.col("n") / F.lit(BLOCK // 2)).cast("int"))
    hot = hot.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("x"), F.greatest("block", o).alias("y"), (F.col("block") > o).cast("int").alias("side")))
    paired = hot.select("part", "value", "id", "fp", F.explode(others).alias("p")).select("part", "value", "id", "fp", "p.x", "p.y", "p.side")
    crossed = paired.groupBy("part", "value", "x", "y").applyInPandas(_edges_of(distance), "a long, b long")
    return found.unionByName(crossed)


def near_duplicates(docs: DataFrame, *, id_col="doc_id", text_col="text", distance: int = DISTANCE) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, fingerprint, component_id``.

    Null, empty and wordless texts have fingerprint zero and link like any other. Repeated rows share their
    component. Rows with a null id link like any other, and others through them; their component is the
    smallest id they reach, null if they reach none. An empty table gives no rows. Only the two named columns
    are read.
    """
    rows = materialize(fingerprints(docs, id_col, text_col), "simhash-fp")
    unique = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-unique")
    if unique.isEmpty():
        return rows.select("doc_id", _hex("fp").alias("fingerprint"), F.col("doc_id").alias("component_id"))
    # Fingerprints are the nodes, so rows without an id count too; ids only name the components.
    member = materialize(components(links(unique.select(F.col("fp").alias("id"), "fp"), distance)), "simhash-member")
    linked = unique.join(member.withColumnRenamed("node", "fp"), "fp")
    named = linked.groupBy("component").agg(F.min("first").alias("top"))
    # Few fingerprints stand for many rows each: the join is by fingerprint, hot ones split by Spark.
    labelled = unique.join(linked.join(named, "component").select("fp", "top"), "fp", "left").select("fp", F.coalesce("top", "first").alias("component_id"))
    labelled = materialize(labelled, "simhash-labels")
    return rows.join(labelled, "fp", "left").select("doc_id", _hex("fp").alias("fingerprint"), "component_id")


def _hex(name):
    return F.lower(F.lpad(F.hex(F.col(name)), 16, "0"))


def op8_simhash_pigeonhole(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
