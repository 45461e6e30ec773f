"""Embedding near-duplicates by E8 lattice hashing.

Unit vectors are projected at random to blocks of eight numbers, each block is decoded to the nearest point
of the E8 lattice, and a table's cell is the points of its blocks. Several tables are searched; besides its
own cell, a vector probes those of the neighbouring lattice points nearest to it. What shares a cell is
compared by cosine in double precision.

Equal vectors are one row with a count. No pair leaves a task: a cell yields, for each vector, how many
vectors it links with, and a forest that ties the linked ones. A pair that meets in several tables or cells
is counted in the first alone, which both vectors' keys tell. Cells above ``BLOCK`` homes or ``PROBES`` probing
rows are cut into blocks whose pairs are compared apart, so no group holds more than some thousands of vectors.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurality.llm.common import materialize, table
from plurality.llm.components import components

COSINE = 0.9
#: The plan: rows wanted in a cell, chance wanted of finding a pair just at the least cosine, seed, and
#: simulated pairs it is planned with (synthetic: no rows of the data).
CELL_ROWS, RECALL, SEED, TRIALS = 64, 0.98, 11, 1200
#: Homes of a cell, and probing rows of a cell, from which it is cut into blocks.
BLOCK, PROBES = 512, 2048
#: Gains of moves that a task holds at a time, whatever the plan's tables and blocks; units of fixed-point numbers:
#: of vectors, of projections, and of what a decoded block is off. Sums of them are exact, so no order of adding matters.
_HELD, _UNIT, _TURN, _OFF = 1 << 20, 2.0**23, 2.0**22, 2.0**18


def _decode_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of even sum: round, and if odd turn the worst one the other way."""
    near = np.rint(x)
    off = x - near
    rows, worst = np.arange(len(x)), np.abs(off).argmax(1)
    turn = np.where(off[rows, worst] >= 0, 1.0, -1.0)
    near[rows, worst] += np.where(near.sum(1) % 2 != 0, turn, 0.0)
    return near


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points: the better of D8 and D8 moved by one half."""
    whole, half = _decode_d8(x), _decode_d8(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1))[:, None], whole, half)


@lru_cache(maxsize=1)
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    pairs = [[s if k == i else t if k == j else 0.0 for k in range(8)] for i, j in combinations(range(8), 2) for s in (1.0, -1.0) for t in (1.0, -1.0)]
    return np.array(pairs + [v for v in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0])


class Index:
    """Projections of some tables for vectors of ``dim`` numbers; ``keys`` gives own and probed cells."""

    def __init__(self, dim: int, tables: int, blocks: int, spread: float, probes: int):
        self.shape = (dim, tables, blocks, spread, probes)
        rng = np.random.default_rng([SEED, dim, blocks])
        width, parts = 8 * blocks, []
        for _ in range(tables):
            g = rng.normal(size=(dim, width))
            parts.append(np.linalg.qr(g)[0] * np.sqrt(dim / 8) if dim >= width else g / np.sqrt(8))
        self.q = np.rint(np.hstack(parts) * spread * _TURN)
        self.shift = rng.uniform(size=tables * width)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """(rows, tables, 1 + probes) cell keys, the own one first.

        Some rows at a time, so that memory does not grow with the plan. Sums are exact, so a vector has the same
        keys in whatever batch it stands.
        """
        _, tables, blocks, _, probes = self.shape
        out, some = np.empty((len(unit), tables, 1 + probes), np.uint64), max(1, _HELD // (tables * blocks * 240))
        for at in range(0, len(unit), some):
            out[at : at + some] = self._keys(unit[at : at + some])
        return out

    def _keys(self, unit: np.ndarray) -> np.ndarray:
        _, tables, blocks, _, probes = self.shape
        y = (np.rint(unit * _UNIT) @ self.q / (_UNIT * _TURN) + self.shift).reshape(-1, 8)
        at = decode_e8(y)
        points = np.rint(2 * at).astype(np.int64).reshape(len(unit), tables, blocks, 8)
        out = np.empty((len(unit), tables, 1 + probes), np.uint64)
        out[:, :, 0] = self._hash(points)
        # Moving a block to a neighbouring point brings it nearer by the gain below; the best moves are probed.
        gain = (np.rint((y - at) * _OFF).astype(np.float32) @ neighbours().T.astype(np.float32)).reshape(len(unit), tables, blocks * 240)
        moves = np.rint(2 * neighbours()).astype(np.int64)
        for p in range(probes):
            best = gain.argmax(2)
            np.put_along_axis(gain, best[:, :, None], -np.inf, 2)
            moved = points.copy()
            for b in range(blocks):
                moved[:, :, b] += np.where((best // 240 == b)[:, :, None], moves[best % 240], 0)
            out[:, :, 1 + p] = self._hash(moved)
        return out

    def _hash(self, points: np.ndarray) -> np.ndarray:
        h = np.broadcast_to(np.arange(1, points.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), points.shape[:2]).copy()
        for x in np.moveaxis(points.reshape(*points.shape[:2], -1), 2, 0):
            h = (h ^ x.astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
        return h


def plan(dim: int, n: int, cosine: float = COSINE) -> tuple[int, int, int, float, int]:
    """The shape of the index for ``n`` vectors: fewest rows written for the recall, at the wanted cell size.

    One table's chance of bringing a pair at the least cosine together, and of two unrelated vectors
    meeting, are measured on synthetic vectors; more blocks and a wider spread make smaller cells.
    """
    rng = np.random.default_rng([SEED, dim])
    x = unit_rows(rng.normal(size=(TRIALS, dim)))
    z = rng.normal(size=(TRIALS, dim))
    z = unit_rows(z - (z * x).sum(1)[:, None] * x)
    pair = unit_rows(cosine * x + np.sqrt(1 - cosine**2) * z)
    best = None
    for blocks in (1, 2, 3, 4):
        for spread in (0.7, 0.9, 1.1, 1.3, 1.5, 1.7, 2.0):
            one = Index(dim, 1, blocks, spread, 3)
            a, b = one.keys(x)[:, 0], one.keys(pair)[:, 0]
            counts = np.unique(a[:, 0], return_counts=True)[1]
            crowd = max((counts * (counts - 1.0)).sum() / (TRIALS * (TRIALS - 1.0)), 1.0 / TRIALS**2) * n
            for probes in (1, 2, 3):
                met = (a[:, 0] == b[:, 0]) | (a[:, :1] == b[:, 1 : 1 + probes]).any(1) | (b[:, :1] == a[:, 1 : 1 + probes]).any(1)
                tables = int(np.ceil(np.log(1 - RECALL) / np.log(1 - min(max(met.mean(), 1e-3), 0.999))))
                rows = tables * (1 + probes)
                cost = rows * (1 + max(0.0, crowd / CELL_ROWS - 1))
                if best is None or cost < best[0]:
                    best = (cost, (dim, tables, blocks, spread, probes))
    return best[1]


def unit_rows(v: np.ndarray) -> np.ndarray:
    """Rows over their lengths, in double precision; sums in one fixed order, scaled against overflow."""
    v = np.asarray(v, np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    squares = np.zeros(len(v))
    for d in range(v.shape[1]):
        squares += v[:, d] ** 2
    return v / np.sqrt(squares)[:, None]


def _spread(shape):
    """Rows for the cells of each vector: ``key, tab, home, id, n, v`` (v: the unit vector's source bytes)."""

    def run(batches):
        import pyarrow as pa

        index = Index(*shape)
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            v = np.ascontiguousarray(flat.reshape(batch.num_rows, -1))
            keys, width = index.keys(unit_rows(v)), v.itemsize * v.shape[1]
            offsets = pa.py_buffer((np.arange(len(v) + 1) * width).astype(np.int32).tobytes())
            raw = pa.Array.from_buffers(pa.binary(), len(v), [None, offsets, pa.py_buffer(v.tobytes())])
            for t in range(keys.shape[1]):
                for p in range(keys.shape[2]):
                    cols = [pa.array(keys[:, t, p].view(np.int64)), pa.array(np.full(len(v), t, np.int32)), pa.array(np.full(len(v), p == 0)), batch.column(0), batch.column(1), raw]
                    yield pa.record_batch(cols, ["key", "tab", "home", "id", "n", "v"])

    return run


def _compare(shape, cosine, single):
    """Counts and forest edges of every (key, x, y) group, from rows sorted by group: ``a, b, n``."""
    dtype = np.float32 if single else np.float64

    def run(batches):
        import pyarrow as pa

        index, rest = Index(*shape), None
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

        def groups(rows):
            col = lambda name: rows.column(name).to_numpy(zero_copy_only=False)
            key, x, y, tab, home, side, ids, n = (col(c) for c in ("key", "x", "y", "tab", "home", "side", "id", "n"))
            v = np.frombuffer(b"".join(rows.column("v").to_pylist()), dtype).reshape(rows.num_rows, -1)
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
            ends = np.append(starts[1:], rows.num_rows)
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
            unit = unit_rows(v)
            for s, e in zip(starts, ends, strict=True):
                if e - s > 1:
                    own = home[s:e].astype(bool)
                    left = np.flatnonzero(own & (side[s:e] == 0)) + s
                    right = np.flatnonzero(own & (side[s:e] == 1)) + s
                    visitors = np.flatnonzero(~own) + s
                    others = right if len(right) else np.concatenate([left, visitors]) if x[s] == y[s] else visitors
                    if not len(left) or not len(others):
                        continue
                    i, j = np.nonzero(unit[left] @ unit[others].T >= cosine)
                    i, j = left[i], others[j]
                    # A pair of homes of one block stands twice; a row does not link with itself.
                    fine = (i < j) if not len(right) else np.ones(len(i), bool)
                    fine = (fine | ~own[j - s]) & (ids[i] != ids[j])
                    i, j = i[fine], j[fine]
                    if len(i):
                        out.append(self_counted(i, j, key[s], tab[s], ids, n, unit))
            a, b, c = (np.concatenate(z) for z in zip(*out, strict=True))
            return pa.record_batch([pa.array(a), pa.array(b, mask=b < -(2**62)), pa.array(c)], schema=schema)

        def self_counted(i, j, key, tab, ids, n, unit):
            who, at = np.unique(np.concatenate([i, j]), return_inverse=True)
            keys = index.keys(unit[who])
            p, q = at[: len(i)], at[len(i) :]
            first = np.ones(len(i), bool)
            for t in range(tab + 1):
                hp, hq = keys[p, t, :1], keys[q, t, :1]
                same, up, down = (hp == hq)[:, 0], (hp == keys[q, t, 1:]).any(1), (hq == keys[p, t, 1:]).any(1)
                if t < tab:
                    first &= ~(same | up | down)
                else:
                    mine = np.uint64(np.int64(key).view(np.uint64))
                    at_key = np.where(same, hp[:, 0], np.where(up & down, np.minimum(hp[:, 0], hq[:, 0]), np.where(up, hp[:, 0], hq[:, 0])))
                    first &= at_key == mine
            p, q = p[first], q[first]
            links = np.bincount(p, n[who[q]], minlength=len(who)) + np.bincount(q, n[who[p]], minlength=len(who))
            some = np.flatnonzero(links)
            top = _tops(p, q, ids[who])
            tied = some[top[some] != ids[who[some]]]
            none = np.full(len(some), -(2**63), np.int64)
            return np.concatenate([ids[who[some]], ids[who[tied]]]), np.concatenate([none, top[tied]]), np.concatenate([links[some].astype(np.int64), np.zeros(len(tied), np.int64)])

        for batch in batches:
            rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            rows = rows.combine_chunks()
            key, x, y = (rows.column(c).to_numpy() for c in ("key", "x", "y"))
            new = np.flatnonzero((key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
            cut = int(new[-1]) + 1 if len(new) else 0
            rest = rows.slice(cut)
            if cut:
                yield groups(rows.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield groups(rest)

    return run


def _tops(p: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id tied to each row by the pairs (p, q)."""
    top = ids.copy()
    while True:
        before = top.copy()
        low = np.minimum(top[p], top[q])
        np.minimum.at(top, p, low)
        np.minimum.at(top, q, low)
        if (top == before).all():
            return top


def near_duplicates(vectors: DataFrame, *, id_col="vec_id", vector_col="embedding", cosine: float = COSINE) -> DataFrame:
    """One row for each row of ``vectors``: ``vec_id, n_links, component_id, kept``.

    Vectors that are null, empty, zero, or hold null or non-finite numbers link with nothing. Vectors of
    different lengths never link. Repeated rows link with each other, and rows that share an id each have the
    links of their own vector. Rows with a null id link and count like any other, are not kept, and have the
    smallest id they reach, or null. An empty table gives no rows. Only the two named columns are read.
    """
    single = "float" in vectors.schema[vector_col].dataType.simpleString()
    kind = "float" if single else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    valid = F.coalesce(F.forall("v", finite) & F.exists("v", lambda x: x != 0), F.lit(False))
    # A class is a vector: its written number is the node, ids only name the components.
    classes = rows.filter(valid).groupBy("v").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()), "e8-classes")
    found = None
    for dim, n in classes.groupBy(F.size("v")).count().orderBy(F.desc("count")).collect():
        own = _links(classes.filter(F.size("v") == dim), plan(dim, n, cosine), cosine, single)
        found = own if found is None else found.unionByName(own)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = materialize(found, "e8-links")
    links = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("links"))
    member = materialize(components(found.filter("b is not null").select("a", "b")), "e8-member")
    linked = classes.select("id", "first").join(member.withColumnRenamed("node", "id"), "id")
    top = linked.join(linked.groupBy("component").agg(F.min("first").alias("top")), "component").select("id", "top")
    labels = classes.join(links, classes["id"] == links["a"], "left").join(top, "id", "left")
    labels = materialize(labels.select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("top", "first").alias("component_id")), "e8-labels")
    # One vector may stand in a third of all rows: its label meets them in the join, which Spark may split.
    tagged = rows.withColumn("w", F.when(valid, F.col("v"))).join(labels.withColumnRenamed("v", "w"), "w", "left")
    out = tagged.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _links(classes: DataFrame, shape, cosine: float, single: bool) -> DataFrame:
    placed = classes.select("id", "n", "v").mapInArrow(_spread(shape), "key long, tab int, home boolean, id long, n long, v binary")
    homes, probes = F.count_if("home"), F.count_if(~F.col("home"))
    large = placed.groupBy("key").agg(homes.alias("homes"), probes.alias("probes")).filter((F.col("homes") > BLOCK) | (F.col("probes") > PROBES))
    deal = lambda c, size: F.ceil(F.col(c) / F.lit(size)).cast("int").alias(c)
    large = materialize(large.select("key", deal("homes", BLOCK // 2), deal("probes", PROBES)), "e8-large")
    # In a large cell homes and probing rows have blocks of their own; where nobody is at home, nobody is sent.
    cut = placed.join(large, "key", "left").withColumn("homes", F.coalesce("homes", F.lit(1))).withColumn("probes", F.coalesce("probes", F.lit(1))).filter("homes > 0")
    cut = cut.withColumn("block", F.pmod(F.xxhash64("id"), F.when(F.col("home"), F.col("homes")).otherwise(F.greatest("probes", F.lit(1)))).cast("int"))
    upto = lambda c: F.sequence(F.lit(0), F.greatest(F.col(c), F.lit(1)) - 1)
    group = lambda x, y, side: F.struct(x.alias("x"), y.alias("y"), side.alias("side"))
    block, none = F.col("block"), F.lit(0)
    among = F.transform(upto("homes"), lambda o: group(F.least(block, o), F.greatest(block, o), (block > o).cast("int")))
    apart = F.col("probes") > 1  # probing rows meet homes in groups (home block, homes + probing block), else in (home block, home block)
    visited = F.when(apart, F.transform(upto("probes"), lambda j: group(block, F.col("homes") + j, none))).otherwise(F.slice(among, 1, 0))
    probing = F.transform(upto("homes"), lambda o: group(o, F.when(apart, F.col("homes") + block).otherwise(o), none))
    met = cut.select("key", "tab", "home", "id", "n", "v", F.explode(F.when(F.col("home"), F.concat(among, visited)).otherwise(probing)).alias("g"))
    met = met.select("key", "g.x", "g.y", "g.side", "tab", "home", "id", "n", "v").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return met.mapInArrow(_compare(shape, cosine, single), "a long, b long, n long")


def op3_e8_lattice(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))
