"""A kept family of sorted levels that takes batch after batch of documents.

``suffix_dedup`` finds the repeats of one table. Here the levels stay, as Parquet in a folder: a new batch's anchors are
merge-scanned against every level of their shard, the suffixes around anchors that share no more than their gram get
suffix arrays with those of earlier texts, and levels of like size merge, so that there are logarithmically many and
an anchor is rewritten logarithmically often. The manifest is replaced last: a batch is in the index whole or not at all,
and what a lost run left is never read.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plurality.llm import suffix_dedup as D
from plurality.llm.common import text_or_empty
from plurality.sources import storage

OLD_SUSPECTS, OLD_SEGMENTS, LEVEL = 4, 5, 16
_TEXTS = "doc_id long, text string, doc long, th long, shard int"
_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


class Against(D.LogFamily):
    """A family whose new rows are first scanned against ``earlier`` levels' sorted keys, which they never displace."""

    def __init__(self, key, order, earlier):
        super().__init__(key, order)
        self.earlier = [keys for keys in earlier if len(keys)]

    def add(self, rows):
        found = []
        for keys in self.earlier:
            own = self.key(rows)
            met = keys[np.minimum(np.searchsorted(keys, own), len(keys) - 1)] == own
            found.append(rows[met])
            rows = rows[~met]
        return [*found, *super().add(rows)] if len(rows) else found


def _gathered(family, blobs, read):
    """What a family finds for blobs, which it takes in runs of ``RUN`` rows and more."""
    pending, size = [], 0
    for blob in [*blobs, None]:
        if blob is not None:
            pending.append(read(blob))
            size += len(pending[-1])
        if pending and (size >= D.RUN or blob is None):
            yield from family.add(np.concatenate(pending))
            pending, size = [], 0


def _settle_anchors(shards, hot):
    """A shard's new runs and its levels to spans, the batch's own level, and suspects on both sides."""

    def run(batches):
        for shard, blobs in D._shard_runs(batches):
            runs = [b for k, b in blobs if k == D.RUN_OF_ANCHORS]
            spots = [np.frombuffer(b, D._SPOT) for k, b in blobs if k == D.SPOTS]
            levels = {n: np.concatenate([np.frombuffer(b, D._ANCHOR) for k, b in blobs if k == n]) for n in sorted({k for k, _ in blobs if k >= LEVEL})}
            family = Against(lambda r: r["ctx"], lambda r: (r["pos"], r["th"], r["doc"]), [np.sort(x["ctx"], kind="stable") for x in levels.values()])
            spots += [D._clipped(x, None) for x in _gathered(family, runs, lambda b: np.frombuffer(b, D._ANCHOR))]
            if spots:
                yield D._emit([(s, D.SPOTS, x.tobytes()) for s, x in D._by_doc(D._merged(np.concatenate(spots)), shards)])
            rest = family.all()
            if rest is None or not len(rest):
                continue
            yield D._emit([(shard, LEVEL, rest[i : i + D.RUN].tobytes()) for i in range(0, len(rest), D.RUN)])
            old = np.concatenate([*levels.values(), rest[:0]])
            old = old[np.isin(old["gram"], rest["gram"])]
            grams, times = np.unique(np.concatenate([rest["gram"], old["gram"]]), return_counts=True)
            for rows, kind in ((rest, D.SUSPECTS), (old, OLD_SUSPECTS)):
                many = times[np.searchsorted(grams, rows["gram"])]
                found = rows[many > 1]
                out = np.empty(len(found), D._SUSPECT)
                for c in ("gram", "doc", "th", "pos"):
                    out[c] = found[c]
                out["hot"] = many[many > 1] > hot
                yield D._emit([(s, kind, x.tobytes()) for s, x in D._by_doc(out, shards)])

    return run


def _settle_suffixes(shards):
    """A shard's new suffixes against those of earlier texts, then against each other, to spans dealt by document."""

    def run(batches):
        for _, blobs in D._shard_runs(batches):
            spots = [np.frombuffer(b, D._SPOT) for k, b in blobs if k == D.SPOTS]
            earlier = [np.unique(D._suffixes(b)["s"]) for k, b in blobs if k == OLD_SEGMENTS]
            family = Against(lambda r: r["s"], lambda r: (r["p"], r["th"], r["doc"]), [np.unique(np.concatenate(earlier))] if earlier else [])
            for x in _gathered(family, [b for k, b in blobs if k == D.SEGMENTS], D._suffixes):
                spot = np.empty(len(x), D._SPOT)
                spot["doc"], spot["th"], spot["a"], spot["b"] = x["doc"], x["th"], x["p"], x["p"] + D.LENGTH
                spots.append(D._merged(spot))
            if spots:
                yield D._emit([(s, D.SPOTS, x.tobytes()) for s, x in D._by_doc(D._merged(np.concatenate(spots)), shards)])

    return run


def _texts_of(batches):
    """The texts that blobs of suspects point at."""
    import pyarrow as pa

    for batch in batches:
        for blob in batch.column("blob").to_pylist():
            places = np.unique(np.frombuffer(blob, D._SUSPECT)[["doc", "th"]])
            yield pa.record_batch([pa.array(np.ascontiguousarray(places[c])) for c in ("doc", "th")], ["doc", "th"])


def _level(batches):
    """Pieces of a shard's levels as pieces of one, in the order of their contexts."""
    for shard, blobs in D._shard_runs(batches):
        rows = np.concatenate([np.frombuffer(b, D._ANCHOR) for _, b in blobs])
        rows = rows[np.argsort(rows["ctx"], kind="stable")]
        yield D._emit([(shard, LEVEL, rows[i : i + D.RUN].tobytes()) for i in range(0, len(rows), D.RUN)])


def _finish(texts, blobs):
    import pyarrow as pa

    out, kept = D._remove(texts, blobs)
    return out.append_column("kept", pa.array(kept, pa.binary()))


class SuffixIndex:
    """Repeats of 100 bytes within and across batches, by levels kept under ``path`` (a folder all executors share).

    ``shards`` is settled when the index is made: a task holds one shard's texts and levels at a time, so take the
    bytes expected in all over some 5 MiB. A batch reads what the index holds once and shuffles the levels' anchors
    (36 bytes each, about one for 35 bytes of text), but only those earlier texts that share a gram with it. One writer at
    a time.
    """

    def __init__(self, spark: SparkSession, path: str, *, shards: int = 64, hot: int = D.HOT):
        self.spark, self.path, self.hot = spark, path.rstrip("/"), hot
        self.shards = (storage.read_json(spark, f"{self.path}/manifest.json") or {"shards": shards})["shards"]

    def state(self) -> dict:
        return storage.read_json(self.spark, f"{self.path}/manifest.json") or {"shards": self.shards, "batches": [], "levels": []}

    def _written(self, df: DataFrame, name: str, schema: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self._read(name, schema)

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _by_shard(self, df: DataFrame) -> DataFrame:
        return df.repartition("shard").sortWithinPartitions("shard")

    def result(self, name: str) -> DataFrame:
        """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` of a batch's rows, as found when it was added."""
        places = {b["name"]: b["place"] for b in self.state()["batches"]}
        return self._read(f"{places[name]}/result", _RESULT)

    def add(self, docs: DataFrame, name: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Takes a batch into the index and returns its ``result``.

        A byte goes if a 100-byte string over it stands in an earlier batch, whatever the ids there, or starts
        earlier in this one (smaller id, or the same document). Null texts count as empty, null ids stand after all
        others; rows with the same id and text are one document within a batch and a repeat across batches. An empty
        batch adds nothing but its name. A name that is there is not added again: its first result is returned.
        """
        state, n = self.state(), self.shards
        if any(b["name"] == name for b in state["batches"]):
            return self.result(name)
        place = f"batch-{uuid.uuid4().hex}"
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
        rows = rows.withColumn("doc", F.coalesce("doc_id", F.lit(2**63 - 1))).withColumn("th", F.xxhash64("text"))
        texts = self._written(rows.mapInArrow(D._shard_of(n), _TEXTS), f"{place}/texts", _TEXTS)

        runs = texts.mapInArrow(D._scan_batches(n), D._BLOBS)
        levels = [self._read(x["place"], D._BLOBS).withColumn("kind", F.lit(LEVEL + i)) for i, x in enumerate(state["levels"])]
        met = self._by_shard(reduce(DataFrame.unionByName, levels, runs)).mapInArrow(_settle_anchors(n, self.hot), D._BLOBS)
        settled, kind = self._written(met, f"{place}/settled", D._BLOBS), F.col("kind")

        cut = texts.groupBy("shard").cogroup(settled.filter(kind.isin(D.SPOTS, D.SUSPECTS)).groupBy("shard")).applyInArrow(D._cut_segments(n), D._BLOBS)
        if state["batches"]:
            asked = settled.filter(kind == OLD_SUSPECTS)
            wanted = asked.mapInArrow(_texts_of, "doc long, th long").distinct()
            earlier = reduce(DataFrame.unionByName, [self._read(f"{b['place']}/texts", _TEXTS) for b in state["batches"]])
            earlier = earlier.join(wanted, ["doc", "th"], "left_semi").select(*texts.columns)
            asked = asked.withColumn("kind", F.lit(D.SUSPECTS)).groupBy("shard")
            cut = cut.unionByName(earlier.groupBy("shard").cogroup(asked).applyInArrow(D._cut_segments(n), D._BLOBS).withColumn("kind", F.lit(OLD_SEGMENTS)))
        spans = self._by_shard(cut).mapInArrow(_settle_suffixes(n), D._BLOBS)
        self._written(texts.groupBy("shard").cogroup(spans.groupBy("shard")).applyInArrow(_finish, _RESULT), f"{place}/result", _RESULT)

        own = settled.filter(kind == LEVEL)
        held = [*state["levels"], {"place": None, "anchors": self._anchors(own)}]
        merged = [held.pop()]
        while held and held[-1]["anchors"] < 2 * sum(x["anchors"] for x in merged):
            merged.append(held.pop())
        pieces = [own, *[self._read(x["place"], D._BLOBS) for x in merged if x["place"]]]
        level = f"level-{uuid.uuid4().hex}"
        self._written(self._by_shard(reduce(DataFrame.unionByName, pieces)).mapInArrow(_level, D._BLOBS), level, D._BLOBS)
        held.append({"place": level, "anchors": sum(x["anchors"] for x in merged)})
        storage.write_json(self.spark, f"{self.path}/manifest.json", {"shards": n, "batches": [*state["batches"], {"name": name, "place": place}], "levels": held})
        for gone in [f"{place}/settled", *[x["place"] for x in merged if x["place"]]]:
            storage.delete(self.spark, f"{self.path}/{gone}")
        return self.result(name)

    def _anchors(self, level: DataFrame) -> int:
        return (level.agg(F.sum(F.octet_length("blob"))).first()[0] or 0) // D._ANCHOR.itemsize
