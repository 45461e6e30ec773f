"""The cache of calls as a committed table: no call lost, none counted twice, and pruned when it is read.

Answers are Parquet under ``calls/experiment=/provider=/model=/attempt=``. An attempt becomes visible by one file in
``_commits``, made after its rows are written: what a killed batch left has no such file and is never read. Each
commit has a number, and only one writer can make a number's file; a batch of a stream is named in its commit, so
running it again adds nothing. The model that first answered is kept beside the table, and found again in the rows if
the process died before writing it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plurality.operators.client import Stop, call_each
from plurality.operators.inference import KEY
from plurality.sources import storage

VERSION = 2
PLACE = ["experiment", "provider", "model"]
ROWS = "item_id string, variant string, prompt_hash string, state string, returned_model string, response string, input_tokens bigint, output_tokens bigint, created_at timestamp"
SCHEMA = f"{ROWS}, experiment string, provider string, model string, attempt string"
#: Bits of the map of cached keys: 16 MB, broadcast whatever the size of the cache.
BITS = 27


class LegacyCache(RuntimeError):
    """The folder holds calls of another layout: archive or migrate them first."""


class ModelDrift(RuntimeError):
    """Another model answered than before. What it answered is committed."""


class CallCache:
    """The cache at ``root``, made if there is none."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.calls_at, self.log_at = f"{self.root}/calls", f"{self.root}/_commits"
        about = storage.read_json(spark, f"{self.root}/_about.json")
        if about is None:
            held = [n for n in storage.names(spark, self.root) if not n.startswith((".", "_"))]
            if held and not spark.read.option("recursiveFileLookup", True).parquet(self.root).isEmpty():
                raise LegacyCache(f"{root} holds calls without a version: move them and use migrate()")
            for name in held:  # an empty table of another layout
                storage.delete(spark, f"{self.root}/{name}")
            storage.write_json(spark, f"{self.root}/_about.json", {"version": VERSION, "columns": SCHEMA}, only_new=True)
        elif about.get("version") != VERSION:
            raise LegacyCache(f"{root} has version {about.get('version')}, this library reads {VERSION}")

    # Commits

    def commits(self) -> list[dict]:
        """The log in order; ``compact`` keeps it short."""
        found = (storage.read_json(self.spark, f"{self.log_at}/{n}") for n in storage.names(self.spark, self.log_at) if n.endswith(".json") and n[0].isdigit())
        return [c for c in found if c is not None]

    def _visible(self, commits: list[dict]) -> list[str]:
        gone = {a for c in commits for a in c.get("replaces", [])}
        return [c["attempt"] for c in commits if c["attempt"] not in gone]

    def calls(self, *, experiment: str | None = None, provider: str | None = None, model: str | None = None) -> DataFrame:
        """Committed calls; the arguments and the attempts are partition filters, so other folders are not read."""
        attempts = self._visible(self.commits())
        if not attempts:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).option("basePath", self.calls_at).parquet(self.calls_at).filter(F.col("attempt").isin(attempts))
        for name, value in zip(PLACE, (experiment, provider, model), strict=True):
            rows = rows.filter(F.col(name) == value) if value is not None else rows
        return rows

    def _write(self, rows: DataFrame) -> str:
        attempt = uuid.uuid4().hex
        rows.withColumn("attempt", F.lit(attempt)).write.mode("append").partitionBy(*PLACE, "attempt").parquet(self.calls_at)
        return attempt

    def _log(self, entry: dict) -> bool:
        number = max([c["number"] for c in self.commits()], default=-1) + 1
        return storage.write_json(self.spark, f"{self.log_at}/{number:09d}.json", entry | {"number": number}, only_new=True)

    def commit(self, answered: DataFrame, batch: str | None = None) -> int:
        """Makes the answers of ``answered`` (columns ``KEY`` and ``response``) visible at once; returns how many.

        Rows without a response are left out, and of one key one answer stays. A ``batch`` that is in the log already
        adds nothing. If another writer commits first, keys that it brought are dropped and the rest is committed
        after it. The rows are computed once: they are on disk before anything looks at them.
        """
        if batch is not None and any(batch in c.get("batches", []) for c in self.commits()):
            return 0
        payload = F.from_json("response", "model string, usage struct<input_tokens: bigint, output_tokens: bigint>")
        rows = answered.filter("response IS NOT NULL").withColumn("_r", payload)
        rows = rows.select(*KEY, F.col("_r.model").alias("returned_model"), "response", F.col("_r.usage.input_tokens").alias("input_tokens"), F.col("_r.usage.output_tokens").alias("output_tokens"), F.current_timestamp().alias("created_at"))
        attempt = self._write(rows.dropDuplicates(KEY))
        while True:
            seen = self._visible(self.commits())
            own = self.spark.read.schema(SCHEMA).parquet(self.calls_at).filter(F.col("attempt") == attempt)
            others = self.spark.read.schema(SCHEMA).parquet(self.calls_at).filter(F.col("attempt").isin(seen)) if seen else None
            if others is not None:
                fresh = own.join(others.select(*KEY), KEY, "left_anti")
                if fresh.count() < own.count():
                    attempt = self._write(fresh.drop("attempt"))
                    own = self.spark.read.schema(SCHEMA).parquet(self.calls_at).filter(F.col("attempt") == attempt)
            found = own.groupBy(*PLACE, "returned_model").count().collect()
            entry = {"attempt": attempt, "rows": sum(r["count"] for r in found), "batches": [batch] if batch is not None else []}
            if self._visible(self.commits()) == seen and self._log(entry):
                break
        for place in {tuple(r[p] for p in PLACE) for r in found}:
            self.check_model(*place)
        return entry["rows"]

    def compact(self) -> None:
        """All visible attempts as one; what they and killed batches left can then be swept."""
        commits = self.commits()
        old = self._visible(commits)
        if len(old) > 1:
            attempt = self._write(self.calls().drop("attempt"))
            self._log({"attempt": attempt, "rows": sum(c["rows"] for c in commits if c["attempt"] in old), "replaces": old, "batches": []})

    def sweep(self) -> list[str]:
        """Deletes attempts that no commit shows, when no writer or reader is under way; returns them."""
        shown, dropped = set(self._visible(self.commits())), []

        def visit(folder: str, depth: int) -> None:
            for name in storage.names(self.spark, folder):
                if depth < len(PLACE) and "=" in name:
                    visit(f"{folder}/{name}", depth + 1)
                elif name.startswith("attempt=") and name.removeprefix("attempt=") not in shown:
                    storage.delete(self.spark, f"{folder}/{name}")
                    dropped.append(name.removeprefix("attempt="))

        visit(self.calls_at, 0)
        return dropped

    # The model's identity

    def check_model(self, experiment: str, provider: str, model: str) -> str | None:
        """The one model that answered, from the stored state or, where that is missing, from the committed rows;
        ModelDrift where rows and state differ."""
        at = f"{self.root}/_models/{uuid.uuid5(uuid.NAMESPACE_URL, repr((experiment, provider, model))).hex}.json"
        seen = sorted(str(r[0]) for r in self.calls(experiment=experiment, provider=provider, model=model).select("returned_model").distinct().limit(10).collect())
        state = storage.read_json(self.spark, at)
        if len(seen) > 1 or (state and seen and state["returned_model"] not in seen):
            raise ModelDrift(f"{model} was answered by {seen}, first by {state['returned_model'] if state else 'an unknown one'}")
        if state is None and seen:
            storage.write_json(self.spark, at, {"experiment": experiment, "provider": provider, "model": model, "returned_model": seen[0]}, only_new=True)
        return state["returned_model"] if state else seen[0] if seen else None

    # Planning

    def pending(self, jobs: DataFrame, *, experiment: str | None = None, provider: str | None = None, model: str | None = None, bits: int = BITS) -> DataFrame:
        """Jobs without a committed call.

        A map of hashed keys tells most new jobs apart without a shuffle; only those whose bit is set, a share of
        cached keys / 2^bits by chance, meet the cache in an anti-join. ``jobs`` is read twice for that.
        """
        cached = self.calls(experiment=experiment, provider=provider, model=model).select(*KEY)
        at = lambda df: df.withColumn("_at", F.pmod(F.xxhash64(*KEY), F.lit(1 << bits)))
        maps = at(cached).groupBy(F.bitmap_bucket_number("_at").alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_map"))
        byte = F.conv(F.hex(F.substring("_map", (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        met = at(jobs).withColumn("_part", F.bitmap_bucket_number("_at")).withColumn("_bit", F.bitmap_bit_position("_at")).join(F.broadcast(maps), "_part", "left")
        met = met.withColumn("_set", F.coalesce(F.call_function("getbit", byte, (F.col("_bit") % 8).cast("int")) == 1, F.lit(False)))
        new = met.filter("NOT _set").select(*jobs.columns)
        return new.unionByName(met.filter("_set").select(*jobs.columns).join(cached, KEY, "left_anti"))


def migrate(spark: SparkSession, legacy: str, root: str) -> CallCache:
    """A cache at ``root`` with the calls of a table of the older layout (``KEY`` and ``response``), one a key."""
    cache = CallCache(spark, root)
    cache.commit(spark.read.parquet(legacy), batch=f"migrated from {legacy}")
    return cache


def _commit_left(cache: CallCache) -> int:
    """Answers that were written whole, by a process that died before it committed them."""
    spark, at, new = cache.spark, f"{cache.root}/_outcomes", 0
    for name in storage.names(spark, at):
        if storage.exists(spark, f"{at}/{name}/_SUCCESS"):
            new += cache.commit(spark.read.parquet(f"{at}/{name}"), batch=name)
        storage.delete(spark, f"{at}/{name}")
    return new


def answer(cache: CallCache, jobs: DataFrame, make: Callable, *, most: int | None = None, per_commit: int = 10_000, tasks: int | None = None, **place) -> dict[str, int]:
    """Calls for the pending jobs, at most ``most`` over all tasks, and commits them in slices of about ``per_commit``.

    Of a killed process only the slice under way is called again. After a Stop the answers of its slice are committed,
    no further slice begins, and the Stop is raised. ``make`` gives each task its client.
    """
    _commit_left(cache)
    todo = cache.pending(jobs, **place).dropDuplicates(KEY)
    todo = (todo.orderBy(*KEY).limit(most) if most is not None else todo).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        missing = todo.count()
        slices, new = max(1, -(-missing // per_commit)), 0
        for k in range(slices if missing else 0):
            part = todo.filter(F.pmod(F.xxhash64(F.lit("slice"), *KEY), F.lit(slices)) == k)
            # Outcomes are on disk before they are looked at: reading a call's column again would call again.
            name = uuid.uuid4().hex
            at = f"{cache.root}/_outcomes/{name}"
            call_each(part, make, tasks=tasks).select(*KEY, "response", "outcome").write.parquet(at)
            called = cache.spark.read.parquet(at)
            stopped = called.filter("outcome LIKE 'stopped: %'").select("outcome").limit(1).collect()
            new += cache.commit(called, batch=name)
            storage.delete(cache.spark, at)
            if stopped:
                raise Stop(f"{stopped[0]['outcome']} ({new} calls were committed)")
        return {"missing_before": missing, "new_calls": new, "remaining": missing - new}
    finally:
        todo.unpersist()
