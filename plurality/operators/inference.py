"""Prediction jobs with resume: planning, a cache of calls, drift checks, flattening of responses."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ["experiment", "provider", "item_id", "variant", "prompt_hash", "model", "state"]
RESPONSE = "model string, answers map<string, struct<type: string, noul: double>>, usage struct<input_tokens: bigint, output_tokens: bigint>"


class Predictor(Protocol):
    """Answers a batch of texts: one JSON response each. Called inside Spark tasks."""

    def __call__(self, texts: list[str], variants: list[str]) -> list[str]: ...


def pending(jobs: DataFrame, cache: DataFrame, key=KEY, most: int | None = None) -> DataFrame:
    """Jobs without a cached call, by an anti-join over the whole key; at most ``most``, smallest items first."""
    left = jobs.join(cache.select(*key).distinct(), key, "left_anti")
    return left.orderBy("item_id", "variant").limit(most) if most is not None else left


def completed(jobs: DataFrame, cache: DataFrame, key=KEY) -> DataFrame:
    return jobs.join(cache.select(*key).distinct(), key, "left_semi")


def call(jobs: DataFrame, make: Callable[[], Predictor]) -> DataFrame:
    """Adds ``response``: the predictor is made once a task and called a batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predictor = make()
        for rows in batches:
            rows["response"] = predictor(rows["text"].tolist(), rows["variant"].tolist())
            yield rows

    return jobs.mapInPandas(run, T.StructType([*jobs.schema.fields, T.StructField("response", T.StringType())]))


def append_calls(answered: DataFrame, path: str) -> None:
    """Appends to the cache first; what is wrong with an answer is looked for afterwards, so no paid call is lost."""
    answered.withColumn("created_at", F.current_timestamp()).write.mode("append").partitionBy("experiment").parquet(path)


def flatten(cache: DataFrame, codes: list[str]) -> DataFrame:
    """One row a call: returned model, tokens, p_ of each code; ``consistent`` is false where payload and row differ."""
    parsed = cache.withColumn("r", F.from_json("response", RESPONSE))
    p = [F.col("r.answers")[c]["noul"].alias(f"p_{c}") for c in codes]
    return parsed.select("item_id", "variant", "prompt_hash", "model", F.col("r.model").alias("returned_model"), "state", F.col("r.usage.input_tokens").alias("input_tokens"), F.col("r.usage.output_tokens").alias("output_tokens"), *p, F.coalesce(F.col("r.model") == F.col("model"), F.lit(False)).alias("consistent"))


def usage(records: DataFrame) -> DataFrame:
    return records.groupBy("variant", "returned_model").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def drifted(records: DataFrame, pinned: str) -> DataFrame:
    """Models other than the pinned one that answered."""
    return records.select("returned_model").distinct().filter(~F.col("returned_model").eqNullSafe(F.lit(pinned)))


def evidence_fingerprint(records: DataFrame, columns: list[str]) -> DataFrame:
    """One row: SHA-256 over the records' own hashes, as a tree over their prefixes, in order.

    Equal records are counted first. Leaves hold the hashes of one prefix of nine digits, 16^9 leaves share the records,
    and no node has more than 16^3 children, so no task gathers much whatever the number of records.
    """
    rows = records.select(F.sha2(F.to_json(F.struct(*columns)), 256).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    nodes = rows.select(F.col("h").alias("at"), F.concat_ws(":", "h", "n").alias("h"), "n")
    for digits in (9, 6, 3, 0):
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x["h"])
        nodes = nodes.groupBy(F.substring("at", 1, digits).alias("at")).agg(F.sha2(F.concat_ws("", ordered), 256).alias("h"), F.sum("n").alias("n"))
    return nodes.select(F.col("n").alias("records"), F.col("h").alias("fingerprint"))
