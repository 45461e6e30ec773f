"""The committed cache of calls, fed by a stream of jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from plurality.operators.cache import CallCache, answer


def answer_stream(jobs: DataFrame, make: Callable[[], Callable[[str, str], str]], path: str, checkpoint: str, **options) -> StreamingQuery:
    """Calls the predictor for jobs of a stream that the cache at ``path`` does not hold, and commits the answers.

    A micro-batch that runs again finds what it committed, and what it had answered without a commit, and calls for
    the rest alone. ``options`` are those of ``answer``.
    """

    def batch(rows: DataFrame, epoch: int) -> None:
        answer(CallCache(rows.sparkSession, path), rows, make, **options)

    return jobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
