"""An HTTP predictor that never pays twice by accident, and its calls inside Spark tasks.

What may be retried is only what was surely not served: 429. A time-out, a broken connection or a 5xx leaves open
whether the call was made, so it stops the task's calls; answers that came before it are kept.
"""

from __future__ import annotations

import json
import math
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

LONGEST_WAIT = 60.0


class Stop(RuntimeError):
    """No further call may be made before someone has looked."""


class RateLimited(Stop):
    """Still refused for its rate after the last retry."""


class Ambiguous(Stop):
    """The call may have been served and charged."""


class Refused(Stop):
    """The service says no."""


class BadAnswer(Stop):
    """A served call whose payload breaks the protocol."""


def check_answer(payload) -> None:
    """A payload has the model's name, answers whose probabilities are finite and in [0, 1], and token counts."""
    try:
        ok = isinstance(payload["model"], str) and payload["model"] != "" and len(payload["answers"]) > 0
        for answer in payload["answers"].values():
            p = answer["noul"]
            ok = ok and isinstance(p, (int, float)) and not isinstance(p, bool) and math.isfinite(p) and 0 <= p <= 1
        for n in (payload["usage"][k] for k in ("input_tokens", "output_tokens")):
            ok = ok and isinstance(n, int) and not isinstance(n, bool) and n >= 0
    except (KeyError, TypeError, AttributeError) as e:
        raise BadAnswer(f"answer lacks {e}") from e
    if not ok:
        raise BadAnswer("answer is not of the protocol's shape")


class HttpClient:
    """Sends one text at a time. ``key_variable`` names the environment variable that holds the key on the executors,
    so that the key is in no plan and no log; ``ask`` makes the request's questions from the variant."""

    def __init__(self, base_url: str, model: str, *, ask: Callable[[str], object], key_variable: str | None = None, timeout=60.0, retries=5, backoff=1.0, insecure=False, paths=("/v1/models", "/v1/answers"), sleep=time.sleep) -> None:
        self.base = base_url.rstrip("/")
        if not self.base.startswith("https://") and not insecure:
            raise ValueError("the provider's address must start with https://")
        self.model, self.ask, self.key_variable = model, ask, key_variable
        self.timeout, self.retries, self.backoff, self.sleep = timeout, retries, backoff, sleep
        self.models_path, self.call_path = paths

    def _request(self, path: str, body=None):
        """(status, headers, bytes); raises Ambiguous where no whole response came."""
        headers = {"Content-Type": "application/json"}
        if self.key_variable:
            headers["Authorization"] = f"Bearer {os.environ[self.key_variable]}"
        data = None if body is None else json.dumps(body, ensure_ascii=False).encode()
        request = urllib.request.Request(self.base + path, data=data, headers=headers)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as response:
                return response.status, response.headers, response.read()
        except urllib.error.HTTPError as e:
            return e.code, e.headers, e.read()
        except OSError as e:  # URLError and time-outs are OSErrors
            raise Ambiguous(f"no whole response: {e}") from e

    def advertised(self) -> dict:
        """The service's own row for the model, before any call is paid; Refused if it has none."""
        status, _, data = self._request(self.models_path)
        if status != 200:
            raise Refused(f"models could not be listed: {status}")
        try:
            rows = {str(m["name"]): m for m in json.loads(data)["models"]}
        except (ValueError, KeyError, TypeError) as e:
            raise BadAnswer("the list of models is not of the protocol's shape") from e
        if self.model not in rows:
            raise Refused(f"{self.model} is not advertised, but {sorted(rows)}")
        return rows[self.model]

    def _wait(self, attempt: int, headers) -> float:
        asked = headers.get("Retry-After") or ""
        try:
            least = float(asked)
        except ValueError:
            least = 0.0
        return min(max(self.backoff * 2**attempt, least if math.isfinite(least) else LONGEST_WAIT), LONGEST_WAIT)

    def __call__(self, text: str, variant: str) -> str:
        body = {"state": text, "model": self.model, "questions": self.ask(variant)}
        for attempt in range(self.retries + 1):
            status, headers, data = self._request(self.call_path, body)
            if status == 200:
                try:
                    payload = json.loads(data)
                except ValueError as e:
                    raise BadAnswer("a served call answered no JSON") from e
                check_answer(payload)
                return json.dumps(payload, sort_keys=True, ensure_ascii=False)
            if status >= 500:
                raise Ambiguous(f"server error {status}")
            if status != 429:
                raise Refused(f"status {status}: {data[:200].decode(errors='replace')}")
            if attempt < self.retries:
                self.sleep(self._wait(attempt, headers))
        raise RateLimited(f"429 after {self.retries} retries")


def call_each(jobs: DataFrame, make: Callable[[], Callable[[str, str], str]], *, tasks: int | None = None) -> DataFrame:
    """Adds ``response`` and ``outcome``: ``answered``, ``stopped: ...`` or ``not tried``.

    ``make`` gives a task its client. After a Stop the task makes no more calls, and its answers stay. ``tasks`` bounds
    the calls under way at a time. Write the result before anything else reads it: reading twice calls twice.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, stopped = make(), False
        for rows in batches:
            responses, outcomes = [], []
            for text, variant in zip(rows["text"], rows["variant"], strict=True):
                response, outcome = None, "not tried"
                if not stopped:
                    try:
                        response, outcome = client(text, variant), "answered"
                    except Stop as e:
                        stopped, outcome = True, f"stopped: {type(e).__name__}: {e}"
                responses.append(response)
                outcomes.append(outcome)
            yield rows.assign(response=pd.Series(responses, rows.index, dtype=object), outcome=outcomes)

    added = [T.StructField("response", T.StringType()), T.StructField("outcome", T.StringType())]
    dealt = jobs.repartition(tasks) if tasks else jobs
    return dealt.mapInPandas(run, T.StructType([*jobs.schema.fields, *added]))
