"""The HTTP client against a local service, and the committed cache of calls."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from plurality.operators import cache as H
from plurality.operators import client as L
from plurality.operators import inference as I
from plurality.sources import storage

ANSWER = {"model": "m1", "answers": {"A": {"type": "p", "noul": 0.25}}, "usage": {"input_tokens": 3, "output_tokens": 1}}


@pytest.fixture
def service():
    """A service whose answers are told: a list of (status, headers, body), the last one for ever."""
    told, asked = [], []

    class Handler(BaseHTTPRequestHandler):
        def _answer(self):
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            asked.append((self.path, self.headers.get("Authorization"), json.loads(body) if body else None))
            status, headers, out = told.pop(0) if len(told) > 1 else told[0]
            if status == "hang":
                time.sleep(1.5)
                return
            data = out if isinstance(out, bytes) else json.dumps(out).encode()
            self.send_response(status)
            for k, v in {**headers, "Content-Length": str(len(data))}.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _answer

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/", told, asked
    server.shutdown()


def client(url, slept=None, **options):
    return L.HttpClient(url, "m-latest", ask=lambda variant: {"variant": variant}, insecure=True, sleep=(slept if slept is not None else []).append, **options)


def test_client_waits_for_rate_limits_alone(service, monkeypatch):
    url, told, asked = service
    monkeypatch.setenv("TEST_PREDICTOR_KEY", "k")
    slept: list = []
    told[:] = [(429, {}, ""), (429, {"Retry-After": "7"}, ""), (429, {"Retry-After": "900"}, ""), (429, {"Retry-After": "soon"}, ""), (200, {}, ANSWER)]
    assert json.loads(client(url, slept, key_variable="TEST_PREDICTOR_KEY")("text é", "strict")) == ANSWER
    assert slept == [1.0, 7.0, 60.0, 8.0] and len(asked) == 5
    assert asked[0] == ("/v1/answers", "Bearer k", {"state": "text é", "model": "m-latest", "questions": {"variant": "strict"}})
    slept.clear()
    told[:] = [(429, {}, "")]
    with pytest.raises(L.RateLimited):
        client(url, slept, retries=2, backoff=0.5)("t", "v")
    assert slept == [0.5, 1.0]


@pytest.mark.parametrize("answer,kind", [
    ((500, {}, ""), L.Ambiguous), ((503, {"Retry-After": "1"}, ""), L.Ambiguous), (("hang", {}, ""), L.Ambiguous), ((400, {}, "no"), L.Refused), ((200, {}, b"<html>"), L.BadAnswer), ((200, {}, {"model": "m1"}), L.BadAnswer),
    ((200, {}, ANSWER | {"answers": {"A": {"noul": 1.5}}}), L.BadAnswer), ((200, {}, ANSWER | {"answers": {"A": {"noul": True}}}), L.BadAnswer), ((200, {}, ANSWER | {"usage": {"input_tokens": -1, "output_tokens": 1}}), L.BadAnswer),
])
def test_client_stops_at_once_on_anything_else(service, answer, kind):
    url, told, asked = service
    told[:] = [answer]
    slept: list = []
    with pytest.raises(kind):
        client(url, slept, timeout=0.4)("t", "v")
    assert len(asked) == 1 and slept == []


def test_preflight_and_addresses(service):
    url, told, asked = service
    told[:] = [(200, {}, {"models": [{"name": "m-latest", "release_date": "d"}]})]
    assert client(url).advertised()["release_date"] == "d" and asked[0][:2] == ("/v1/models", None)
    for answer, kind in (((200, {}, {"models": [{"name": "other"}]}), L.Refused), ((401, {}, ""), L.Refused), ((200, {}, {"models": 3}), L.BadAnswer)):
        told[:] = [answer]
        with pytest.raises(kind):
            client(url).advertised()
    with pytest.raises(ValueError, match="https"):
        L.HttpClient("http://a", "m", ask=str)
    assert L.HttpClient("https://a//", "m", ask=str).base == "https://a"


# The cache


def jobs(spark, ids, model="m1", experiment="e"):
    return spark.createDataFrame([(experiment, "https://p/x", str(i), "v", "h", model, f"s{i}", f"text {i}") for i in ids], ", ".join(f"{c} string" for c in [*I.KEY, "text"])).repartition(2)


def maker(model="m1", fail_after=None):
    def make():
        made = []

        def call(text, variant):
            made.append(text)
            if fail_after is not None and len(made) > fail_after:
                raise L.Ambiguous("server error 500")
            return json.dumps(ANSWER | {"model": model})

        return call

    return make


def items(cache, **place):
    return sorted(int(r[0]) for r in cache.calls(**place).select("item_id").collect())


def test_a_stop_keeps_what_was_answered_and_is_resumed(spark, tmp_path):
    cache = H.CallCache(spark, str(tmp_path / "c"))
    assert cache.calls().count() == 0 and cache.check_model("e", "https://p/x", "m1") is None
    with pytest.raises(L.Stop, match="500"):
        H.answer(cache, jobs(spark, range(40)), maker(fail_after=10), tasks=1)
    kept = items(cache)
    assert len(kept) == 10
    assert H.answer(cache, jobs(spark, range(40)), maker(), most=5) == {"missing_before": 5, "new_calls": 5, "remaining": 0}
    done = H.answer(cache, jobs(spark, [*range(40), 3, 3]), maker(), per_commit=6)
    assert done["new_calls"] == 40 - len(kept) - 5 and items(cache) == list(range(40)) and len(cache.commits()) > 3
    assert H.answer(cache, jobs(spark, range(40)), maker())["missing_before"] == 0
    flat = cache.calls().first()
    assert (flat.returned_model, flat.input_tokens, flat.output_tokens) == ("m1", 3, 1) and flat.created_at is not None


def test_killed_batches_leave_neither_rows_nor_gaps(spark, tmp_path, monkeypatch):
    cache = H.CallCache(spark, str(tmp_path / "c"))
    answered = L.call_each(jobs(spark, range(6)), maker())
    # Killed after the rows were written, before the commit.
    with monkeypatch.context() as m:
        m.setattr(H.CallCache, "_log", lambda self, entry: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            cache.commit(answered, batch="b0")
    assert items(cache) == []
    assert cache.commit(answered, batch="b0") == 6 and cache.commit(answered, batch="b0") == 0 and items(cache) == list(range(6))
    # Killed between the calls and their commit: the answers are found and not paid again.
    with monkeypatch.context() as m:
        m.setattr(H.CallCache, "commit", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            H.answer(cache, jobs(spark, range(9)), maker())
    assert H.answer(cache, jobs(spark, range(9)), maker(model="paid twice"))["new_calls"] == 0
    assert items(cache) == list(range(9))
    # Two writers with keys in common: the second brings only what is new.
    assert cache.commit(L.call_each(jobs(spark, range(7, 12)), maker())) == 3 and items(cache) == list(range(12))
    assert len(cache.sweep()) == 2
    cache.compact()
    assert len(cache._visible(cache.commits())) == 1 and items(cache) == list(range(12)) and cache.commit(answered, batch="b0") == 0
    cache.sweep()
    assert items(H.CallCache(spark, str(tmp_path / "c"))) == list(range(12))


def test_drift_is_found_after_the_answers_are_safe(spark, tmp_path):
    cache = H.CallCache(spark, str(tmp_path / "c"))
    H.answer(cache, jobs(spark, range(3)), maker())
    storage.delete(spark, f"{cache.root}/_models")  # the process died before it wrote what had answered
    assert cache.check_model("e", "https://p/x", "m1") == "m1" and storage.names(spark, f"{cache.root}/_models")
    with pytest.raises(H.ModelDrift):
        H.answer(cache, jobs(spark, range(5)), maker(model="m2"))
    assert items(cache) == list(range(5))
    H.answer(cache, jobs(spark, range(3), model="other"), maker(model="m2"))


def test_scans_are_pruned_and_new_jobs_are_not_shuffled(spark, tmp_path):
    cache = H.CallCache(spark, str(tmp_path / "c"))
    for experiment, model in (("e", "m1"), ("e", "m2"), ("f", "m1")):
        H.answer(cache, jobs(spark, range(20), model=model, experiment=experiment), maker(model=model))
    place = {"experiment": "e", "provider": "https://p/x", "model": "m1"}
    one = cache.calls(**place)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "experiment" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert one.count() == 20 and len({f.split("/attempt=")[0] for f in [r[0] for r in one.select(F.input_file_name()).distinct().collect()]}) == 1
    ours = jobs(spark, range(15, 40))
    for bits in (27, 3):  # with 8 bits nearly every new job meets the cache as well: the result is the same
        todo = cache.pending(ours, bits=bits, **place)
        assert sorted(int(r.item_id) for r in todo.collect()) == list(range(20, 40)) and todo.columns == ours.columns
    assert cache.pending(ours, experiment="none").count() == 25 and cache.pending(ours.limit(0)).count() == 0


def test_other_layouts_are_refused_or_migrated(spark, tmp_path):
    old = str(tmp_path / "old")
    I.append_calls(I.call(jobs(spark, range(4)), lambda: lambda texts, variants: [json.dumps(ANSWER)] * len(texts)), old)
    with pytest.raises(H.LegacyCache):
        H.CallCache(spark, old)
    cache = H.migrate(spark, old, str(tmp_path / "new"))
    assert items(cache) == list(range(4)) and items(H.migrate(spark, old, str(tmp_path / "new"))) == list(range(4))
    storage.write_json(spark, f"{cache.root}/_about.json", {"version": 1})
    with pytest.raises(H.LegacyCache, match="version 1"):
        H.CallCache(spark, cache.root)
    empty = str(tmp_path / "empty")
    spark.read.parquet(old).limit(0).write.parquet(empty)
    assert H.CallCache(spark, empty).calls().count() == 0
