import random
from collections import Counter, defaultdict

from plurality.llm import mixing
from plurality.llm.mixing import fair_queue, mix_documents, source_targets


def filled(sizes, weights, budget, epochs=3):
    """Share by weight; what is above its cap stops there and the excess is shared again."""
    caps, target, open_ = [epochs * s for s in sizes], [0.0] * len(sizes), set(range(len(sizes)))
    left = float(budget)
    while open_:
        level = left / sum(weights[i] for i in open_)
        above = {i for i in open_ if level * weights[i] > caps[i]}
        if not above:
            for i in open_:
                target[i] = level * weights[i]
            break
        for i in above:
            target[i] = caps[i]
            left -= caps[i]
        open_ -= above
    return target


def rows_of(spark, sizes, seed=1):
    rng, rows, k = random.Random(seed), [], 0
    for source, total in sizes.items():
        while total > 0:
            n = min(total, rng.randint(1, 40))
            rows.append((k, " ".join(["w"] * n), source))
            total, k = total - n, k + 1
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_targets_are_water_filled(spark):
    for sizes in ([100, 100, 100, 100], [10, 1000, 20, 5, 5, 5000], [1, 1, 1, 100000, 7], [5000, 3, 3, 3, 3, 3], [0, 10, 10]):
        names = [f"s{i}" for i in range(len(sizes))]
        sized = spark.createDataFrame([(f"={n}", n, s) for n, s in zip(names, sizes, strict=True)], "skey string, source string, size long")
        got = {r["source"]: r["target"] for r in source_targets(sized).collect()}
        want = filled(sizes, [i % 3 + 1 for i in range(len(sizes))], sum(sizes))
        assert all(abs(got[n] - w) < 1e-5 for n, w in zip(names, want, strict=True)), (sizes, got, want)


def test_takes_come_near_targets_and_reruns_agree(spark):
    docs = rows_of(spark, {"a": 6000, "b": 500, "c": 9000, None: 700})
    first, second = (sorted((r["doc_id"], r["size"], r["taken"], r["target"], r["source"] or "") for r in fair_queue(docs).collect()) for _ in range(2))
    assert first == second
    taken, target = defaultdict(int), {}
    for _, size, t, goal, source in first:
        taken[source] += t
        target[source] = goal
        assert 0 <= t <= 3 * size and t % size == 0
    assert sum(taken.values()) <= 16200
    assert all(abs(taken[s] - target[s]) <= 45 for s in taken)


def test_edges(spark):
    schema = "doc_id long, text string, source string, size long, target double, h string"
    rows = [(1, None, "a", 9, 9.0, "x"), (2, "", "a", 9, 9.0, "x"), (None, "one two", None, 9, 9.0, "x"), (3, "b " * 4, "a", 9, 9.0, "x"), (3, "b " * 4, "a", 9, 9.0, "x")]
    docs = spark.createDataFrame(rows, schema)
    out = fair_queue(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter({(1, 0): 1, (2, 0): 1, (None, 2): 1, (3, 4): 2})
    assert all(r["taken"] == 0 for r in out if r["size"] == 0)
    mixed = mix_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["copies"] for r in out)
    assert fair_queue(docs.limit(0)).count() == 0 and mix_documents(docs.limit(0)).count() == 0


def test_where_buckets_end_changes_no_take(spark, monkeypatch):
    """A bucket for all late entries bounds the buckets that one task sums; the cut may even lie in it."""
    docs, taken = rows_of(spark, {"a": 6000, "b": 20, "c": 3000, None: 700}), []
    for far in (1e9, 2.0, 0.01):
        monkeypatch.setattr(mixing, "FAR", far)
        taken.append(sorted((r["doc_id"], r["taken"]) for r in fair_queue(docs).collect()))
    assert taken[0] == taken[1] == taken[2] and any(t for _, t in taken[0])


def test_late_entries_are_one_bucket(spark):
    finish = [k / 10 for k in range(1, 400)]
    entries = spark.createDataFrame([(1, (f,)) for f in finish], "size long, at struct<finish double>")
    sources = spark.createDataFrame([(399, 399)], "source_size long, n long")
    assert mixing._bucketed(entries, 19).select("bucket").distinct().count() <= 2 * 19 + 1
    assert mixing._cut(entries, sources, 100.0)["finish"] == 10.0
