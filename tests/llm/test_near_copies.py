import random

import corpus_pipeline
from plurality.llm import near_copies, simhash


def brute_set(text):
    words = (text or "").encode().lower().split()
    width = min(5, len(words))
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def similar(a, b):
    return a == b or len(a & b) * 5 >= len(a | b) * 4 and bool(a)


def brute_kept(rows):
    """Ids that stay: the smallest of each group linked by similarity 0.8 or more."""
    ids = sorted(i for i, _ in rows)
    sets = {i: brute_set(t) for i, t in rows}
    forest = simhash.Forest(len(ids))
    for x in range(len(ids)):
        for y in range(x):
            if similar(sets[ids[x]], sets[ids[y]]):
                forest.join(x, y)
    return {i for k, i in enumerate(ids) if forest.find(k) == k}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randint(0, 999)}"
    return " ".join(words)


def make_rows(seed):
    rng = random.Random(seed)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(100, 400))] for _ in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    rows += [(100 + k, edited(rng, base[k % 40], rng.randint(1, 8))) for k in range(200)]
    # A large group of near copies, short texts, and texts without a word.
    rows += [(1000 + k, edited(rng, base[0], rng.randint(1, 7))) for k in range(150)]
    return rows + [(5000, "one two"), (5001, "ONE  two"), (5002, "one two three"), (5003, ""), (5004, " \n")]


def test_stage_drops_what_brute_force_at_similarity_drops(spark):
    rows = make_rows(11)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == brute_kept(rows)
    # What the stage did before misses copies of these rows.
    assert simhash.near_duplicates(docs).filter("doc_id = component_id").count() > len(kept)


def test_centres_and_single_pairs_give_the_same(spark, monkeypatch):
    rows = make_rows(12)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near_copies, "FEW_PAIRS", 0)
    kept = {r["doc_id"] for r in near_copies.keep_one(docs).collect()}
    assert kept == brute_kept(rows)


def test_edges(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # One row of each group: of equal rows one, and null ids stand after all others.
    assert sorted((r["doc_id"] or 0) for r in near_copies.keep_one(docs).collect()) == [1, 2]
    assert {tuple(r) for r in near_copies.near_copies(docs).collect()} == {(None, 1), (1, 1), (2, 2), (3, 2)}
    assert near_copies.keep_one(docs.limit(0)).count() == 0


def test_one_id_on_several_texts_loses_none(spark):
    """A row goes by its own group alone, and columns of the operator's names do no harm."""
    rows = [(1, "a b c d e f", 0, 0), (7, "a b c d e f", 1, 1), (7, "some other text of its own here", 2, 2), (7, "some other text of its own here", 2, 2), (None, "no id but text", 3, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, th long, k long")
    assert sorted((r["doc_id"] or 0, r["th"]) for r in near_copies.keep_one(docs).collect()) == [(0, 3), (1, 0), (7, 2)]


def test_a_crowded_group_loses_no_link(spark, monkeypatch):
    """Copies of one text with 0 to 15% of their words changed: the last comparison seeks by the prefix filter."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for k in range(140):
        words, share = list(base), rng.choice([0, 0.005, 0.01, 0.02, 0.03, 0.04])
        for i in range(150):
            if rng.random() < share:
                words[i] = f"x{k}-{i}"
        texts.append(" ".join(words[: rng.choice([150, 150, 140, 130])]))
    texts = sorted(set(texts))
    used = []
    real = near_copies._apart
    monkeypatch.setattr(near_copies, "_apart", lambda *a: used.append(1) or real(*a))
    monkeypatch.setattr(near_copies, "FEW_PAIRS", 0)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    sets = [set(near_copies.shingles(t.encode()).tolist()) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    assert got == {i: top(i) for i in range(len(texts))} and len(set(got.values())) > 3 and used


def test_the_pigeonhole_index_ties_copies_that_share_no_band(spark):
    rng = random.Random(4)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(300)] for _ in range(20)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)] + [(100 + i, edited(rng, w, 1)) for i, w in enumerate(base)]
    texts = spark.createDataFrame(rows, "doc long, text string").selectExpr("doc", "text", "xxhash64(text) AS th")
    sketches = texts.mapInArrow(near_copies._sketches, "doc long, th long, k long, size int, bands array<long>, fp long")
    k = {r.doc: r.k for r in sketches.collect()}
    found = {frozenset(r) for r in near_copies.links(sketches.selectExpr("doc", "th", "k", "size", "array(k) AS bands", "fp"), texts).collect()}
    sets = {k[i]: brute_set(t) for i, t in rows}
    assert all(similar(*(sets[x] for x in pair)) for pair in found)
    fps = {r.doc: r.fp & (2**64 - 1) for r in sketches.collect()}
    close = {frozenset((k[i], k[100 + i])) for i in range(20) if (fps[i] ^ fps[100 + i]).bit_count() <= simhash.DISTANCE}
    assert len(close) > 10 and close <= found


def test_only_crowded_buckets_write_their_shingles_out(spark, monkeypatch):
    """Pairs of small buckets are compared as they are: what is written out does not grow with them, and no link is lost."""
    rng = random.Random(9)
    crowded = [edited(rng, [f"w{i}" for i in range(150)], rng.choice([1, 2, 4, 6, 8, 10])) for _ in range(60)]
    small = []
    for g in range(50):
        base = [f"g{g}-{i}" for i in range(150)]
        small += [" ".join(base), edited(rng, base, 3), edited(rng, base, 6)]
    real, keys = near_copies._often, set()
    monkeypatch.setattr(near_copies, "_often", lambda rows, sets: keys.update(r.k for r in rows.select("k").distinct().collect()) or real(rows, sets))
    monkeypatch.setattr(near_copies, "FEW_PAIRS", 0)
    monkeypatch.setattr(simhash, "links", lambda unique, *a: unique.selectExpr("id AS a", "id AS b").limit(0))  # bands alone: more is left open
    rows = list(enumerate(crowded + small))
    kept = {r.doc_id for r in near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == brute_kept(rows) and len(kept) > 60
    assert keys and keys <= set(near_copies._signed([near_copies._key(near_copies.shingles(t.encode())) for t in crowded]).tolist())
