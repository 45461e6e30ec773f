"""Null, shared and repeated ids: what an operator counts and links is the rows and texts, ids only name them."""

import random
from collections import Counter, defaultdict

from plurality.llm import lattice, line_quality, mixing, simhash


def test_vectors_link_by_vector_whatever_their_ids(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.99, 0.01, 0.0]), (3, [0.01, 0.99, 0.0]), (4, [0.0, 0.98, 0.0])]
    rows += [(None, [1.0, 0.0, 0.0])] * 2 + [(None, [0.0, 0.0, 1.0])]
    got = lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    have = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got)
    assert have == {
        (1, 3, 1, True): 1, (1, 2, 1, True): 1, (2, 3, 1, False): 1, (3, 2, 1, False): 1, (4, 2, 1, False): 1,
        (None, 3, 1, False): 2, (None, 0, None, False): 1,
    }


def test_fingerprints_without_an_id_carry_links(spark):
    rng = random.Random(11)
    word = lambda: f"word{rng.randint(0, 400)}"
    texts = []
    for _ in range(12):
        words = [word() for _ in range(120)]
        for _ in range(12):
            words[rng.randrange(len(words))] = word()
            texts.append(" ".join(words))
    ids = [i + 1 if i % 3 else None for i in range(len(texts))]
    rows = [(i, t, "x", 5) for i, t in zip(ids, texts, strict=True)] + [(None, texts[1], "x", 5), (None, "alone without an id", "x", 5), (900, "long " * 60_000, "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id long")
    fps = [simhash.fingerprint(t.encode()) for _, t, *_ in rows]

    def classes(at):
        forest = simhash.Forest(len(rows))
        for a in at:
            for b in at:
                if a < b and (fps[a] ^ fps[b]).bit_count() <= 4:
                    forest.join(a, b)
        members = defaultdict(list)
        for a in at:
            members[forest.find(a)].append(a)
        smallest = {k: min((rows[a][0] for a in m if rows[a][0] is not None), default=None) for k, m in members.items()}
        return {a: smallest[forest.find(a)] for a in at}

    want = classes(range(len(rows)))
    named = classes([a for a in range(len(rows)) if rows[a][0] is not None])
    assert any(want[a] != c for a, c in named.items())  # some are linked through rows without an id alone
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == Counter((rows[a][0], f"{fps[a]:016x}", c) for a, c in want.items())
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_lines_count_documents_and_not_rows(spark):
    spell = lambda n: "".join(chr(97 + int(c)) for c in str(n))
    words = lambda n: " ".join(f"w{spell(n)}x{spell(k)}" for k in range(30))
    rows = [(1, "An own line of seven words here\n" + words(1), "a")] * 25 + [(10 + i, words(10 + i), "a") for i in range(5)]
    rows += [(100 + i % 21, f"Shared by enough documents\n{words(100 + i)}", "b") for i in range(42)]
    rows += [(200 + i % 20, f"Shared by one too few\n{words(200 + i)}", "b") for i in range(40)]
    rows += [(None, f"Nobody knows the id\n{words(300 + i)}", "c") for i in range(21)]
    rows += [(None, f"Nobody knows these either\nNobody knows these either\n{words(400 + i)}", "c") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    documents = defaultdict(set)
    for at, (i, text, source) in enumerate(rows):
        for line in text.lower().split("\n"):
            documents[source, line].add(i if i is not None else f"row {at}")
    hosts = Counter(s for *_, s in rows)
    frequent = {k for k, d in documents.items() if len(d) > 20 and len(d) * 50 > hosts[k[0]]}
    assert len(frequent) == 2
    want = Counter((i, sum(len(x.split()) for x in t.lower().split("\n") if (s, x) in frequent)) for i, t, s in rows)
    assert Counter((r["doc_id"], r["removed_words"]) for r in line_quality.line_quality(docs).collect()) == want
    cut = Counter((i, "\n".join(x for x in t.split("\n") if (s, x.lower()) not in frequent)) for i, t, s in rows)
    assert Counter((r["doc_id"], r["text"]) for r in line_quality.without_boilerplate(docs).collect()) == cut


def test_mix_meets_targets_with_null_and_shared_ids(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 7)  # equal rows in many chunks
    rng = random.Random(2)
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, "w " * rng.randint(1, 12) + str(k), "abc"[k % 3 if k % 2 else 0], k) for k in range(1500)]
    rows += [(7, "one and the same text", "b", k) for k in range(300)] + [(None, "another text", "c", 0)] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    first, second = (sorted((r["doc_id"] or 0, r["source"], r["size"], r["taken"], r["target"]) for r in mixing.fair_queue(docs).collect()) for _ in range(2))
    assert first == second and len(first) == len(rows)
    taken, target = defaultdict(int), {}
    for _, source, _, t, goal in first:
        taken[source] += t
        target[source] = goal
    assert all(abs(taken[s] - target[s]) <= 30 for s in target)
    mixed = Counter(tuple(r) for r in mixing.mix_documents(docs).collect())
    assert all(n <= 3 * rows.count(r) for r, n in mixed.items()) and set(mixed) <= set(rows)
    words = defaultdict(int)
    for (_, text, source, _), n in mixed.items():
        words[source] += n * len(text.split())
    assert words == taken
