import random
import re
from collections import Counter, defaultdict

import pytest

from plurality.llm import divergence


def brute(rows, least, top):
    counts, docs, groups = Counter(), Counter(), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        counts.update((lang, source, w) for w in found)
        docs.update((lang, w) for w in set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(w for (own, w), n in docs.items() if own == lang and n >= least)
        sources = sorted(s for own, s in groups if own == lang)
        share = lambda n: {w: 1 + 10**9 * (n[w] + 5) // (sum(n.values()) + 5 * len(kept)) for w in kept}
        n = {s: {w: counts[lang, s, w] for w in kept} for s in sources}
        p, whole = {s: share(n[s]) for s in sources}, defaultdict(int)
        for s in sources:
            for w in kept:
                whole[w] += n[s][w]
        q = share(whole)
        for s in sources:
            pairs = sorted((-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode()) for o in sources if o != s)
            terms = sorted((q[w] - p[s][w], w.encode()) for w in kept if n[s][w] and p[s][w] > q[w])[:top]
            out += [(lang, s, part, i.decode(), -v, k) for part, own in (("pair", pairs), ("term", terms)) for k, (v, i) in enumerate(own, 1)]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"terms": 7, "groups": 1, "lap": 3}, {"terms": 1000, "groups": 2, "lap": 1}])
def test_equals_all_pairs(spark, options):
    rng = random.Random(5)
    words = ["Stone", "river", "über", "naïve", "日本", "ÀB", "x", *[f"term{'abcdefghij'[i]}" for i in range(10)]]
    rows = [(rng.choice(["en", "en", "en", None, "fr"]), rng.choice([None, *[f"s{i}" for i in range(11)]]), " ".join(rng.choices(words, k=rng.randint(0, 30)))) for _ in range(160)]
    rows += [("en", "silent", "123 ?"), ("en", "silent", None), ("xx", "a", ""), ("xx", "b", "once"), ("yy", None, None), ("en", "é", "stone " * 4000)]
    rows += [("en", "hot", "river x") for _ in range(80)]
    docs = spark.createDataFrame([(i, *r, "clash") for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, item string").repartition(3)
    found = divergence.divergence(docs, least_docs=6, top=4, **options)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, 6, 4)


def test_counts_beyond_64_bits_and_an_empty_table(spark):
    from pyspark.sql import functions as F

    n = spark.createDataFrame([(10**13, 3 * 10**13, 7)], "n long, all long, v long")
    assert n.select(divergence._share(F.col("n"), F.col("all"), F.col("v"))).first()[0] == 1 + 10**9 * (10**13 + 5) // (3 * 10**13 + 35)
    assert divergence.divergence(spark.createDataFrame([], "doc_id long, lang string, source string, text string")).count() == 0


def test_every_two_blocks_meet_once(spark):
    for blocks in (2, 4, 6, 10):
        cells = spark.createDataFrame([(b, blocks) for b in range(blocks)], "b int, blocks int")
        met = [frozenset((r.b, r.home_block)) for r in divergence._rounds(cells, range(blocks - 1)).collect()]
        assert len(met) == len(set(met)) == blocks * (blocks - 1) // 2


def test_counts_take_terms_as_the_pattern_does_in_few_rows():
    import pyarrow as pa

    every = "".join(map(chr, range(0x250))) + "a\u00a0b\u2003c\u3000d A-Z zz"
    texts = [every, "x" * 3 + " Y", "", *[f"term{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(9000)] * 2]
    own = pa.record_batch([pa.array(["l"] * len(texts)), pa.array(["s"] * len(texts)), pa.array(texts)], ["lang", "source", "text"])
    got = pa.Table.from_batches(divergence._counts([own])).to_pylist()
    want = Counter(w for t in texts for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)))
    assert {r["term"]: r["n"] for r in got if r["term"] is not None} == want and len(got) == len(want) + 1
