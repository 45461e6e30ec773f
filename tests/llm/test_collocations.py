import random
import re
from collections import Counter

from plurality.llm import collocations


def brute(rows, least, top):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            counts.update((lang, tuple(w[i : i + m])) for m in range(1, 6) for i in range(len(w) - m + 1))
    frequent = {k: n for k, n in counts.items() if n >= least}
    covered = {}
    for (lang, p), n in frequent.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                covered[lang, p[i : i + m]] = max(n, covered.get((lang, p[i : i + m]), 0))
    out = {}
    for (lang, p), a in frequent.items():
        if len(p) > 1 and covered.get((lang, p), 0) < a:
            s, k = min((1000 * a * totals[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-s, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]], totals[lang]))
    return sorted((lang, i, p.decode(), -a, left, r, n, -s) for lang, rows in out.items() for i, (s, a, p, left, r, n) in enumerate(sorted(rows)[:top], 1))


def check(spark, rows, least, top=2000, **options):
    docs = spark.createDataFrame([(i, lang, text, "x") for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, phrase string").repartition(3)
    found = collocations.collocations(docs, least=least, top=top, **options)
    assert found.columns == ["lang", "phrase", "a", "l", "r", "n", "score", "rank"]
    got = sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found.collect())
    assert got == brute(rows, least, top)
    return got


def text(rng, words, n):
    return "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", " "]) for _ in range(n))


def test_equals_counting_everything(spark):
    rng = random.Random(3)
    words = ["New", "york", "é́", "ÀB", "a-b", "x\xa0y", "of", "the", "'s", "#", "🙂"]
    rows = [(rng.choice(["en", "fr", None, "und"]), text(rng, words[: rng.randint(3, 11)], rng.randint(0, 120))) for _ in range(150)]
    rows += [("en", None), ("en", ""), (None, None), ("fr", " \t\n.,;"), ("en", "A a A a A a A a a")] + [("en", "one two three four five six")] * 12
    assert len(check(spark, rows, 5)) > 100
    # Bitmaps that are far too small let more through and change nothing.
    check(spark, rows, 5, top=7, bits=4)
    check(spark, [("en", None)], 1)
    assert check(spark, rows[:3], 10_000) == []


def test_a_text_longer_than_a_slice(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    long = " ".join(rng.choices(words, k=1_500_000))
    assert len(long) > collocations.SLICE
    check(spark, [("en", long), ("en", "w1 w2 w3. w1 w2 w3"), ("de", "w1 " * 50)], 1500)


def test_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert collocations.collocations(docs).count() == 0


def test_texts_wait_over_batches_in_bounded_memory():
    """Slices do not end with a batch, so small batches count a phrase no more often; some bytes wait at most."""
    import pyarrow as pa

    texts = [(lang, f"{lang} text {i}") for i in range(600) for lang in ("a", "b")]
    batches = [pa.record_batch([pa.array([x for x, _ in texts[i : i + 10]]), pa.array([t for _, t in texts[i : i + 10]])], ["lang", "text"]) for i in range(0, 1200, 10)]
    found = list(collocations._slices(batches, 1))
    assert sorted(lang for lang, *_ in found) == ["a", "b"]
    assert sum(w != b"." for _, words, _ in found for w in words) == 3 * 1200
