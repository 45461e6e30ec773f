"""run() against plain Python: every stage done again on a small corpus, without Spark."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
from test_mixing import filled
from test_near_copies import brute_kept
from test_text_operators import brute_spans

import corpus_pipeline
from plurality.llm import bpe, language

SPEECH = {"en": "the ing ion er wh th ou".split(), "de": "ung sch ver keit ei ch zu".split(), "es": "cion ado que el los ar ña".split()}


def make_rows():
    rng, rows = random.Random(21), []
    prose = lambda lang, n: ["".join(rng.choice(SPEECH[lang]) for _ in range(rng.randint(2, 4))) for _ in range(n)]
    for i in range(180):
        lang, source = rng.choice("en en de es".split()), rng.choice(["web", "web", "books", None, "code"])
        words = prose(lang, rng.randint(12, 80))
        if i % 9 == 0:
            words.insert(5, rng.choice(["token=abcdef12345", "api_key: 'hunter2hunter'", "password = token:abcdefgh"]))
        rows.append((i, " ".join(words), lang if i % 4 else None, source))
    for k in range(60):  # near copies: few words of a long document changed
        _, text, lang, source = rows[k]
        words = text.split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = prose(lang or "en", 1)[0]
        rows.append((1000 + k, " ".join(words), lang, source))
    return rows + [(2000, None, "en", "web"), (2001, "", "en", "web"), (2002, "123 !!", "en", "web"), (2003, " \n", None, None)]


def redacted(text):
    spans, out, at = sorted(tuple(map(int, x.split(":")[1:])) for x in brute_spans(text).split(",") if x), "", 0
    for s, e in spans:
        if s >= at:
            out += text[at:s] + "[SECRET]"
        at = max(at, e)
    return out + text[at:]


def mixed(rows):
    """Copies of each row: queues by hash of the id, merged by finish time, cut at all words."""
    size = {i: len(t.split()) for i, t, _ in rows}
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i, _, x in rows if x == s) for s in sources}
    target = dict(zip(sources, filled([total[s] for s in sources], [k % 3 + 1 for k in range(len(sources))], sum(size.values())), strict=True))
    h, entries = {i: hashlib.md5(f"7:{i}".encode()).hexdigest() for i in size}, []
    for sid, s in enumerate(sources):
        upto = 0
        for i in sorted((i for i, _, x in rows if x == s), key=lambda i: (h[i], i)):
            upto += size[i]
            entries += [((upto + e * total[s]) / round(target[s], 6), sid, e, h[i], i) for e in range(3)]
    copies, words = Counter(), 0
    for *_, i in sorted(entries):
        words += size[i]
        if words > sum(size.values()):
            break
        copies[i] += 1
    return copies


def test_run_equals_plain_python(spark, tmp_path):
    import public_tokenizers
    import tiktoken

    rows = make_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.selectExpr("*", "cast(length(text) as int) AS n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    told = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    kept = brute_kept([(i, t) for i, t, *_ in told])
    assert 150 < len(kept) < len(told) - 20
    clean = [(i, redacted(t), s) for i, t, _, s in told if i in kept]
    assert sum("[SECRET]" in t for _, t, _ in clean) > 10
    copies, text_of = mixed(clean), {i: t for i, t, _ in clean}
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.RANKS))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, n in copies.items():
        ids = own.encode_ordinary(text_of[i])
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text_of[i].encode()).hexdigest()] = n
    assert max(copies.values()) > 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want


def test_a_language_floor_drops_what_scores_below_it(spark):
    docs = spark.createDataFrame(make_rows() + [(3000, "zu que", None, None), (3001, "x", None, None)], "doc_id long, text string, lang string, source string")
    score = {r["doc_id"]: r["score"] for r in language.identify(docs).collect() if r["lang_pred"] != "und"}
    floors = defaultdict(set)
    for floor in (0.5, 0.9, max(score.values())):
        floors[floor] = {r["doc_id"] for r in language.accept_language(docs, min_score=floor).collect()}
        assert floors[floor] == {i for i, p in score.items() if p >= floor}
    assert len(floors[0.5]) > len(floors[max(score.values())])
