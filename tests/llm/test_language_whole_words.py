import numpy as np

from plurality.llm import language


def log_total(word, names, logp, k):
    """Log of the sum over all segmentations, by plain recursion on prefixes."""
    logs = [0.0]
    for end in range(1, len(word) + 1):
        terms = [logs[s] + (logp[names.index(word[s:end]), k] if word[s:end] in names else logp[-1, k]) for s in range(end) if word[s:end] in names or end - s == 1]
        logs.append(float(np.logaddexp.reduce(terms)))
    return logs


def make():
    names = sorted(["a", "b", "c", "ab", "bca", "abcabc", "cababcabcaba"])
    return names, language.Pieces(names), np.log(np.random.default_rng(0).dirichlet(np.ones(len(names) + 1), size=2).T) - 8


def test_vocabulary_is_whole():
    names = language.vocabulary()
    assert max(map(len, names)) == 16 and len(names) == 20231


def test_long_pieces_and_long_words_are_summed_whole():
    names, pieces, logp = make()
    words = ["cababcabcaba", "abcabc" * 3, "cabzabc" * 12, "abc" * 400]  # above and below LONG, far below the least double
    got = language.word_scores(words, pieces, logp)
    assert np.allclose(got, [[log_total(w, names, logp, k)[-1] for k in range(2)] for w in words], rtol=1e-10)
    assert language._letters("x" * 100 + "1y") == ["x" * 100, "y"]


def test_expected_counts_of_long_words():
    names, pieces, logp = make()
    word, p = "abcabcz" * 6, np.exp(logp[:, 0])
    before, after = log_total(word, names, logp, 0), log_total(word[::-1], [n[::-1] for n in names], logp, 0)[::-1]
    want = np.zeros(pieces.n)
    for s in range(len(word)):
        for e in range(s + 1, len(word) + 1):
            if word[s:e] in names or e - s == 1:
                i = names.index(word[s:e]) if word[s:e] in names else pieces.n - 1
                want[i] += np.exp(before[s] + logp[i, 0] + after[e] - before[-1])
    assert np.allclose(language.expected_counts([word], np.ones(1), pieces, p), want)
    assert np.allclose(language.expected_counts([word[:21]] * 2, np.ones(2), pieces, p), 2 * language.expected_counts([word[:21]], np.ones(1), pieces, p))


def test_without_labels_texts_with_a_letter_stay(spark):
    rows = [(1, "some words here", None), (2, "123 !!", None), (3, None, None), (4, "汉字", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in language.accept_language(docs).collect()) == [1, 4]
    assert language.accept_language(docs, ["en"]).count() == 0
