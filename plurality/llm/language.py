"""Language identification by segmentation-marginalised unigrams.

Pieces come from a public vocabulary that is never trained; each language has a probability for each
piece. A word's likelihood is the sum over all its segmentations into pieces of the product of their
probabilities, which a forward pass over the word's characters gives exactly; a text's likelihood is the
product over its words. Piece probabilities are fitted by one expectation step (forward and backward
passes with all pieces of a length equally likely) and smoothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plurality.llm.common import table, text_or_empty

#: Documents of each language the model is fitted on (smallest hashes of their ids), about.
TRAIN_DOCS = 1500
#: Words longer than this are scored with rescaled sums, which cannot underflow; rescaled every so many characters.
LONG, RESCALE = 24, 8
SMOOTHING = 0.1
UNDETERMINED = "und"
VOCABULARY = "piece_bpe_32k.model"
_STEP = 4_000_000  # characters scored at a time in a task
_BASE = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(path: str | None = None) -> list[str]:
    """Letter pieces, in lower case, of a public piece file.

    Every single letter is added when it is met, under one shared entry, so each word has a segmentation.
    """
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
    pieces = {model.id_to_piece(i).lstrip("▁").lower() for i in range(model.get_piece_size())}
    return sorted(p for p in pieces if p.isalpha())


def _codes(words: list[str], width: int) -> np.ndarray:
    joined = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return joined.reshape(len(words), width)


def _hashes(codes: np.ndarray, longest: int):
    """(size, hashes of all runs of ``size`` characters: (words, width - size + 1)) for each size up to ``longest``."""
    codes = codes.astype(np.uint64)
    width = codes.shape[1]
    h = np.zeros(codes.shape, np.uint64)
    for size in range(1, min(longest, width) + 1):
        h = (h[:, : width - size + 1] ^ codes[:, size - 1 :]) * _BASE
        h ^= h >> np.uint64(29)
        yield size, h


class Pieces:
    """Looks up runs of characters in the vocabulary; the last place stands for any other single letter."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces) + 1
        self.tables = {}
        self.longest = max(map(len, pieces), default=1)
        for size in range(1, self.longest + 1):
            at = np.array([i for i, p in enumerate(pieces) if len(p) == size], np.int64)
            if len(at):
                *_, (_, h) = _hashes(_codes([pieces[i] for i in at], size), size)
                order = np.argsort(h[:, 0])
                self.tables[size] = (h[order, 0], at[order])

    def find(self, codes: np.ndarray) -> dict[int, np.ndarray]:
        """For each size that occurs: the place of each run of so many characters, or -1."""
        out = {}
        for size, h in _hashes(codes, self.longest):
            found = np.full(h.shape, -1)
            if size in self.tables:
                known, at = self.tables[size]
                i = np.minimum(np.searchsorted(known, h), len(known) - 1)
                found = np.where(known[i] == h, at[i], -1)
            if size == 1:
                found = np.where(found < 0, self.n - 1, found)
            if (found >= 0).any():
                out[size] = found
        return out


def _log_sums(found: dict[int, np.ndarray], p: np.ndarray, width: int) -> np.ndarray:
    """Logs of the forward sums at each place of words of any length: (width + 1, words, ...).

    Sums that later ones are made from are divided by the newest every ``RESCALE`` characters.
    """
    one = p[found[1][:, 0]]
    sums, logs, shift = np.zeros((width + 1, *one.shape)), np.zeros((width + 1, *one.shape)), np.zeros(one.shape)
    sums[0] = 1.0
    reach = max(found)
    for end in range(1, width + 1):
        for size, x in found.items():
            if size <= end:
                sums[end] += sums[end - size] * p[x[:, end - size]]
        logs[end] = np.log(sums[end]) + shift
        if end % RESCALE == 0:
            shift = logs[end].copy()
            sums[max(0, end - reach + 1) : end + 1] /= sums[end].copy()
    return logs


def word_scores(words: list[str], pieces: Pieces, logp: np.ndarray) -> np.ndarray:
    """Log likelihood of each word under each language, all segmentations summed: (words, languages)."""
    out = np.zeros((len(words), logp.shape[1]))
    p = np.vstack([np.exp(logp), np.zeros(logp.shape[1])])  # place -1: no piece
    for width, at in _by_length(words):
        codes = _codes([words[i] for i in at], width)
        found = pieces.find(codes)
        if width > LONG:
            out[at] = _log_sums(found, p, width)[width]
            continue
        alpha = np.zeros((width + 1, len(at), logp.shape[1]))
        alpha[0] = 1.0
        for end in range(1, width + 1):
            for size, x in found.items():
                if size <= end:
                    alpha[end] += alpha[end - size] * p[x[:, end - size]]
        out[at] = np.log(alpha[width])
    return out


def expected_counts(words: list[str], counts: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations of the words, weighted by ``counts``."""
    total = np.zeros(pieces.n)
    p = np.append(p, 0.0)
    for width, at in _by_length(words):
        codes = _codes([words[i] for i in at], width)
        found = pieces.find(codes)
        if width > LONG:
            before, after = _log_sums(found, p, width), _log_sums({size: x[:, ::-1] for size, x in found.items()}, p, width)[::-1]
            for size, x in found.items():
                for start in range(width - size + 1):
                    used = p[x[:, start]] * np.exp(before[start] + after[start + size] - before[width]) * counts[at]
                    total += np.bincount(np.where(x[:, start] < 0, pieces.n, x[:, start]), used, minlength=pieces.n + 1)[: pieces.n]
            continue
        alpha, beta = np.zeros((width + 1, len(at))), np.zeros((width + 1, len(at)))
        alpha[0] = beta[width] = 1.0
        for end in range(1, width + 1):
            for size, x in found.items():
                if size <= end:
                    alpha[end] += alpha[end - size] * p[x[:, end - size]]
        for start in range(width - 1, -1, -1):
            for size, x in found.items():
                if start + size <= width:
                    beta[start] += p[x[:, start]] * beta[start + size]
        weight = counts[at] / alpha[width]
        for size, x in found.items():
            for start in range(width - size + 1):
                used = alpha[start] * p[x[:, start]] * beta[start + size] * weight
                total += np.bincount(np.where(x[:, start] < 0, pieces.n, x[:, start]), used, minlength=pieces.n + 1)[: pieces.n]
    return total


def _by_length(words: list[str]):
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        if len(at):
            width = int(lengths[at[0]])
            most = 20_000 if width <= LONG else max(1, 20_000 * LONG // width)
            for part in np.array_split(at, -(-len(at) // most)):
                yield width, part


def _letters(token: str) -> list[str]:
    """The letter runs of a token in lower case, whole."""
    return "".join(c if c.isalpha() else " " for c in token).split()


def _tokens(texts):
    """Arrow's blank-separated tokens of lower-cased texts: (document of each token, its place, distinct tokens)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    split = pc.utf8_split_whitespace(pc.utf8_lower(texts.cast(pa.large_string())))
    coded = pc.dictionary_encode(split.flatten())
    owner = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    return owner, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def _expand(distinct: list[str]):
    """Letter words of the distinct tokens: (token of each, word)."""
    plain = {i for i, t in enumerate(distinct) if t.isalpha()}
    of, words = [], []
    for i, t in enumerate(distinct):
        for w in [t] if i in plain else _letters(t):
            of.append(i), words.append(w)
    return np.array(of, np.int64), words


def _slices(batch, column):
    """Parts of a batch of about ``_STEP`` bytes of text, whole rows each."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        base = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, base + _STEP, side="right")))
        yield batch.slice(start, end - start)
        start = end


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, train_docs: int) -> DataFrame:
    """(text, lang) of about ``train_docs`` labelled documents of each language that may be learned from.

    A document is taken if the hash of its id, as a fraction, is below train_docs over its language's
    documents; only one count for each language reaches the driver, and no task ranks a whole language.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    allowed = docs.filter(F.col(lang_col).isNotNull() & (F.crc32(key.cast("binary")) % 3 != 1))
    allowed = allowed.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.md5(key).alias("h"))
    shares = {row["lang"]: train_docs / row["count"] for row in allowed.groupBy("lang").count().collect()}
    if not shares:
        return allowed.select("text", "lang")
    share = F.create_map(*[F.lit(x) for pair in sorted(shares.items()) for x in pair])
    return allowed.filter(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / float(2**32) < F.element_at(share, F.col("lang"))).select("text", "lang")


def fit(docs: DataFrame, *, id_col="doc_id", text_col="text", lang_col="lang", train_docs=TRAIN_DOCS, path=None):
    """(languages, pieces, log probabilities: one row a piece, then one for other letters), from labelled documents outside the held-out third.

    What reaches the driver is bounded: one expected count for each language and piece of the vocabulary.
    """
    names = vocabulary(path)

    def count(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        pieces = Pieces(names)
        flat = _flat(pieces)
        for whole in batches:
            for batch in _slices(whole, 0):
                for lang in pc.unique(batch.column(1)).to_pylist():
                    own = batch.filter(pc.equal(batch.column(1), lang))
                    _, at, distinct = _tokens(pc.fill_null(own.column(0), ""))
                    of, words = _expand(distinct)
                    if not words:
                        continue
                    found = expected_counts(words, np.bincount(at, minlength=len(distinct))[of].astype(float), pieces, flat)
                    some = np.flatnonzero(found)
                    yield pa.record_batch([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(found[some])], ["lang", "piece", "n"])

    rows = training_rows(docs, id_col, text_col, lang_col, train_docs)
    counts = rows.mapInArrow(count, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    n = np.zeros((len(names) + 1, len(languages)))
    n[counts["piece"], counts["lang"].map({x: i for i, x in enumerate(languages)})] = counts["n"]
    n += SMOOTHING
    n[-1] = SMOOTHING * 0.1
    return languages, names, np.log(n / n.sum(0))


def _flat(pieces: Pieces) -> np.ndarray:
    """Start of the fit: pieces of s characters have the probability 2^-s of that length, shared equally."""
    p = np.full(pieces.n, 1e-6)
    for size, (_, at) in pieces.tables.items():
        p[at] = 2.0**-size / len(at)
    return p


def _scored(batch, column: int, pieces: Pieces, model):
    """(predicted language or ``und``, posterior) of every row of an Arrow batch."""
    import pyarrow.compute as pc

    languages, _, logp = model
    owner, at, distinct = _tokens(pc.fill_null(batch.column(column), ""))
    of, words = _expand(distinct)
    sums, seen = np.zeros((batch.num_rows, max(1, len(languages)))), np.zeros(batch.num_rows, bool)
    if words and languages:
        own, has = np.zeros((len(distinct), len(languages))), np.bincount(of, minlength=len(distinct)) > 0
        scores = word_scores(words, pieces, logp)
        for k in range(len(languages)):
            own[:, k] = np.bincount(of, scores[:, k], minlength=len(distinct))
            sums[:, k] = np.bincount(owner, own[at, k], minlength=batch.num_rows)
        seen = np.bincount(owner, has[at], minlength=batch.num_rows) > 0
    best = sums.argmax(1)
    posterior = 1 / np.exp(sums - sums[np.arange(len(best)), best][:, None]).sum(1)
    return [languages[b] if s else UNDETERMINED for b, s in zip(best, seen, strict=True)], np.where(seen, posterior, 0.0)


def predict(docs: DataFrame, model, *, id_col="doc_id", text_col="text") -> DataFrame:
    """``doc_id, lang_pred, score`` of each row; only the text is looked at.

    score is the posterior probability of the predicted language with equal priors. Null, empty and
    letterless texts are ``und`` with score 0, and so is everything if nothing was learned.
    """

    def score(batches):
        import pyarrow as pa

        pieces = Pieces(model[1])
        for whole in batches:
            for batch in _slices(whole, 1):
                named, posterior = _scored(batch, 1, pieces, model)
                yield pa.record_batch([batch.column(0), pa.array(named, pa.string()), pa.array(posterior)], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, lang_pred string, score double")


def held_out(name: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def identify(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row of ``docs`` by a model fitted on its labelled part.

    Null languages are not learned from; null ids count as the empty string for the split. Repeated rows
    are predicted alike. An empty table gives no rows. Only the named columns are read.
    """
    columns = {k: v for k, v in options.items() if k in ("id_col", "text_col")}
    return predict(docs, fit(docs, **options), **columns).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def accept_language(docs: DataFrame, accepted=None, *, text_col="text", min_score=0.0, **options) -> DataFrame:
    """The rows of ``docs`` predicted as one of ``accepted`` (default: any learned language), whole and as they were.

    ``und`` texts go. Rows are judged where they stand: no shuffle, no join by id. If nothing could be learned
    and no languages are named, every text with a letter stays.
    """
    model = fit(docs, text_col=text_col, **options)
    if not model[0] and accepted is None:
        return docs.filter(F.col(text_col).rlike(r"\p{L}"))
    keep = set(model[0] if accepted is None else accepted)
    column = docs.columns.index(text_col)

    def chosen(batches):
        import pyarrow as pa

        pieces = Pieces(model[1])
        for whole in batches:
            for batch in _slices(whole, column):
                named, posterior = _scored(batch, column, pieces, model)
                yield batch.filter(pa.array([x in keep and p >= min_score for x, p in zip(named, posterior, strict=True)]))

    return docs.mapInArrow(chosen, docs.schema)


def op5_segmentation_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
