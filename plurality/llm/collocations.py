"""Phrase collocation mining: frequent word sequences of each language, scored by their weakest cut.

Levels go from single words to ``MOST`` words, one pass over the texts each. A pass counts its candidates exactly and,
beside them, the next length's sequences in hashed buckets (PCY; at every level, as in DHP). The next pass looks at a
sequence only if its bucket and the bits of both its parts one word shorter (Apriori) are frequent. Both tests are
bitmaps of at most 2^``MOST_BITS`` bits, so what is broadcast has a fixed bound; they may let too much through, never
too little, and the exact counts decide. Sequences are counted in each slice of text by dense numbers built level by
level, so no hash decides what is the same phrase.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plurality.llm.common import discard, materialize, short_batches, table, text_or_empty

LEAST, MOST, TOP, SEED = 100, 5, 2000, 42
#: Bits of a bitmap: about one for eight words, within these bounds. Bytes of text that are counted at a time,
#: and that wait for that in a task; texts taken from a batch at once.
LEAST_BITS, MOST_BITS, SLICE, HELD, FEW = 16, 26, 3 << 20, 20 << 20, 256
_GROUP = 1 << 15  # bits of one row of Spark's bitmap aggregate

#: Bytes that end a piece read as one of them; blanks part words.
_ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b".......... ")
_END = b"."


def _words(text: bytes) -> list[bytes]:
    """Lower-case words in order, with ``_END`` where a piece ends."""
    return text.lower().translate(_ENDS).replace(_END, b" . ").split()


class _Numbers(dict):
    """A number for each distinct word of a slice; 0 is the end of a piece."""

    def __missing__(self, word):
        self[word] = found = len(self)
        return found


def _slices(batches, carry: int):
    """(lang, words, fresh): up to about ``SLICE`` bytes of a language's texts; ``fresh`` is 0 where the words begin
    a text, else the number of words at the start that the slice before has had. Texts wait over batches, ``HELD`` bytes
    of all languages at most."""
    import pyarrow as pa

    held: dict[str, list[bytes]] = {}
    sizes: Counter = Counter()
    for batch in (whole.slice(at, FEW) for whole in batches for at in range(0, whole.num_rows, FEW)):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            if len(text) > SLICE:
                at, last = 0, []
                while at < len(text):
                    end = text.find(b" ", at + SLICE)
                    end = len(text) if end < 0 else end
                    words = _words(text[at:end])
                    yield lang, last + words, len(last)
                    last, at = (last + words)[-carry:], end
                continue
            held.setdefault(lang, []).append(text)
            sizes[lang] += len(text)
            if sizes[lang] > SLICE:
                del sizes[lang]
                yield lang, _words(_END.join(held.pop(lang))), 0
        if sizes.total() > HELD:
            sizes.clear()
            while held:
                lang, texts = held.popitem()
                yield lang, _words(_END.join(texts)), 0
    while held:
        lang, texts = held.popitem()
        yield lang, _words(_END.join(texts)), 0


def _dense(codes: np.ndarray) -> tuple[np.ndarray, int]:
    import pandas as pd

    numbers, found = pd.factorize(codes)
    return numbers.astype(np.int64), len(found)


def _hashes(lang: str, words: list[bytes]) -> np.ndarray:
    import xxhash

    seed = xxhash.xxh32_intdigest(lang.encode(), SEED)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of sequences from those of all but their last word and of that word."""
    mixed = (left ^ left >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + right
    return (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)


def _hit(bitmap: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - bits)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _pass(level: int, bits: int, shared, ahead: bool):
    """Counts the sequences of ``level`` words that the bitmaps let through, and buckets of those one word longer.

    Rows ``(lang, phrase, hash, n)``; bucket counts have a null phrase and the bucket's number as hash.
    """

    def run(batches):
        import pyarrow as pa

        maps = {k: np.frombuffer(v, np.uint8) for k, v in shared.value.items()} if shared else {}
        for lang, words, carried in _slices(batches, level):
            if not words:
                continue
            known = _Numbers({_END: 0})
            ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            names, words = list(known), None
            hashes, word = _hashes(lang, names)[ids], ids != 0
            # Level by level: number and hash of the sequence that starts at each place, and whether it is one.
            codes, size, grams, inside, shorter = ids, len(names), hashes, word, None
            for _ in range(level - 1):
                shorter = grams
                codes, size = _dense(codes[:-1] * len(names) + ids[len(ids) - len(codes) + 1 :])
                grams = _joined(grams[:-1], hashes[len(hashes) - len(grams) + 1 :])
                inside = inside[:-1] & word[len(word) - len(inside) + 1 :]
            passes = inside.copy()
            if level > 1:
                passes &= _hit(maps["buckets"], bits, grams)
                passes[passes] = _hit(maps["frequent"], bits, shorter[:-1][passes]) & _hit(maps["frequent"], bits, _suffixes(ids, hashes, level)[passes])
            old = passes.copy()
            if carried >= level:  # the slice before counted the sequence of the words carried over
                passes[0] = False
            at = np.flatnonzero(passes)
            phrases, keys, counts = [], [], []
            if len(at):
                numbers, first, n = np.unique(codes[at], return_index=True, return_counts=True)
                start = at[first]
                parts = [[names[i] for i in ids[start + k].tolist()] for k in range(level)]
                phrases, keys, counts = [b" ".join(p) for p in zip(*parts, strict=True)], grams[start].view(np.int64), n
            if phrases:
                yield pa.record_batch([pa.array([lang] * len(phrases)), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(keys), pa.array(counts.astype(np.int64))], ["lang", "phrase", "hash", "n"])
            if ahead and len(grams) > 1:
                longer = old[:-1] & old[1:] & word[level:] & inside[:-1]
                buckets, n = np.unique(_joined(grams[:-1][longer], hashes[level:][longer]) >> np.uint64(64 - bits), return_counts=True)
                if len(n):
                    yield pa.record_batch([pa.array([None] * len(n), pa.string()), pa.array([None] * len(n), pa.string()), pa.array(buckets.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "phrase", "hash", "n"])

    return run


def _suffixes(ids, hashes, level: int) -> np.ndarray:
    """Hashes of the last ``level - 1`` words of the sequence at each place."""
    found = hashes[1:]
    for k in range(2, level):
        found = _joined(found[:-1], hashes[k:])
    return found[: len(ids) - level + 1]


def _bitmap(numbers: DataFrame, column: str, bits: int) -> bytes:
    """The bits of ``column``'s numbers (below 2^bits): built in Spark 2^15 bits a row, at most 2^(bits - 15) rows."""
    rows = numbers.select(F.col(column).alias("i")).groupBy(F.expr("i div 32768").alias("g")).agg(F.bitmap_construct_agg((F.col("i") % _GROUP)).alias("m")).collect()
    out = np.zeros(max(1 << bits, _GROUP) // 8, np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r["m"]), np.uint8)
        out[r["g"] * (_GROUP // 8) : r["g"] * (_GROUP // 8) + len(part)] = part
    return out.tobytes()


def phrase_counts(docs: DataFrame, *, text_col="text", lang_col="lang", least=LEAST, most=MOST, bits: int | None = None):
    """(counts, totals): ``lang, phrase, words, n`` of every sequence of 1 to ``most`` words with n >= least, and
    ``lang, n`` with all words of each language. Null lang reads ``und``, null text ''."""
    spark = docs.sparkSession
    short_batches(spark)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text_col).alias("text"))
    if bits is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = min(MOST_BITS, max(LEAST_BITS, (size // 48).bit_length()))
    levels, totals, shared = [], None, None
    for level in range(1, most + 1):
        parts = rows.mapInArrow(_pass(level, bits, shared, level < most), "lang string, phrase string, hash long, n long")
        summed = parts.groupBy("lang", "phrase", "hash").agg(F.sum("n").alias("n"))
        if level == 1:  # all words are written once: their sum is the language's total
            summed = materialize(summed, "phrase-words")
            totals = materialize(summed.filter("phrase IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
        kept = materialize(summed.filter(F.col("n") >= least), "phrase-level")
        if level == 1:
            discard(summed)
        if shared:
            shared.unpersist()
        found = kept.filter("phrase IS NOT NULL")
        levels.append(found.select("lang", "phrase", F.lit(level).alias("words"), "n"))
        if level < most:
            frequent = found.select(F.shiftrightunsigned("hash", 64 - bits).alias("i"))
            shared = spark.sparkContext.broadcast({"buckets": _bitmap(kept.filter("phrase IS NULL"), "hash", bits), "frequent": _bitmap(frequent, "i", bits)})
    counts = levels[0]
    for more in levels[1:]:
        counts = counts.unionByName(more)
    return counts, totals


def collocations(docs: DataFrame, *, text_col="text", lang_col="lang", least=LEAST, most=MOST, top=TOP, bits: int | None = None) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases of 2 to ``most`` words by their
    weakest cut, without those that always stand inside one longer candidate.

    Null lang reads ``und``, null and empty texts have no words. Repeated rows count as often as they stand. Empty
    table: no rows. Only named columns are read. ``bits`` sets the bitmaps' size (speed only).
    """
    counts, totals = phrase_counts(docs, text_col=text_col, lang_col=lang_col, least=least, most=most, bits=bits)
    parts = F.split("phrase", " ")
    longer = counts.filter("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), parts.alias("w"))
    # A longer phrase that is as frequent also holds one just a word longer that is: only those need a look.
    inner = longer.filter("words > 2").select("lang", "a", F.explode(F.array(F.array_join(F.expr("slice(w, 1, words - 1)"), " "), F.array_join(F.expr("slice(w, 2, words - 1)"), " "))).alias("phrase"))
    covered = inner.groupBy("lang", "phrase").agg(F.max("a").alias("covers"))
    left = longer.join(covered, ["lang", "phrase"], "left").filter("covers IS NULL OR covers < a").drop("covers")
    cut = left.select("lang", "phrase", "a", "w", "words", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.expr("slice(w, 1, k)"), " ").alias("first"), F.array_join(F.expr("slice(w, k + 1, words - k)"), " ").alias("rest"))
    first, rest = (counts.select("lang", F.col("phrase").alias(c), F.col("n").alias(x)) for c, x in (("first", "l"), ("rest", "r")))
    wide = lambda c: c.cast("decimal(38,0)")
    score = F.call_function("div", wide(F.lit(1000)) * wide(F.col("a")) * wide(F.col("n")), wide(F.col("l")) * wide(F.col("r")))
    scored = cut.join(first, ["lang", "first"]).join(rest, ["lang", "rest"]).join(totals, "lang").select("lang", "phrase", "a", "n", F.struct(score.alias("score"), "k", "l", "r").alias("s"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min("s").alias("s")).select("lang", "phrase", "a", "s.l", "s.r", "n", "s.score")
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return best.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("long"))


def op11_pcy_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM places, (VALUES (1), (2), (3), (4), (5)) s(m) WHERE i + m - 1 <= len(w)),
counts AS (SELECT lang, phrase, m, count(*) AS n FROM grams GROUP BY ALL HAVING count(*) >= 100),
longer AS (SELECT lang, phrase, m, n AS a, string_split(phrase, ' ') AS w FROM counts WHERE m > 1),
inner_ AS (SELECT x.lang, array_to_string(x.w[s.i:s.i + t.m - 1], ' ') AS phrase, max(x.a) AS covers FROM longer x, (VALUES (1), (2), (3), (4)) s(i), (VALUES (2), (3), (4)) t(m)
  WHERE t.m < x.m AND s.i + t.m - 1 <= x.m GROUP BY ALL),
kept AS (SELECT x.* FROM longer x LEFT JOIN inner_ y USING (lang, phrase) WHERE y.covers IS NULL OR 100 * y.covers < 100 * x.a),
cuts AS (SELECT k.lang, k.phrase, k.a, c.k, array_to_string(w[1:c.k], ' ') AS first_, array_to_string(w[c.k + 1:], ' ') AS rest FROM kept k, (VALUES (1), (2), (3), (4)) c(k) WHERE c.k < k.m),
scored AS (SELECT c.lang, c.phrase, c.a, c.k, f.n AS l, g.n AS r, t.n, ((1000::HUGEINT * c.a * t.n) // (f.n::HUGEINT * g.n))::BIGINT AS score
  FROM cuts c JOIN counts f ON f.lang = c.lang AND f.phrase = c.first_ JOIN counts g ON g.lang = c.lang AND g.phrase = c.rest JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
