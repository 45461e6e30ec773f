"""Packing documents into training sequences along a space-filling curve.

A document's token counts are hashed into a signed vector, projected to ``DIMS`` dimensions and placed on a Hilbert
curve; documents in the order of their keys follow one another into sequences, so that neighbours in a sequence are
alike. Places are a two-level running sum: keys are range-sorted by Spark, partitions sum their own tokens, and
partition totals meet in one short window. Nothing but the last sequence is ever short, and that one is parted at
powers of two, so no padding is left.

Long documents are rows of ``SEGMENT`` tokens, so no row is large; equal keys (copies) are parted by hash and id.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from math import erf
from pathlib import Path

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plurality.llm.common import materialize, table, text_or_empty

LENGTH, END = 2048, 1
#: Dimensions of the curve, bits of each, buckets that tokens are hashed into; tokens of a row; texts of a batch in bytes.
DIMS, BITS, BUCKETS, SEGMENT = 4, 12, 512, 1 << 16
SEED = 13
#: The longest word that is merged the quick way, and the size from which a text is tokenised in parts.
LONGEST, PART = 512, 1 << 20

#: Characters whose class no Unicode version has changed; texts of other ones, or with longer words or
#: runs of blanks, are left to the tokenizer itself.
_BLANK, _INK = r"[\t\n\r ]", r"[!-~¡-ȳΑ-ΡΣ-ωА-яא-תء-غف-ي‐-‧ぁ-ゖァ-ヺ一-龥가-힣]"
_PLAIN = re.compile(rf"(?:{_INK}{{0,{LONGEST}}}+{_BLANK}{{1,{LONGEST}}}+(?!{_BLANK}))*+{_INK}{{0,{LONGEST}}}+")
_BREAK = re.compile(r"[A-Za-z] (?=[A-Za-z])")
_RUN = re.compile(r"\s\s")
_LOOK = r"|\s+(?!\S)"  # of the pattern: bears on runs of blanks only, and costs a third of the time


class Encoder:
    """The ids that a byte-level file of the tokenizers library gives to whole texts.

    Where the file's merges make tokens in the order of their ids, as ranks do, plain texts are merged by the tiktoken
    library with the file's own vocabulary, which takes a fifth of the time for the same ids.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = sorted(added)
        self.quick = self.single = None
        model = json.loads(Path(path).read_text())["model"]
        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if made == sorted(made):
            byte = _byte_of_character()
            ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
            self.quick, self.single = (tiktoken.Encoding("file", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (public_tokenizers.PATTERN, public_tokenizers.PATTERN.replace(_LOOK, "")))

    def encode(self, text: str) -> np.ndarray:
        # Parts end between a letter and a blank before a letter, where a word of the pattern always ends.
        out, at = [np.zeros(0, np.uint32)], 0
        while at < len(text):
            cut = _BREAK.search(text, at + PART) if len(text) - at > PART else None
            end = cut.start() + 1 if cut else len(text)
            part = text[at:end]
            if self.quick and _PLAIN.fullmatch(part) and not any(s in part for s in self.special):
                out.append((self.quick if _RUN.search(part) else self.single).encode_to_numpy(part, disallowed_special=()))
            else:
                out.append(np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, np.uint32))
            at = end
        return np.concatenate(out) if len(out) > 2 else out[-1]


def _byte_of_character() -> dict[str, int]:
    """Byte-level files write a byte as its Latin-1 character where that has a shape, the others from U+0100 on."""
    shaped = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in shaped} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in shaped)}


@lru_cache(1)  # made once in a worker, not once a task
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _hashing(vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token's bucket and sign, and the buckets' rows of a normal matrix."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, BUCKETS, vocabulary), rng.choice([-1.0, 1.0], vocabulary), rng.standard_normal((BUCKETS, DIMS))


def place(ids: np.ndarray, hashing) -> np.ndarray:
    """The document's cell on the grid: its hashed vector of signed, damped counts, projected and cut into equal shares."""
    bucket, sign, projection = hashing
    if not len(ids):
        return np.zeros(DIMS, np.int64)
    counts = np.bincount(bucket[ids], sign[ids], BUCKETS)
    vector = np.sign(counts) * np.sqrt(np.abs(counts))
    z = vector @ projection / max(np.linalg.norm(vector), 1e-9)
    share = np.array([(1 + erf(v / 2**0.5)) / 2 for v in z])
    return np.minimum((share * 2**BITS).astype(np.int64), 2**BITS - 1)


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of grid cells, one a row: neighbours on the curve are neighbours on the grid.

    From the highest bit down each coordinate's bit reflects or swaps the lower bits of the first, which turns every
    subcube so that the curve enters it where it left the one before; the Gray code of the result is the place.
    """
    x = np.array(cells, np.int64).T.copy()
    dims = len(x)
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for d in range(dims):
            reflect = (x[d] >> bit & 1).astype(bool)
            swap = np.where(reflect, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(reflect, low, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where(x[dims - 1] >> bit & 1, (1 << bit) - 1, 0)
    key = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for d in range(dims):
            key = key << 1 | ((x[d] ^ turn) >> bit & 1)
    return key


def _batches(rows, names: list[str], kinds: list[str], weight: int):
    """Arrow batches of the tuples ``rows``, of 4,096 rows or about 4 MB of what stands at ``weight`` in each."""
    import pyarrow as pa

    def batch():
        return pa.record_batch([pa.array(c, pa.type_for_alias(k)) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[weight])
        if len(held) >= 4096 or size > 4 << 20:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _tokenised(path: str):
    def documents(batches):
        encoder = _encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                docs, texts = (c.to_pylist() for c in whole.slice(at, 64).columns)
                for doc, text in zip(docs, texts, strict=True):
                    yield doc, encoder.encode(text)

    def rows(batches):
        size = _encoder(path).tokenizer.get_vocab_size()
        hashing, narrow = _hashing(size), _narrow(size)
        part, seq, found = TaskContext.get().partitionId() << 40, 0, documents(batches)
        while some := list(_some(found)):
            keys = hilbert_key(np.array([place(ids, hashing) for _, ids in some])).tolist()
            for (doc, ids), key in zip(some, keys, strict=True):
                ids = np.append(ids, np.uint32(END)).astype(narrow)
                for start in range(0, len(ids), SEGMENT):
                    own = ids[start : start + SEGMENT]
                    yield part | seq, doc, start, len(own), len(ids), key, own.tobytes()
                    seq += 1

    return lambda batches: _batches(rows(batches), ["row", "doc_id", "start", "size", "doc_tokens", "key", "ids"], [*["int64"] * 6, "binary"], 6)


def _some(found):
    """The next 256 documents, or fewer with two million tokens."""
    size = 0
    for k, (doc, ids) in enumerate(found, 1):
        yield doc, ids
        size += len(ids)
        if k == 256 or size > 2_000_000:
            return


def _narrow(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _numbered(batches):
    """(row, size, part, own): the partition and the tokens before the row in it; rows come sorted."""
    import pyarrow as pa

    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        size = batch.column(1).to_numpy()
        upto = before + np.cumsum(size)
        before = int(upto[-1]) if len(upto) else before
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.full(len(size), part, np.int32)), pa.array(upto - size)], ["row", "size", "part", "own"])


def spans(at: int, size: int, total: int, length: int):
    """(sequence, offset, tokens) of each piece of the tokens ``at`` to ``at + size`` of ``total``: cut at every
    ``length`` and, in what is left at the end, at its powers of two from the largest down."""
    end, tail = at + size, total - total % length
    while at < min(end, tail):
        n = min(end, at - at % length + length) - at
        yield at // length, at % length, n
        at += n
    sequence, begin = tail // length, tail
    while at < end:
        after = begin + (1 << (total - begin).bit_length() - 1)
        if at < after:
            n = min(end, after) - at
            yield sequence, at - begin, n
            at += n
        sequence, begin = sequence + 1, after


def _pieces(total: int, length: int, narrow: str):
    def rows(batches):
        for batch in batches:
            for doc, start, size, doc_tokens, ids, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, done = np.frombuffer(ids, narrow).astype("<u4"), 0
                for sequence, offset, n in spans(at, size, total, length):
                    yield doc, start + done, n, doc_tokens, sequence, offset, ids[done : done + n].tobytes()
                    done += n

    return lambda batches: _batches(rows(batches), ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"], [*["int64"] * 6, "binary"], 6)


def pack(docs: DataFrame, *, id_col="doc_id", text_col="text", tokenizer: str | None = None, length=LENGTH) -> DataFrame:
    """``doc_id, start, length, doc_tokens, sequence_id, offset, ids`` for each piece: ``ids`` are its little-endian
    32-bit token ids, ``start`` the document's ids before them, ``offset`` their place in the sequence.

    Every document is its tokens and ``END``, so null and empty texts are one token. Sequences hold ``length`` tokens,
    the rest of the corpus powers of two. Repeated rows are packed as often as they stand; null ids pack like others.
    Empty table: no rows. Only named columns are read. ``tokenizer`` is the path of a ``tokenizers`` file that the
    executors have too.
    """
    import public_tokenizers

    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    schema = "row long, doc_id long, start long, size long, doc_tokens long, key long, ids binary"
    rows = materialize(texts.mapInArrow(_tokenised(path), schema), "pack-tokens", compression="zstd")
    # The order along the curve, of light rows. Copies share a key: what else they have parts them, and rows that
    # are equal but for their number may stand in any order.
    order = ["key", "h", "doc_id", "start", "row"]
    light = rows.select("row", "size", "key", F.xxhash64("doc_id", "doc_tokens").alias("h"), "doc_id", "start").repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = materialize(light.select("row", "size").mapInArrow(_numbered, "row long, size long, part int, own long"), "pack-order")
    parts = numbered.groupBy("part").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    ends = materialize(parts.select("part", before.alias("before"), "n"), "pack-parts")
    total = ends.agg(F.sum("n")).first()[0] or 0
    at = numbered.join(ends, "part").select("row", (F.col("own") + F.col("before")).alias("at"))
    placed = rows.join(at, "row").select("doc_id", "start", "size", "doc_tokens", "ids", "at")
    pieces = _pieces(total, length, _narrow(_encoder(path).tokenizer.get_vocab_size()))
    return placed.mapInArrow(pieces, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def op13_hilbert_packing(spark, sf_dir):
    packed = pack(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
