"""Byte-level BPE encoding and decoding with recursive DuckDB queries inside each partition.

Words (matches of the public split pattern) become rows of (word, position, token). A recursive query joins
neighbouring tokens with the merge table and contracts, in every word at once, the leftmost pair of the
least rank, until no word has a pair left. Distinct words are contracted once in each slice of texts and
kept for the next, up to a bound. Decoding is an ordered aggregation of the tokens' bytes.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurality.llm.common import handing_back, table, text_or_empty

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Bytes of text in a slice, bytes of words in one recursive query, words kept from slice to slice, and the
#: length in bytes above which words take the query that contracts all places of a pair at once.
SLICE, QUERY, KEPT, LONG = 1 << 20, 400_000, 400_000, 64

_PAIRS = """
  pairs AS (SELECT w, p, t, lead(t) OVER s AS nt, lag(p) OVER s AS prev FROM bpe WHERE live WINDOW s AS (PARTITION BY w ORDER BY p)),
  best AS (SELECT w, min((m.rank::BIGINT << 31) + q.p) AS k FROM pairs q JOIN merges m ON q.t = m.l AND q.nt = m.r GROUP BY w)"""

_LEFTMOST = f"""
WITH RECURSIVE bpe(w, p, t, live) AS (
  SELECT w, p, t, true FROM start
  UNION ALL
  (WITH {_PAIRS}
  SELECT q.w, q.p, CASE WHEN q.p = (b.k & 2147483647) THEN (b.k >> 31)::INTEGER ELSE q.t END, b.k IS NOT NULL
  FROM pairs q LEFT JOIN best b USING (w)
  WHERE b.k IS NULL OR q.prev IS DISTINCT FROM (b.k & 2147483647)))
SELECT w, t FROM bpe WHERE NOT live ORDER BY w, p"""

# A long word may hold its best pair often. Where no token made from the merged one has a lower rank
# (merges.safe), contracting every second pair of each run from the left is what one at a time would do.
_ALL_PLACES = f"""
WITH RECURSIVE bpe(w, p, t, live) AS (
  SELECT w, p, t, true FROM start
  UNION ALL
  (WITH {_PAIRS},
  marked AS (SELECT q.w, q.p, q.t, m.rank, m.safe, b.k, coalesce(m.rank = (b.k >> 31), false) AS same,
      row_number() OVER (PARTITION BY q.w ORDER BY q.p) AS i
    FROM pairs q LEFT JOIN merges m ON q.t = m.l AND q.nt = m.r LEFT JOIN best b ON q.w = b.w),
  runs AS (SELECT *, i - row_number() OVER (PARTITION BY w, same ORDER BY p) AS run FROM marked),
  chosen AS (SELECT *, same AND CASE WHEN safe THEN (i - min(i) OVER (PARTITION BY w, same, run)) % 2 = 0
      ELSE p = (k & 2147483647) END AS hit FROM runs)
  SELECT w, p, CASE WHEN hit THEN rank ELSE t END, k IS NOT NULL
  FROM (SELECT *, lag(hit) OVER (PARTITION BY w ORDER BY p) AS eaten FROM chosen) WHERE NOT coalesce(eaten, false)))
SELECT w, t FROM bpe WHERE NOT live ORDER BY w, p"""

_DECODE = "SELECT d, unhex(string_agg(h, '' ORDER BY p)) AS bytes FROM tokens JOIN vocab USING (t) GROUP BY d"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """A worker's DuckDB database with the vocabulary and its merges; one for each rank file."""

    def __init__(self, path: str | None = None):
        import duckdb
        import public_tokenizers
        import pyarrow as pa
        import regex

        self.ranks = read_ranks(path or public_tokenizers.path(RANKS))
        self.words_of = regex.compile(public_tokenizers.PATTERN).findall
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        merges, unsafe = [], set()
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    merges.append((left, right, rank))
                    unsafe.update(x for x in (left, right) if x > rank)
        l, r, rank = np.array(merges, np.int32).T  # noqa: E741
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        own = {"merges": pa.table({"l": l, "r": r, "rank": rank, "safe": pa.array([x not in unsafe for x in rank.tolist()])})}
        own["vocab"] = pa.table({"t": pa.array(list(self.ranks.values()), pa.int32()), "h": [b.hex() for b in self.ranks]})
        for name, rows in own.items():
            self.db.register("rows_", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM rows_")
            self.db.unregister("rows_")
        self._clear()

    def _clear(self):
        self.place: dict[str, int] = {}
        self.starts, self.lengths, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _contract(self, words: list[bytes], query: str) -> list[np.ndarray]:
        import pyarrow as pa

        lengths = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(lengths) - lengths
        flat = np.frombuffer(b"".join(words), np.uint8)
        places = (np.arange(len(flat)) - np.repeat(first, lengths)).astype(np.int32)
        self.db.register("start", pa.table({"w": np.repeat(np.arange(len(words), dtype=np.int32), lengths), "p": places, "t": self.of_byte[flat]}))
        found = self.db.sql(query).fetchnumpy()
        self.db.unregister("start")
        return np.bincount(found["w"], minlength=len(words)), np.asarray(found["t"], np.int32)

    def _learn(self, words: list[str], most: int):
        """Adds the tokens of new words, about ``most`` bytes of them in a query."""
        plain, split = [], []
        for word in words:
            (plain if word.encode() in self.ranks else split).append(word)
        split.sort(key=lambda w: (len(w) > LONG // 4, len(w)))
        groups, size = [], most
        for word in split:
            b = word.encode()
            long = len(b) > LONG
            if size + len(b) > most or groups[-1][0] != long:
                groups.append((long, [], []))
                size = 0
            groups[-1][1].append(word), groups[-1][2].append(b)
            size += len(b)
        counts, tokens = [np.ones(len(plain), np.int64)], [np.array([self.ranks[w.encode()] for w in plain], np.int32)]
        order = list(plain)
        for long, group, as_bytes in groups:
            n, t = self._contract(as_bytes, _ALL_PLACES if long else _LEFTMOST)
            counts.append(n), tokens.append(t), order.extend(group)
        lengths, at = np.concatenate(counts), len(self.pool)
        self.place.update(zip(order, range(len(self.lengths), len(self.lengths) + len(order)), strict=True))
        self.starts = np.concatenate([self.starts, at + np.cumsum(lengths) - lengths])
        self.lengths, self.pool = np.concatenate([self.lengths, lengths]), np.concatenate([self.pool, *tokens])

    def encode(self, texts: list[str], most: int = QUERY) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, how many each text has)."""
        words = [self.words_of(t) for t in texts]
        if len(self.place) > KEPT:
            self._clear()
        new = {w for own in words for w in own if w not in self.place}
        if new:
            self._learn(sorted(new), most)
        place = self.place
        at = np.fromiter((place[w] for own in words for w in own), np.int64)
        lengths = self.lengths[at]
        before = np.cumsum(lengths) - lengths
        ids = self.pool[np.arange(lengths.sum()) + np.repeat(self.starts[at] - before, lengths)]
        owner = np.repeat(np.arange(len(texts)), [len(own) for own in words])
        return ids, np.bincount(owner, lengths, minlength=len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each text; an id outside the vocabulary is an error."""
        import pyarrow as pa

        if len(ids) and not np.isin(ids, np.fromiter(self.ranks.values(), np.int64)).all():
            raise ValueError("an id is not in the vocabulary")
        owner = np.repeat(np.arange(len(counts)), counts)
        self.db.register("tokens", pa.table({"d": owner, "p": np.arange(len(ids)), "t": np.asarray(ids, np.int32)}))
        out = [b""] * len(counts)
        for d, found in self.db.sql(_DECODE).fetchall():
            out[d] = found
        self.db.unregister("tokens")
        return out


@lru_cache(maxsize=2)
def codec(path: str | None = None) -> Codec:
    return Codec(path)


def _slices(batch, column: int, most: int = SLICE):
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def encode(docs: DataFrame, *, id_col="doc_id", text_col="text", path: str | None = None, with_ids: bool = True, slice_bytes: int = SLICE, query_bytes: int = QUERY) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row, and its ``ids`` unless ``with_ids`` is false.

    The hashes are of the ids as little-endian unsigned 32-bit integers, and of the bytes that decoding
    those ids gives. Smaller slices and queries take less memory and more time. Null texts count as empty: no ids. Rows are handled where they stand, repeated ones
    alike; an empty table gives no rows; only the two named columns are read.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")

    def run(batches):
        import pyarrow as pa

        own = codec(path)
        for whole in batches:
            for batch in _slices(whole, 1, slice_bytes):
                ids, counts = own.encode(batch.column(1).to_pylist(), query_bytes)
                decoded = own.decode(ids, counts)
                ends = np.cumsum(counts)
                hashes = [hashlib.sha256(ids[e - n : e].astype("<u4").tobytes()).hexdigest() for e, n in zip(ends, counts, strict=True)]
                out = [batch.column(0), pa.array(counts), pa.array(hashes, pa.string()), pa.array([hashlib.sha256(b).hexdigest() for b in decoded], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32())))
                    names.append("ids")
                yield pa.record_batch(out, names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(handing_back(run), schema)


def decode(encoded: DataFrame, *, id_col="doc_id", ids_col="ids", path: str | None = None) -> DataFrame:
    """``doc_id, bytes`` of each row of ids; null ids count as none, an id outside the vocabulary is an error."""

    def run(batches):
        import pyarrow as pa

        own = codec(path)
        for batch in batches:
            lists = batch.column(1)
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            found = own.decode(lists.flatten().to_numpy(zero_copy_only=False), counts)
            yield pa.record_batch([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "bytes"])

    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, bytes binary")


def op4_duckdb_bpe(spark, sf_dir):
    return encode(table(spark, sf_dir, "documents"), with_ids=False)
