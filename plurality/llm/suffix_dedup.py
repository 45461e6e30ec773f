"""Removal of repeated 100-byte strings by a logarithmic family of sparse suffix arrays.

Only suffixes at content-defined anchors are looked at first: the bytes at which a 32-byte gram has the
least hash of some 100-byte string around it. Equal strings have their anchor at the same place, so no
repeat escapes. Sorted runs of (gram, context) from each batch of documents are merge-scanned against the
existing levels of their shard; runs of like size merge, so a shard keeps logarithmically many. An anchor
whose whole context stands earlier is settled there. Anchors that share their gram, not their context, are
where repeats begin and end: the 100-byte suffixes around them, cut from the texts, get true suffix arrays,
sorted by their bytes, in a second family of the same kind, which settles them byte by byte.

Shards are dealt by gram, so what is alike meets; copies inside a batch are settled before the shuffle, and
the suffixes of a gram with very many contexts are dealt by their own hash instead. Texts are shuffled once.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurality.llm.common import table, text_or_empty

LENGTH, GRAM = 100, 32
REACH = LENGTH - GRAM  # bytes of context before an anchor
SPAN = REACH + LENGTH  # and in all
#: Bytes of text a shard, bytes hashed at a time, contexts of a gram from which its suffixes are dealt by
#: their own hash, and suffixes of a run (incoming pieces are gathered up to this before they are sorted).
SHARD_BYTES, BLOCK, HOT, RUN = 5 << 20, 1 << 20, 16384, 60_000
_MULTIPLIER = 0x9E3779B97F4A7C15
_ANCHOR = np.dtype([("gram", "<u8"), ("ctx", "<u8"), ("doc", "<i8"), ("th", "<i8"), ("pos", "<i4")])
_SPOT = np.dtype([("doc", "<i8"), ("th", "<i8"), ("a", "<i4"), ("b", "<i4")])
_SUSPECT = np.dtype([("gram", "<u8"), ("doc", "<i8"), ("th", "<i8"), ("pos", "<i4"), ("hot", "<i4")])
_SEGMENT = np.dtype([("doc", "<i8"), ("th", "<i8"), ("p", "<i4"), ("n", "<i4")])


@lru_cache(maxsize=1)
def _powers():
    n = BLOCK + 4 * SPAN
    up, down = np.full(n, _MULTIPLIER, np.uint64), np.full(n, pow(_MULTIPLIER, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    values = np.random.default_rng(100).integers(1, 1 << 63, 256, dtype=np.uint64)
    return np.multiply.accumulate(up), np.multiply.accumulate(down), values


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def _sliding(h: np.ndarray, width: int, pick) -> np.ndarray:
    size = 1
    out = h
    while 2 * size <= width:
        out = pick(out[:-size], out[size:])
        size *= 2
    return pick(out[: len(out) - (width - size)], out[width - size :]) if size < width else out


def anchors(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(position in ``flat``, gram hash, context hash) of every anchor; texts lie in [starts, ends) of ``flat``."""
    up, down, values = _powers()
    n, out = len(flat), []
    for x in range(0, n, BLOCK):
        windows = min(BLOCK, n - LENGTH + 1 - x)
        if windows <= 0:
            break
        lo, hi = max(0, x - REACH), min(n, x + windows + 2 * LENGTH)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(values[flat[lo:hi]] * up[: hi - lo], out=sums[1:])
        run = lambda a, b: _mix((sums[b - lo] - sums[a - lo]) * down[a - lo])  # noqa: B023, E731
        grams = np.arange(x, x + windows + REACH)
        h = run(grams, grams + GRAM)
        least = _sliding(h, REACH + 1, np.minimum)
        text = np.searchsorted(starts, np.arange(x, x + windows), side="right") - 1
        least = np.where(np.arange(x, x + windows) + LENGTH <= ends[text], least, np.uint64(0))
        edge = np.zeros(REACH, np.uint64)
        at = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), REACH + 1, np.maximum) == h)
        at = at[h[at] > 0] + x
        own = np.searchsorted(starts, at, side="right") - 1
        a, b = np.maximum(starts[own], at - REACH), np.minimum(ends[own], at + LENGTH)
        inside = (b <= hi) & (a >= lo)
        shape = (at - a).astype(np.uint64) << np.uint64(8) | (b - at).astype(np.uint64)
        out.append((at[inside], h[at[inside] - x], _mix(run(a[inside], b[inside]) ^ shape[inside])))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _later(rows: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Of sorted rows, those that repeat the one before (``same``) and stand elsewhere than the first of their kind."""
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(rows))))
    place = [c for c in rows.dtype.names if c in ("doc", "th", "pos", "p")]
    return same & np.logical_or.reduce([rows[c] != rows[c][head] for c in place])


class LogFamily:
    """Levels of sorted rows; a new run is scanned against all, then levels of like size merge.

    ``key`` gives what rows are sorted by. Rows with equal keys stand once, at the earliest place; ``add``
    returns those that are found to stand earlier as well.
    """

    def __init__(self, key, order):
        self.key, self.order, self.levels = key, order, []

    def _sorted(self, rows):
        rows = rows[np.lexsort(self.order(rows))]
        rows = rows[np.argsort(self.key(rows), kind="stable")]
        k = self.key(rows)
        same = np.concatenate([[False], k[1:] == k[:-1]])
        return rows[~same], rows[_later(rows, same)]

    def add(self, rows) -> list[np.ndarray]:
        run, settled = self._sorted(rows)
        found = [settled]
        for level in self.levels:
            if not len(run) or not len(level):
                continue
            keys, own = self.key(level), self.key(run)
            at = np.minimum(np.searchsorted(keys, own), len(level) - 1)
            met = np.flatnonzero(keys[at] == own)
            if len(met):
                mine, theirs = run[met], level[at[met]]
                first = _before(mine, theirs)
                level[at[met[first]]] = mine[first]
                other = np.where(first, theirs, mine)
                found.append(other[_differs(mine, theirs)])
                run = np.delete(run, met)
        self.levels.append(run)
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            both = np.concatenate([self.levels.pop(), self.levels.pop()])
            self.levels.append(both[np.argsort(self.key(both), kind="stable")])
        return found

    def all(self):
        rows = np.concatenate(self.levels) if self.levels else None
        return rows[np.argsort(self.key(rows), kind="stable")] if rows is not None else None


def _places(rows):
    return [rows[c] for c in ("doc", "th", "pos" if "pos" in rows.dtype.names else "p")]


def _before(a, b) -> np.ndarray:
    out, tie = np.zeros(len(a), bool), np.ones(len(a), bool)
    for x, y in zip(_places(a), _places(b), strict=True):
        out |= tie & (x < y)
        tie &= x == y
    return out


def _differs(a, b) -> np.ndarray:
    return np.logical_or.reduce([x != y for x, y in zip(_places(a), _places(b), strict=True)])


def _merged(spots: np.ndarray) -> np.ndarray:
    """Spans [a, b) of each document, overlapping and touching ones joined."""
    if not len(spots):
        return spots
    spots = spots[np.lexsort((spots["a"], spots["th"], spots["doc"]))]
    text = np.concatenate([[0], np.cumsum((spots["doc"][1:] != spots["doc"][:-1]) | (spots["th"][1:] != spots["th"][:-1]))])
    # Ends so far, document by document: ends are shifted by the document's number so that a running maximum works.
    shift = text.astype(np.int64) << 33
    reach = np.maximum.accumulate(spots["b"] + shift)
    new = np.concatenate([[True], spots["a"][1:] + shift[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    out = spots[first].copy()
    out["b"] = np.maximum.reduceat(spots["b"], first)
    return out


def _deal(rows: np.ndarray, by: np.ndarray, shards: int):
    """(shard, its rows) of rows dealt by a hash."""
    to = (by % np.uint64(shards)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.diff(to[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(to[part[0]]), rows[part]


_BLOBS = "shard int, kind int, blob binary"
RUN_OF_ANCHORS, SPOTS, SUSPECTS, SEGMENTS = 0, 1, 2, 3


def _emit(parts):
    import pyarrow as pa

    shard, kind, blob = zip(*parts, strict=True) if parts else ((), (), ())
    return pa.record_batch([pa.array(shard, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], ["shard", "kind", "blob"])


def _texts(columns):
    """(flat bytes, starts, ends, doc, th) of a batch's or table's texts."""
    import pyarrow as pa

    text = columns.column("text").cast(pa.large_binary())
    text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    data = text.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    flat = flat[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    number = lambda c: columns.column(c).to_numpy() if isinstance(columns, pa.Table) else columns.column(c).to_numpy(zero_copy_only=False)
    return flat, offsets[:-1], offsets[1:], number("doc"), number("th")


def _scan_batches(shards):
    def run(batches):
        for batch in batches:
            flat, starts, ends, doc, th = _texts(batch)
            at, gram, ctx = anchors(flat, starts, ends)
            if not len(at):
                continue
            own = np.searchsorted(starts, at, side="right") - 1
            rows = np.empty(len(at), _ANCHOR)
            rows["gram"], rows["ctx"], rows["doc"], rows["th"], rows["pos"] = gram, ctx, doc[own], th[own], at - starts[own]
            size = ends - starts
            family = LogFamily(lambda r: r["ctx"], lambda r: (r["pos"], r["th"], r["doc"]))
            settled = np.concatenate(family.add(rows))
            # Ends of documents clip contexts; lengths are known here, so copies become spans at once.
            lengths = dict(zip(zip(doc.tolist(), th.tolist(), strict=True), size.tolist(), strict=True))
            yield _emit([(s, SPOTS, _merged(x).tobytes()) for s, x in _by_doc(_clipped(settled, lengths), shards)])
            kept = family.all()
            kept = kept[np.argsort(kept["gram"], kind="stable")]
            yield _emit([(s, RUN_OF_ANCHORS, x.tobytes()) for s, x in _deal(kept, _mix(kept["gram"].copy()), shards)])

    return run


def _clipped(rows, lengths) -> np.ndarray:
    out = np.empty(len(rows), _SPOT)
    out["doc"], out["th"] = rows["doc"], rows["th"]
    out["a"] = np.maximum(0, rows["pos"] - REACH)
    out["b"] = rows["pos"] + LENGTH
    if lengths is not None and len(rows):
        ends = np.array([lengths[k] for k in zip(rows["doc"].tolist(), rows["th"].tolist(), strict=True)], np.int64)
        out["b"] = np.minimum(out["b"], ends)
    return out


def _by_doc(spots, shards):
    return _deal(spots, _text_key(spots["doc"].copy(), spots["th"].copy()), shards) if len(spots) else ()


def _text_key(doc: np.ndarray, th: np.ndarray) -> np.ndarray:
    """What texts and their spans are dealt by: id and text together, so that one id on many texts is spread."""
    return _mix(_mix(doc.view(np.uint64)) ^ th.view(np.uint64))


def _shard_runs(batches):
    """Blobs of one shard after the other: (shard, list of (kind, blob))."""
    shard, held = None, []
    for batch in batches:
        for s, kind, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if s != shard and held:
                yield shard, held
                held = []
            shard = s
            held.append((kind, blob))
    if held:
        yield shard, held


def _settle_anchors(shards, hot=HOT):
    """A shard's runs of anchors to spans of documents and suspects, dealt by document."""

    def run(batches):
        for _, blobs in _shard_runs(batches):
            family = LogFamily(lambda r: r["ctx"], lambda r: (r["pos"], r["th"], r["doc"]))
            spots = [np.frombuffer(b, _SPOT) for k, b in blobs if k == SPOTS]
            pending, size = [], 0
            for kind, blob in blobs:
                if kind == RUN_OF_ANCHORS:
                    pending.append(np.frombuffer(blob, _ANCHOR))
                    size += len(pending[-1])
                    if size >= RUN:
                        spots += [_clipped(x, None) for x in family.add(np.concatenate(pending))]
                        pending, size = [], 0
            if pending:
                spots += [_clipped(x, None) for x in family.add(np.concatenate(pending))]
            yield _emit([(s, SPOTS, x.tobytes()) for s, x in _by_doc(_merged(np.concatenate(spots)) if spots else np.empty(0, _SPOT), shards)])
            rest = family.all()
            if rest is None or not len(rest):
                continue
            rest = rest[np.argsort(rest["gram"], kind="stable")]
            starts = np.flatnonzero(np.concatenate([[True], rest["gram"][1:] != rest["gram"][:-1]]))
            many = np.repeat(np.diff(np.append(starts, len(rest))), np.diff(np.append(starts, len(rest))))
            found = rest[many > 1]
            out = np.empty(len(found), _SUSPECT)
            for c in ("gram", "doc", "th", "pos"):
                out[c] = found[c]
            out["hot"] = many[many > 1] > hot
            yield _emit([(s, SUSPECTS, x.tobytes()) for s, x in _by_doc(out, shards)])

    return run


def _windows_of(flat, first, last, at):
    """(first suffix, number of suffixes) whose anchor is the one at ``at``; texts lie in [first, last)."""
    _, _, values = _powers()
    up = _powers()[0][: SPAN]
    offsets = np.arange(-REACH, LENGTH)
    lo, n = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for s in range(0, len(at), 4096):
        a, f, e = at[s : s + 4096, None], first[s : s + 4096, None], last[s : s + 4096, None]
        where = a + offsets
        ok = (where >= f) & (where < e)
        sums = np.zeros((len(a), SPAN + 1), np.uint64)
        np.cumsum(np.where(ok, values[flat[np.clip(where, 0, max(0, len(flat) - 1))]], np.uint64(0)) * up, axis=1, out=sums[:, 1:])
        down = _powers()[1][: SPAN + 1]
        h = _mix((sums[:, GRAM:] - sums[:, :-GRAM]) * down[: SPAN + 1 - GRAM])
        least = np.stack([h[:, j : j + REACH + 1].min(1) for j in range(REACH + 1)], 1)
        start = a + np.arange(-REACH, 1)
        mine = (least == h[:, REACH : REACH + 1]) & (start >= f) & (start + LENGTH <= e)
        n[s : s + 4096] = mine.sum(1)
        lo[s : s + 4096] = at[s : s + 4096] - REACH + mine.argmax(1)
    return lo, n


def _lookup(doc, th, rows):
    """Place of each row's document among (doc, th)."""
    order = np.lexsort((th, doc))
    pairs = np.empty(len(doc), [("d", "<i8"), ("t", "<i8")])
    pairs["d"], pairs["t"] = doc[order], th[order]
    want = np.empty(len(rows), pairs.dtype)
    want["d"], want["t"] = rows["doc"], rows["th"]
    return order[np.searchsorted(pairs, want)]


def _cut_segments(shards):
    """Texts of a document shard and its blobs: segments around suspects, dealt by gram; spans pass on merged."""
    import pyarrow as pa

    def run(texts: pa.Table, blobs: pa.Table) -> pa.Table:
        kinds, raw = blobs.column("kind").to_pylist(), blobs.column("blob").to_pylist()
        spots = [np.frombuffer(b, _SPOT) for k, b in zip(kinds, raw, strict=True) if k == SPOTS]
        found = [np.frombuffer(b, _SUSPECT) for k, b in zip(kinds, raw, strict=True) if k == SUSPECTS]
        out = []
        if spots:
            out.append(_emit([(s, SPOTS, x.tobytes()) for s, x in _by_doc(_merged(np.concatenate(spots)), shards)]))
        if found and texts.num_rows:
            rows = np.concatenate(found)
            flat, starts, ends, doc, th = _texts(texts)
            own = _lookup(doc, th, rows)
            lo, n = _windows_of(flat, starts[own], ends[own], starts[own] + rows["pos"])
            rows, own, lo, n = rows[n > 0], own[n > 0], lo[n > 0], n[n > 0]
            out.append(_emit(_segments(flat, starts[own], rows, lo, n, rows["hot"] > 0, shards)))
        batches = [x for x in out if x.num_rows]
        return pa.Table.from_batches(batches) if batches else pa.Table.from_batches([_emit([])])

    return run


def _segments(flat, base, rows, lo, n, hot, shards):
    parts = []
    for single in (False, True):
        pick = np.flatnonzero(hot == single)
        if not len(pick):
            continue
        by = rows["gram"][pick].copy()
        if single:  # one suffix a segment, dealt by its own hash
            times = n[pick]
            step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            pick = np.repeat(pick, times)
            at, count = lo[pick] + step, np.ones(len(pick), np.int64)
            by = _suffix_hashes(flat, at)
        else:
            at, count = lo[pick], n[pick]
        seg = np.empty(len(pick), _SEGMENT)
        seg["doc"], seg["th"], seg["p"], seg["n"] = rows["doc"][pick], rows["th"][pick], at - base[pick], count
        to = (_mix(by) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
            size = count[part] + LENGTH - 1
            bytes_at = np.arange(size.sum()) + np.repeat(at[part] - (np.cumsum(size) - size), size)
            parts.append((int(to[part[0]]), SEGMENTS, len(part).to_bytes(8, "little") + seg[part].tobytes() + flat[bytes_at].tobytes()))
    return parts


def _suffix_hashes(flat, at):
    up, _, values = _powers()
    out = np.empty(len(at), np.uint64)
    for s in range(0, len(at), 4096):
        out[s : s + 4096] = (values[flat[at[s : s + 4096, None] + np.arange(LENGTH)]] * up[:LENGTH]).sum(1)
    return out


_SUFFIX = np.dtype([("s", f"S{LENGTH}"), ("doc", "<i8"), ("th", "<i8"), ("p", "<i4")])


def _suffixes(blob: bytes) -> np.ndarray:
    """The suffixes of a blob's segments. Bytes are raised by one (UTF-8 has no 255), so none ends in a zero."""
    m = int.from_bytes(blob[:8], "little")
    seg = np.frombuffer(blob, _SEGMENT, m, 8)
    data = np.frombuffer(blob, np.uint8, offset=8 + m * _SEGMENT.itemsize) + np.uint8(1)
    n = seg["n"].astype(np.int64)
    size = n + LENGTH - 1
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    rows = np.empty(len(step), _SUFFIX)
    rows["s"] = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[np.repeat(np.cumsum(size) - size, n) + step].view(f"S{LENGTH}")[:, 0]
    rows["doc"], rows["th"], rows["p"] = np.repeat(seg["doc"], n), np.repeat(seg["th"], n), np.repeat(seg["p"], n) + step
    return rows


def _settle_suffixes(shards):
    """A shard's suffixes through its family of suffix arrays to spans, dealt by document."""

    def run(batches):
        for _, blobs in _shard_runs(batches):
            family = LogFamily(lambda r: r["s"], lambda r: (r["p"], r["th"], r["doc"]))
            spots = [np.frombuffer(b, _SPOT) for k, b in blobs if k == SPOTS]
            pending, size = [], 0
            for kind, blob in [*blobs, (None, None)]:
                if kind == SEGMENTS:
                    pending.append(_suffixes(blob))
                    size += len(pending[-1])
                if pending and (size >= RUN or kind is None):
                    for x in family.add(np.concatenate(pending)):
                        spot = np.empty(len(x), _SPOT)
                        spot["doc"], spot["th"], spot["a"], spot["b"] = x["doc"], x["th"], x["p"], x["p"] + LENGTH
                        spots.append(_merged(spot))
                    pending, size = [], 0
            if spots:
                yield _emit([(s, SPOTS, x.tobytes()) for s, x in _by_doc(_merged(np.concatenate(spots)), shards)])

    return run


def _remove(texts, blobs):
    """Each text of a document shard without its spans."""
    import pyarrow as pa

    flat, starts, ends, doc, th = _texts(texts)
    spots = [np.frombuffer(b, _SPOT) for b in blobs.column("blob").to_pylist()]
    spans: dict = {}
    for s in _merged(np.concatenate(spots)).tolist() if spots else ():
        spans.setdefault(s[:2], []).append(s[2:])
    sizes, removed, runs, hashes, kept = [], [], [], [], []
    whole = flat.tobytes()
    for s, e, d, t in zip(starts.tolist(), ends.tolist(), doc.tolist(), th.tolist(), strict=True):
        text, gone, at, pieces = whole[s:e], spans.get((d, t), ()), 0, []
        cut = 0
        for a, b in gone:
            b = min(b, len(text))
            pieces.append(text[at:a])
            cut += b - a
            at = b
        pieces.append(text[at:])
        left = b"".join(pieces)
        sizes.append(len(text)), removed.append(cut), runs.append(len(gone)), hashes.append(hashlib.sha256(left).hexdigest()), kept.append(left)
    columns = [texts.column("doc_id").combine_chunks(), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(hashes, pa.string())]
    return pa.table(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]), kept


def remove_repeats(docs: DataFrame, *, id_col="doc_id", text_col="text", with_kept: bool = False, hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of each row, and ``kept`` (binary) if asked for.

    A byte goes if a 100-byte string over it also starts earlier: in a document of smaller id, or earlier in
    its own. Null texts count as empty. Null ids stand after all others. Rows with the same id and text are
    one document and get the same result; rows with the same id and other texts stand in the order of a hash
    of the text. An empty table gives no rows. Only the two named columns are read.
    """
    import pyarrow as pa

    # A gram of over ``hot`` contexts has its suffixes dealt by their own hash.
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = rows.withColumn("doc", F.coalesce("doc_id", F.lit(2**63 - 1))).withColumn("th", F.xxhash64("text"))
    total = docs.agg(F.sum(F.octet_length(text_or_empty(text_col)))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    # Python deals spans by the same hash, so texts and their spans meet.
    to = _shard_of(shards)
    texts = rows.mapInArrow(to, "doc_id long, text string, doc long, th long, shard int").repartition(shards, "shard")
    dealt = lambda df: df.repartition(shards, "shard")
    runs = dealt(rows.mapInArrow(_scan_batches(shards), _BLOBS)).sortWithinPartitions("shard").mapInArrow(_settle_anchors(shards, hot), _BLOBS)
    cut = texts.groupBy("shard").cogroup(dealt(runs).groupBy("shard")).applyInArrow(_cut_segments(shards), _BLOBS)
    spans = dealt(cut).sortWithinPartitions("shard").mapInArrow(_settle_suffixes(shards), _BLOBS)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_kept else "")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out, kept = _remove(left, right)
        return out.append_column("kept", pa.array(kept, pa.binary())) if with_kept else out

    return texts.groupBy("shard").cogroup(dealt(spans).groupBy("shard")).applyInArrow(finish, schema)


def _shard_of(shards):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            to = (_text_key(batch.column(2).to_numpy().copy(), batch.column(3).to_numpy().copy()) % np.uint64(shards)).astype(np.int32)
            yield pa.record_batch([*batch.columns, pa.array(to)], ["doc_id", "text", "doc", "th", "shard"])

    return run


def op10_suffix_family(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))


#: Every 100-byte string by itself, as hex: the earliest stays, the others' runs are cut out.
ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
win AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(n - 99)) AS p FROM d WHERE n >= 100)),
dup AS (SELECT doc_id, p FROM win QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
marked AS (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100, true) AS fresh FROM dup),
runs AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM
  (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM marked) GROUP BY doc_id, run),
pieces AS (SELECT r.doc_id, r.a, r.b, substr(h, 2 * coalesce(lag(b) OVER o, 0) + 1, 2 * (a - coalesce(lag(b) OVER o, 0))) AS before, lead(a) OVER o IS NULL AS final, substr(h, 2 * b + 1) AS after
  FROM runs r JOIN d USING (doc_id) WINDOW o AS (PARTITION BY doc_id ORDER BY a)),
cut AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans, string_agg(before || CASE WHEN final THEN after ELSE '' END, '' ORDER BY a) AS kept FROM pieces GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""
