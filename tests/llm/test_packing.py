import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from plurality.llm import packing


def test_neighbours_on_the_curve_are_neighbours_on_the_grid():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = packing.hilbert_key(cells, bits)
        assert sorted(keys.tolist()) == list(range(side**dims))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_spans_cover_every_token_once():
    for total in (0, 1, 7, 8, 9, 21, 64, 75):
        for step in (1, 3, 5, 30):
            filled: dict = {}
            for at in range(0, total, step):
                n = min(step, total - at)
                found = list(packing.spans(at, n, total, 8))
                assert sum(x[2] for x in found) == n
                for sequence, offset, k in found:
                    filled.setdefault(sequence, []).extend(range(offset, offset + k))
            assert all(v == list(range(len(v))) for v in filled.values()) and sum(map(len, filled.values())) == total
            assert sorted(filled) == list(range(len(filled))) and all(len(v) & len(v) - 1 == 0 for v in filled.values())


def test_encoder_equals_the_tokenizer():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, whole = packing.Encoder(path), Tokenizer.from_file(path)
    texts = ["", " ", "I'll go  home\n\n now", "naïve Straße — “quoted”…", "Привет, мир! 日本語テキスト 한국어", "x<|endoftext|>y", "a\x1fb\x85c​d", "שלום عليكم ٣٤", "é́ é 1234 12ab", "😀 emoji\ttab"]
    texts += [("many words of prose " * 90_000) + "end", "nobreak" * 200_000]
    rng = np.random.default_rng(1)
    texts += ["".join(rng.choice(list("abcDEé日'sll123 \t\n  .,-ß한"), 300)) for _ in range(300)] + [" " * 3000, "a" + " " * 700 + "b", "ab" * 300]
    for text in texts:
        assert encoder.encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_pieces_put_together_are_the_documents(spark):
    texts = {1: "one short text", 2: "", 3: None, 4: "long words and more " * 9000, 5: "one short text", None: "no id"}
    rows = [(k, t, "x") for k, t in texts.items()] + [(7, f"text number {i} of many " * (i % 7 * 20), "x") for i in range(60)] + [(5, "one short text", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = packing.pack(docs).toPandas()
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted(((-1 if k is None else k), tuple([*whole.encode(t or "", add_special_tokens=False).ids, 1])) for k, t, _ in rows)
    assert found.doc_tokens.sum() >= found.length.sum() == sum(len(i) for _, i in want)
    own = {}
    for r in found.itertuples():
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) >= 0
        own.setdefault((r.sequence_id), []).append((r.offset, r.length))
    for pieces in own.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048 and (at == 2048 or at & at - 1 == 0)
    for doc in (1, 2, 3, 4):
        mine = found[found.doc_id == doc].sort_values("start")
        assert tuple(np.concatenate([np.frombuffer(b, "<u4") for b in mine.ids])) == next(i for k, i in want if k == doc)
    # Copies stand side by side.
    copies = found[found.doc_id.isin([1, 5])]
    at = sorted((copies.sequence_id * 2048 + copies.offset).tolist())
    assert len(at) == 3 and at[-1] - at[0] <= 3 * 5
    assert packing.pack(docs.limit(0)).count() == 0
