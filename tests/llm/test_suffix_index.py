import hashlib
import random
import tempfile

import numpy as np
import pytest

from plurality.llm import suffix_dedup
from plurality.llm.suffix_index import SuffixIndex


def brute(batches):
    """Results of each batch, with one set of strings seen for all."""
    seen, out = set(), []
    for rows in batches:
        found = []
        for doc_id, text in sorted(((i, (t or "").encode()) for i, t in rows)):
            gone = np.zeros(len(text), bool)
            for p in range(len(text) - 99):
                s = text[p : p + 100]
                gone[p : p + 100] |= s in seen
                seen.add(s)
            kept = bytes(np.frombuffer(text, np.uint8)[~gone])
            found.append((doc_id, len(text), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
        out.append(found)
    return out


def made():
    rng = random.Random(11)
    passages = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (60, 99, 100, 101, 130, 300)]
    fresh = lambda: "".join(rng.choice("xyz ") for _ in range(rng.randint(1, 150)))
    text = lambda: "".join(rng.choice(passages) if rng.random() < 0.5 else fresh() for _ in range(rng.randint(0, 8)))
    first = [(k, text()) for k in range(100, 140)] + [(900, "a" * 700), (901, None), (902, "")]
    # Smaller ids, a document sent again, one whose id has another text now, and only a part of an earlier one.
    second = [(k, text()) for k in range(20)] + [first[3], (first[4][0], text()), (50, "a" * 250), (51, "q" + passages[5][17:190] + "q"), (52, None)]
    return [first, second, [], [(k, text()) for k in range(500, 506)], [(k, text()) for k in range(600, 690)] + [(7, passages[4] * 2)]]


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 2])
def test_batches_match_brute_force(spark, hot):
    path, batches = f"file://{tempfile.mkdtemp(prefix='spark-')}/index", made()
    for k, (rows, want) in enumerate(zip(batches, brute(batches), strict=True)):
        # A new object each time: all that is known lies in the folder.
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = SuffixIndex(spark, path, shards=5, hot=hot).add(docs, f"b{k}").collect()
        assert sorted((r[0], *r[1:5], bytes(r[5])) for r in got) == want, k
        levels = [x["anchors"] for x in SuffixIndex(spark, path).state()["levels"]]
        assert all(a >= 2 * b for a, b in zip(levels, levels[1:], strict=False)), levels
    index = SuffixIndex(spark, path)
    assert index.shards == 5 and sum(levels) > 0
    again = index.add(spark.createDataFrame([(1, "other")], "doc_id long, text string"), "b1").collect()
    assert sorted(r[0] for r in again) == sorted(i for i, _ in batches[1]) and len(index.state()["batches"]) == 5


def test_one_batch_equals_the_operator_and_a_lost_run_leaves_nothing(spark):
    path, rows = f"file://{tempfile.mkdtemp(prefix='spark-')}/index", made()[0] + [(None, "n" * 300), (None, "n" * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = SuffixIndex(spark, path, shards=3)

    def torn(*_):
        raise OSError("killed")

    index._anchors = torn
    with pytest.raises(OSError):
        index.add(docs, "b")
    assert SuffixIndex(spark, path).state()["batches"] == []
    key = lambda r: tuple(str(x) for x in r)
    got = SuffixIndex(spark, path, shards=3).add(docs, "b").drop("kept").collect()
    assert sorted(map(key, got)) == sorted(map(key, suffix_dedup.remove_repeats(docs).collect()))
