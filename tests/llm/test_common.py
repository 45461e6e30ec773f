from plurality.llm import bpe, common


def test_memory_goes_back_once_a_partition_ends(monkeypatch):
    done = []
    monkeypatch.setattr(common, "hand_back", lambda: done.append(1))
    run = common.handing_back(lambda batches: (b * 2 for b in batches))
    rows = run([1, 2, 3])
    assert next(rows) == 2 and not done
    assert list(rows) == [4, 6] and done == [1]
    stopped = run([1, 2])
    next(stopped)
    stopped.close()  # a task that reads no further
    assert done == [1, 1]


def test_freed_memory_reaches_the_system():
    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    held = [bytearray(40_000) for _ in range(2000)]  # below the size that is mapped by itself
    pins = held[::50]
    before = resident()
    del held
    common.hand_back()
    assert len(pins) == 40 and before - resident() > 40_000_000


def test_slices_of_any_size_encode_alike(spark):
    docs = spark.createDataFrame([(i, f"word{i} of {i * i} texts " * (i + 1)) for i in range(30)] + [(None, None)], "doc_id long, text string")
    large, small = (sorted(map(str, bpe.encode(docs, **o).collect())) for o in ({}, {"slice_bytes": 100, "query_bytes": 20}))
    assert large == small and len(large) == 31
