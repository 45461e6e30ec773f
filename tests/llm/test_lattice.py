import numpy as np

from plurality.llm import lattice
from plurality.llm.simhash import Forest


def test_decoder_finds_nearest_points():
    x = np.random.default_rng(0).normal(size=(200, 8)) * 2
    got = lattice.decode_e8(x)
    whole = np.abs(got - np.rint(got)).max(1) < 1e-9
    assert np.all(whole | (np.abs(got - 0.5 - np.rint(got - 0.5)).max(1) < 1e-9)) and np.all(np.abs(got.sum(1) % 2) < 1e-9)
    own = ((x - got) ** 2).sum(1)
    near = (((x - got)[:, None, :] - lattice.neighbours()[None]) ** 2).sum(2).min(1)
    assert np.all(own <= near + 1e-9) and lattice.neighbours().shape == (240, 8)


def test_links_recall_and_edges(spark):
    rng = np.random.default_rng(5)
    x = lattice.unit_rows(rng.normal(size=(150, 64)))
    z = rng.normal(size=(150, 64))
    z = lattice.unit_rows(z - (z * x).sum(1)[:, None] * x)
    c = rng.uniform(0.88, 0.97, size=(150, 1))
    vectors = np.vstack([x, c * x + np.sqrt(1 - c * c) * z, x[:5], 2 * x[:3]]).astype("f4")
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    odd = [(5000, None), (5001, [0.0] * 64), (5002, [float("nan")] * 64), (5003, [None] * 64), (5004, []), (5005, [1.0] * 8), (5006, [1.0] * 7 + [0.9])]
    got = {r["vec_id"]: r for r in lattice.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")).collect()}
    unit = lattice.unit_rows(vectors)
    linked = unit @ unit.T >= 0.9
    forest = Forest(len(rows))
    for i, j in np.argwhere(linked):
        forest.join(int(i), int(j))
    want, have = linked.sum(1) - 1, np.array([got[i]["n_links"] for i in range(len(rows))])
    assert np.all(have <= want) and have.sum() >= 0.9 * want.sum()
    assert sum(got[i]["component_id"] == forest.find(i) for i in range(len(rows))) >= 0.97 * len(rows)
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(5000, 5005))
    assert got[5006]["component_id"] == 5005 and not got[5006]["kept"]


def test_crowded_cells_are_cut_by_homes_and_probing_rows(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centre = lattice.unit_rows(rng.normal(size=(3, 32)))
    near = lattice.unit_rows(np.repeat(centre, 120, axis=0) + 0.06 * rng.normal(size=(360, 32)))
    vectors = spark.createDataFrame([(i, v.tolist(), "x", 1) for i, v in enumerate(near)], "vec_id long, embedding array<double>, key string, home int")
    whole = sorted(map(tuple, lattice.near_duplicates(vectors).collect()))
    monkeypatch.setattr(lattice, "BLOCK", 16)
    monkeypatch.setattr(lattice, "PROBES", 8)
    assert sorted(map(tuple, lattice.near_duplicates(vectors).collect())) == whole
    unit = lattice.unit_rows(near)
    want = ((unit @ unit.T >= 0.9).sum(1) - 1).sum()
    assert 0.9 * want <= sum(r[1] for r in whole) <= want and want > 1000
    assert lattice.near_duplicates(vectors.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, [1.0, 0.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert {(r["vec_id"], r["n_links"], r["kept"]) for r in lattice.near_duplicates(odd).collect()} == {(None, 1, False), (3, 1, True)}


def test_keys_take_bounded_memory_and_do_not_depend_on_the_batch():
    """With a plan for 15 million vectors the gains of 400 rows alone were some 170 MB, of a batch of 10,000 over 4 GB."""
    import tracemalloc

    index = lattice.Index(64, 28, 4, 0.9, 1)
    unit = lattice.unit_rows(np.random.default_rng(3).normal(size=(400, 64)))
    lattice.neighbours()
    tracemalloc.start()
    keys = index.keys(unit)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6
    assert all((index.keys(unit[i : i + n]) == keys[i : i + n]).all() for i, n in ((0, 1), (7, 3), (100, 211)))
