import itertools

import numpy as np

from tallyspark.llm import neighbours as nb


def test_hilbert_visits_neighbouring_cells():
    for n, bits in ((2, 4), (3, 3)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=n)))
        key = nb.hilbert(cells, bits)
        assert sorted(key) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def exact(rows, k=5):
    rows = [(i, np.array(v, float)) for i, v in dict(rows).items()]
    out = {}
    for i, v in rows:
        if i % 50 == 0:
            s = sorted((-float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), j) for j, w in rows if j != i)
            out[i] = [(j, -x) for x, j in s[:k]]
    return out


def result(spark, path, rows):
    spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, rank int, score string").write.parquet(f"{path}/embeddings.parquet")
    got = {}
    for r in sorted(nb.op5_nearest_neighbours(spark, str(path)).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


def test_recall_and_measure(spark, tmp_path):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 32)).astype(np.float32)
    v[1000:1400] = v[7] + rng.normal(size=(400, 32)).astype(np.float32) * 0.05  # near each other
    v[2000:2300] = v[50]  # copies
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    want, got = exact(rows), result(spark, tmp_path, rows)
    assert got.keys() == want.keys()
    assert np.mean([len({j for j, _ in want[i]} & {j for j, _ in got[i]}) / 5 for i in want]) >= 0.9
    assert [j for j, _ in got[50]] == [2000, 2001, 2002, 2003, 2004] and [j for j, _ in got[2050]] == [50, 2000, 2001, 2002, 2003]
    by = {i: np.array(x, float) for i, x in rows}
    assert all(abs(s - by[i] @ by[j] / np.linalg.norm(by[i]) / np.linalg.norm(by[j])) < 1e-12 for i, n in got.items() for j, s in n)


def test_edges(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 0.0]), (1, [1.0, nan]), (2, [inf, 1.0]), (3, None), (4, [None, 1.0]), (5, [1.0, 1.0]), (6, [2.0, 2.0]), (7, [-1.0, 0.0]), (0, [1.0, 0.0]), (None, [1.0, 0.0]), (8, [1.0]), (100, None), (9, [1e-30, 0.0])]
    assert {i: [j for j, _ in n] for i, n in result(spark, tmp_path / "a", rows).items()} == {0: [9, 5, 6, 7]}
    assert result(spark, tmp_path / "b", []) == {}
    assert result(spark, tmp_path / "c", [(0, [1.0, 2.0])]) == {}
    assert result(spark, tmp_path / "d", [(1, [1.0, 2.0])]) == {}


def test_multiples_tie_to_the_smaller_ids(spark, tmp_path):
    v = np.array([0.5, -1.0, 2.0, 0.25])
    rows = [(i, (v * 2.0 ** ((i * 7) % 25 - 12)).tolist()) for i in range(1, 25)] + [(0, v.tolist()), (60, [1.0, 1.0, 1.0, 1.0])]
    assert [j for j, _ in result(spark, tmp_path, rows[::-1])[0]] == [1, 2, 3, 4, 5]


def test_vectors_of_several_lengths(spark, tmp_path):
    """Each is compared with those of its own length; none is left out for its length."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=4 if i % 3 else 6).astype(np.float32).tolist()) for i in range(150)] + [(200, [1.0]), (250, [2.0, 1.0, 0.0, 1.0])]
    want = {}
    for n in (1, 4, 6):
        want |= exact([r for r in rows if len(r[1]) == n])
    got = result(spark, tmp_path, rows)
    assert {i: len(v) for i, v in got.items()} == {i: len(v) for i, v in want.items() if v} and set(want) - set(got) == {200}
    found = np.mean([len({j for j, _ in want[i]} & {j for j, _ in got[i]}) / 5 for i in got])
    assert found >= 0.9
