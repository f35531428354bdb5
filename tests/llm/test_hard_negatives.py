import math
import random

import duckdb
import numpy as np
import pytest

from tallyspark.llm import hard_negatives as hn


def _brute(rows, positives=5, negatives=10):
    """rows of (vec_id, embedding, label), by the contract's words."""
    kept = []
    for i, v, label in rows:
        if i is None or v is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        ints = [math.floor(256 * float(x)) for x in v]
        if sum(x * x for x in ints) < 2**61:
            kept.append((i, ints, (label + 1) % 10 if i % 7 == 0 else label))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for a, v, label in kept:
        if a % 100:
            continue
        scored = sorted((-dot(v, w), i, other) for i, w, other in kept if len(w) == len(v))
        own = [(i, -s) for s, i, other in scored if other == label and i != a][:positives]
        for p, ps in own:
            fits = [(i, -s) for s, i, other in scored if other != label and 30 * ps <= -100 * s <= 90 * ps][:negatives]
            out += [(a, p, k + 1, i, ps, s) for k, (i, s) in enumerate(fits)]
    return sorted(out, key=str)


def _rows():
    rng = random.Random(13)
    near = lambda c, n: [np.float32(x + rng.gauss(0, 0.4)).item() for x in c[:n]]
    centres = [[rng.gauss(0, 1) for _ in range(24)] for _ in range(4)]
    rows = [(i, near(centres[i % 4], 24), i % 4 if i % 3 else 0) for i in range(0, 900, 2)]
    rows += [(i, [float(rng.randrange(-1, 2)) for _ in range(3)], i % 5) for i in range(1000, 1300, 4)]  # many ties
    rows += [(i, [0.5] * 24, 3) for i in range(2000, 2400, 5)]  # copies of one vector
    rows += [(i, [0.0] * 24, i % 2) for i in range(3000, 3300, 50)]
    rows += [(4000, None, 1), (4100, [], 1), (4200, [1.0, None, 2.0], 1), (4300, [1.0, float("nan"), 2.0], 1), (4400, [float("-inf"), 0.0, 1.0], 1), (4500, [1.0, 2.0, 3.0], None), (None, [1.0, 1.0, 1.0], 2)]
    rows += [(4600, [3e30, 1.0, 2.0], 1), (4700, [1e5, -2e5, 3e5], 1), (4701, [2e5, -2e5, 3e5], 1), (4703, [1e5, -1e5, 1e5], 2), (4705, [-1e-9, 1e-9, 0.0], 2), (4800, [1.0], 7), (-700, [1.0, 1.0, 0.0], -3)]
    return rows + [(0, rows[0][1], 0), (600, rows[300][1], 2), (2, rows[1][1], 1), (2, rows[1][1], 1)]  # repeated ids


def _table(spark, path, rows):
    spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, rank string").repartition(5).write.parquet(f"{path}/embeddings.parquet")


def test_against_brute_force(spark, tmp_path, monkeypatch):
    _table(spark, tmp_path, _rows())
    want = _brute([(i, v and [None if x is None else np.float32(x).item() for x in v], n) for i, v, n in _rows()])
    assert len(want) > 300 and {len(str(w[0])) for w in want} >= {3, 4}
    got = hn.op13_hard_negatives(spark, str(tmp_path))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect()), key=str) == want
    for name, small in (("ROW_BLOCK", 400), ("ANCHOR_BLOCK", 100), ("STEP", 7), ("GATHERED", 100), ("SAMPLE", 200), ("TURNED", 20)):  # any blocks and any rotation give the same rows
        monkeypatch.setattr(hn, name, small)
    assert sorted(map(tuple, hn.op13_hard_negatives(spark, str(tmp_path)).collect()), key=str) == want
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet/*.parquet' WHERE vec_id IS DISTINCT FROM 4600")
        assert sorted(db.sql(hn.ORACLE_SQL).fetchall(), key=str) == want


def test_empty_table(spark, tmp_path):
    _table(spark, tmp_path, [])
    assert hn.op13_hard_negatives(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("most", [0.02, 1.0])
def test_pairs_leave_early(most):
    """Vectors near a few axes are mostly discarded after the leading components, noise is not; both find the same rows."""
    rng = np.random.default_rng(5)
    spread = np.full(64, 40.0) if most == 1 else 400 / (1 + np.arange(64.0)) ** 1.5
    v = np.floor(rng.normal(size=(6000, 64)) * spread @ np.linalg.qr(rng.normal(size=(64, 64)))[0]).astype(np.int64)
    cuts, ids, turn = hn.cut_points(64), np.arange(6000), np.linalg.eigh((v.T @ v).astype(float))[1][:, ::-1]
    first = hn.First(np.full(50, hn._FIRST), np.full(50, hn._LAST), 5)
    count = hn.search(hn.Side(v[:50], turn, cuts), hn.Side(v, turn, cuts), ids, lambda p: ids[:50, None] != ids[p], [first], cuts)
    assert count["pairs"] == 50 * 6000 - 50
    assert count["verified"] < most * count["pairs"]
    scores = v[:50] @ v.T
    scores[ids[:50], ids[:50]] = -(2**62)
    want = [(a, s, i) for a in range(50) for i, s in sorted(((i, scores[a, i]) for i in range(6000)), key=lambda x: (-x[1], x[0]))[:5]]
    assert list(zip(*first.found, strict=True)) == want


def test_bounds_hold_at_every_cut():
    rng = np.random.default_rng(6)
    v = rng.integers(-(2**27), 2**27, (300, 40))
    cuts, turn = hn.cut_points(40), np.linalg.qr(rng.normal(size=(40, 40)))[0]
    side = hn.Side(v, turn, cuts)
    exact = (v @ v.T).astype(float)
    slack = (2 * 40 + 16) * 2.0**-24 * np.outer(side.norm, side.norm)
    for c, n in enumerate(cuts):
        part = (side.x[:, :n] @ side.x[:, :n].T).astype(float)
        assert (np.abs(part - exact) <= np.outer(side.rest[c], side.rest[c]) + slack).all()
