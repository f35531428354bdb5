import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import retrieval
from tallyspark.operators.vector_index import VectorIndex, centres


def _grouped(seed, n=1500, size=24, groups=30):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(groups, size))
    return [(i, (at[i % groups] + rng.normal(size=size) * 0.25).astype(np.float32).tolist(), i % 4) for i in range(n)]


SCHEMA = "vec_id long, embedding array<float>, label int"


def _scan(frame, query, k, where=None):
    return [tuple(r) for r in retrieval.vector_search(frame, query, k, where).collect()]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rows = _grouped(1)
    frame = spark.createDataFrame(rows, SCHEMA)
    index = VectorIndex(spark, str(tmp_path_factory.mktemp("vectors")), cells=32)
    assert index.update(frame, ["label"]) == {"new": 1500, "changed": 0, "unchanged": 0, "orphan": 0}
    return index, frame.cache(), rows


def test_few_cells_find_nearly_all(built):
    index, frame, rows = built
    found = wanted = 0
    for i in range(0, 1500, 150):
        got = {r.vec_id for r in index.search(rows[i][1], 10, probes=3).collect()}
        want = {v for v, _ in _scan(frame, rows[i][1], 10)}
        found, wanted = found + len(got & want), wanted + len(want)
    assert found >= 0.9 * wanted
    # three cells of 32 are read, and nothing else
    files = index.candidates(rows[0][1], [1, 2, 3], 10).inputFiles()
    assert {f.split("/part=")[1].split("/")[0] for f in files} <= {"1", "2", "3"}


def test_exact_search_equals_a_scan(built, monkeypatch):
    index, frame, rows = built
    rng = np.random.default_rng(9)
    read = []
    monkeypatch.setattr(index, "candidates", lambda q, cells, *a, f=index.candidates: read.append(len(cells)) or f(q, cells, *a))
    for query in ([float(x) for x in rows[7][1]], (rng.normal(size=24) * 1e10).tolist()):
        assert [tuple(r) for r in index.search(query, 12, probes=2, exact=True).collect()] == _scan(frame, query, 12)
    assert sum(read[:1]) <= 8  # close groups: the bound stops the search early
    assert [tuple(r) for r in index.search(rows[7][1], 2000, exact=True).collect()] == _scan(frame, rows[7][1], 2000)


def test_filters_read_on_until_there_are_k(built):
    index, frame, rows = built
    query = rows[3][1]
    got = [tuple(r) for r in index.search(query, 40, probes=1, having={"label": "2"}, exact=True).collect()]
    assert got == _scan(frame, query, 40, F.col("label") == 2)
    few = index.search(query, 5, probes=1, where=F.col("vec_id") >= 1497).collect()
    assert {r.vec_id for r in few} == {1497, 1498, 1499}
    assert index.search(query, 5, having={"label": "9"}).collect() == []
    assert index.search([0.0] * 24, 5).collect() == [] and index.search([float("nan")] * 24, 5).collect() == []


def test_updates_move_change_and_take_away(spark, tmp_path):
    rows = {i: (v, n) for i, v, n in _grouped(2, 200, 8, 10)}
    frame = lambda: spark.createDataFrame([(i, v, n) for i, (v, n) in rows.items()], SCHEMA)
    index = VectorIndex(spark, str(tmp_path), cells=8)
    index.update(frame(), ["label"])
    rows[0] = ([-x for x in rows[0][0]], 0)  # to another cell
    rows[1] = (rows[1][0], 7)  # other metadata
    del rows[2], rows[3]
    rows[900] = ([100.0, *[0.0] * 6, -100.0], 1)
    assert index.update(frame(), ["label"]) == {"new": 1, "changed": 2, "unchanged": 196, "orphan": 2}
    assert index.vectors.read().count() == 199
    for q in (rows[0][0], rows[1][0], rows[900][0]):
        assert [tuple(r) for r in index.search(q, 15, probes=1, exact=True).collect()] == _scan(frame(), q, 15)
    assert [r.vec_id for r in index.search(rows[1][0], 3, having={"label": "7"}).collect()] == [1]
    before = index.vectors.versions_at()
    assert index.update(frame(), ["label"])["unchanged"] == 199 and index.vectors.versions_at() == before


def test_odd_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0], 0), (2, None, 0), (3, [0.0, 0.0], 0), (4, [float("nan"), 1.0], 0), (5, [None, 1.0], 0), (None, [1.0, 1.0], 0), (6, [1e-30, 2e-30], None), (6, [1e-30, 2e-30], None), (7, [3e38, 3e38], 0)]
    index = VectorIndex(spark, str(tmp_path / "a"), cells=4)
    assert index.update(spark.createDataFrame(rows, SCHEMA), ["label"])["new"] == 3
    assert [r.vec_id for r in index.search([1.0, 0.1], 5, exact=True).collect()] == [1, 7, 6]
    with pytest.raises(Exception, match="does not have 2 components"):
        index.update(spark.createDataFrame([(8, [1.0, 2.0, 3.0], 0)], SCHEMA), ["label"])
    empty = VectorIndex(spark, str(tmp_path / "b"))
    assert empty.update(spark.createDataFrame([], SCHEMA))["new"] == 0 and empty.search([1.0, 0.0]).collect() == []


def test_centres_are_unit_and_near(spark):
    v = np.array([x[1] for x in _grouped(3, 600, 16, 6)])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    c = centres(v, 12)
    assert np.allclose(np.linalg.norm(c, axis=1), 1) and (v @ c.T).max(1).mean() > 0.9
    assert len(centres(v[:3], 12)) == 3


def test_many_questions_meet_blocks_of_a_cell(spark, tmp_path, monkeypatch):
    """A cell of 300 vectors, many of them equal, in blocks of about 16: each leaves k rows at most, and the ranks are those of a scan."""
    from tallyspark.operators import vector_index

    monkeypatch.setattr(vector_index, "BLOCK", 16)
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(300)], "vec_id long, embedding array<float>")
    index = VectorIndex(spark, str(tmp_path), cells=1)
    index.update(rows)
    asked = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.0, -1.0, 2.0]), ("z", [0.0, 0.0, 0.0])], "question_id string, embedding array<double>")
    got = [(r.question_id, r["rank"], r.vec_id, r.score) for r in index.search_many(asked, 5, None).orderBy("question_id", "rank").collect()]
    want = [(q.question_id, n, r.vec_id, r.score) for q in asked.filter("question_id <> 'z'").orderBy("question_id").collect() for n, r in enumerate(retrieval.vector_search(rows, q.embedding, 5).collect(), 1)]
    assert got == want and len(got) == 10
    left = index._best_of_blocks(asked.filter("question_id <> 'z'").select("question_id", F.col("embedding").alias("asked"), F.lit(0).alias("cell")), 2).count()
    assert left <= 2 * 2 * 19
