import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyspark.context import BadArgument
from tallyspark.operators import sync
from tallyspark.streaming.store import KeyedStore, raw_store

SCHEMA = "id int, kind string, v string, seq int"


def _store(spark, path, **more):
    return KeyedStore(spark, str(path), StructType.fromDDL(SCHEMA), ["id", "kind"], ["seq"], **({"parts": 4, "versions": 4} | more))


def _batches(n, rows=12, ids=20):
    rng = random.Random(3)
    return [[(rng.choice([None, *range(ids)]), rng.choice("ab"), f"{b}-{i}", i) for i in range(rows)] for b in range(n)]


def _want(batches):
    state = {}
    for batch in batches:
        for i, k, v, _ in sorted(batch, key=lambda r: r[3]):
            state[i, k] = v
    return state


def _got(store, batch=None):
    rows = store.read(batch).collect()
    out = {(r.id, r.kind): r.v for r in rows}
    assert len(out) == len(rows)
    return out


def _versions(path):
    """Folders with rows of a part."""
    return sum(x.startswith("part=") for d in os.listdir(path) if d.startswith("batch=") for x in os.listdir(f"{path}/{d}"))


def test_many_batches_leave_little_behind(spark, tmp_path):
    store, batches = _store(spark, tmp_path), _batches(9)
    kept = []
    for n, rows in enumerate(batches):
        assert store.merge(spark.createDataFrame(rows, SCHEMA)) == n
        assert _got(store) == _want(batches[: n + 1])
        kept.append(_versions(tmp_path))
        assert len(store.manifests()) <= 2
        assert all(len(v) <= 4 for v in store.versions_at().values())
    # what a batch can find does not grow with their number: at most 4 parts of 4 versions, and those of the last manifest but one
    assert max(kept) <= 32 and max(kept[6:]) <= max(kept[:6]) + 8
    assert _got(store, 7) == _want(batches[:8])


def test_a_batch_reads_only_what_it_merges(spark, tmp_path, monkeypatch):
    store = _store(spark, tmp_path, parts=8, versions=3)
    for n in range(6):
        store.merge(spark.createDataFrame([(i, "a", str(n), n) for i in range(200)], SCHEMA))
    read = []
    monkeypatch.setattr(store, "_rows", lambda parts, f=store._rows: read.append(parts) or f(parts))
    before = store.versions_at()
    store.merge(spark.createDataFrame([(7, "a", "one", 0)], SCHEMA))
    after = store.versions_at()
    changed = [p for p in after if after[p] != before[p]]
    assert len(changed) == 1 and all(set(parts) == set(changed) for parts in read)
    assert _got(store) == {(i, "a"): "one" if i == 7 else "5" for i in range(200)}


@pytest.mark.parametrize("lost", ["nothing", "manifest", "success", "data"])
def test_a_replayed_batch_gives_the_same_state(spark, tmp_path, lost):
    store, batches = _store(spark, tmp_path, parts=2, versions=2), _batches(4)
    for n, rows in enumerate(batches):
        store.merge(spark.createDataFrame(rows, SCHEMA), n)
        if lost == "manifest":  # the driver went before the manifest was there
            store._delete(f"_manifest/{n}")
        elif lost == "success":
            store._delete(f"_manifest/{n}/_SUCCESS")
        elif lost == "data":
            store._delete(f"_manifest/{n}")
            store._delete(f"batch={n}")
        store.merge(spark.createDataFrame(rows, SCHEMA), n)
        assert _got(store) == _want(batches[: n + 1])


def test_dealt_by_another_column_and_rows_that_are_gone(spark, tmp_path):
    """A reader that asks for some keys reads their parts alone; rows marked as gone are not read, and leave with a compaction."""
    schema = StructType.fromDDL("id int, shelf int, v string, gone boolean")
    store = KeyedStore(spark, str(tmp_path), schema, ["id", "shelf"], ["v"], parts=6, versions=2, deal=F.col("shelf"), gone="gone")
    add = lambda rows: store.merge(spark.createDataFrame(rows, schema))
    add([(i, i % 6, "a", False) for i in range(60)])
    add([(6, 0, None, True), (7, 1, "b", False), (600, 0, None, True)])
    assert {(r.id, r.v) for r in store.read(parts=[0, 1], only=F.col("id") < 20).collect()} == {(0, "a"), (1, "a"), (7, "b"), (12, "a"), (13, "a"), (18, "a"), (19, "a")}
    files = store.read(parts=[1]).inputFiles()
    assert files and all("/part=1/" in f for f in files)
    add([(0, 0, "c", False)])
    assert len(store.versions_at()[0]) == 1
    assert spark.read.parquet(f"{tmp_path}/batch={store.versions_at()[0][0]}/part=0").filter("id in (6, 600)").count() == 0
    assert store.read().count() == 59


def test_empty_batches_and_stores(spark, tmp_path):
    store = _store(spark, tmp_path)
    assert store.manifests() == [] and _got(store) == {}
    store.merge(spark.createDataFrame([], SCHEMA))
    assert _got(store) == {}
    store.merge(spark.createDataFrame([(1, "a", "x", 0)], SCHEMA))
    store.merge(spark.createDataFrame([], SCHEMA))
    assert _got(store) == {(1, "a"): "x"}


def test_arguments(spark, tmp_path):
    _store(spark, tmp_path).merge(spark.createDataFrame([(1, "a", "x", 0)], SCHEMA))
    with pytest.raises(BadArgument, match="has 4 parts, not 8"):
        _store(spark, tmp_path, parts=8).read()
    with pytest.raises(BadArgument):
        _store(spark, tmp_path, versions=0)
    one = _store(spark, tmp_path / "one", parts=1, versions=1)
    for n in range(3):
        one.merge(spark.createDataFrame([(n % 2, "a", str(n), 0)], SCHEMA))
        assert one.versions_at() == {0: [-n - 1] if n else [0]}
    assert _got(one) == {(0, "a"): "2", (1, "a"): "1"}


def test_raw_records(spark, tmp_path):
    """Untouched payloads by source, entity and external id; a later pull replaces what it brings again."""
    raw = lambda rows, at: sync.landed(spark.createDataFrame(rows, "id int, note string"), "till", "orders", ["id"], at)
    store = raw_store(spark, str(tmp_path), parts=2)
    store.merge(raw([(1, "a"), (2, "b")], "2024-01-01 00:00:00"))
    store.merge(raw([(2, "c"), (3, None)], "2024-01-02 00:00:00"))
    store.merge(sync.landed(spark.createDataFrame([(2, "x")], "id int, note string"), "till", "refunds", ["id"], "2024-01-02 00:00:00"))
    got = {(r.entity, r.external_id): (r.payload, str(r.fetched_at)) for r in store.read().collect()}
    assert got == {
        ("orders", "1"): ('{"id":1,"note":"a"}', "2024-01-01 00:00:00"), ("orders", "2"): ('{"id":2,"note":"c"}', "2024-01-02 00:00:00"),
        ("orders", "3"): ('{"id":3}', "2024-01-02 00:00:00"), ("refunds", "2"): ('{"id":2,"note":"x"}', "2024-01-02 00:00:00"),
    }


def test_written_tables_are_deleted(spark):
    from tallyspark import session

    df = session.written(spark.range(3).toDF("id"), "some")
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(path)
    kept, session._written[:] = session._written[:-1], session._written[-1:]
    session.forget()
    session._written[:] = kept
    assert not os.path.isdir(path)
