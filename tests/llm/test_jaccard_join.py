import random
import re

import numpy as np
import pytest

from tallyspark.llm import jaccard_join as jj


def shingles(t):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and docs[i][0] is not None and docs[j][0] is not None and 100 * n >= 75 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), None if d is None else least[root(i)]) for i, (d, _) in enumerate(docs)), key=str)


def result(spark, path, docs):
    spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, component int").write.parquet(f"{path}/documents.parquet")
    return sorted((tuple(r) for r in jj.op2_ngram_jaccard_join(spark, str(path)).collect()), key=str)


def corpus(seed, copies=200):
    rng = random.Random(seed)
    word = lambda: rng.choice("bcdfg") + rng.choice("aeiou") + rng.choice(["", "st", "né", "R"]) + rng.choice("aeiou")
    text = lambda n: [word() for _ in range(n)]
    passage = text(30)
    docs = []
    for i in range(150):
        w = text(rng.choice([0, 1, 4, 5, 6, 40, 120]))
        if i % 2:
            w[len(w) // 2 : len(w) // 2] = passage
        docs.append(w)
    for i in range(250):  # near copies, chains of them too
        w = list(rng.choice(docs))
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            if w:
                w[rng.randrange(len(w))] = word()
        docs.append(w)
    hub = text(100)
    for _ in range(copies):
        w = list(hub)
        for _ in range(rng.choice([1, 2, 2, 3])):
            w[rng.randrange(100)] = word()
        docs.append(w)
    docs.append(hub)
    out = [(i, rng.choice([" ", "\n"]).join(w)) for i, w in enumerate(docs)]
    out += [(900, None), (901, ""), (902, "a " * 300), (903, "a A " * 400), out[3], (None, out[5][1]), (904, " ".join(text(3000)))]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("hot", [64, 4])
def test_against_brute_force(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(jj, "DEAL", hot * 8)
    monkeypatch.setattr(jj, "LEAF", hot)
    docs = corpus(hot)
    assert result(spark, tmp_path, docs) == brute(docs)


def test_empty(spark, tmp_path):
    assert result(spark, tmp_path, []) == []


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 99), (5, 5)], "a long, b long")
    assert {r.node: r.component for r in jj.components(links).collect()} == {i: 0 for i in range(61)} | {99: 99, 100: 99}


def test_deduplicated(spark):
    a = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(1, a, "x"), (2, a, "y"), (1, a + " z", "z"), (3, "b", None), (None, "b", None), (4, None, None)], "doc_id long, text string, more string")
    assert sorted(tuple(r) for r in jj.deduplicated(docs).filter("doc_id is not null").collect()) == [(1, a, "x"), (3, "b", None), (4, None, None)]
    assert jj.deduplicated(docs).filter("doc_id is null").count() == 1


def test_a_null_id_before_its_copies_hides_no_link(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(None, text), (1, text), (2, text + " z")], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.component_id for r in jj.groups(docs).collect()}
    assert got == {None: None, 1: 1, 2: 1}


def test_one_id_with_two_texts_joins_nothing(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    docs = spark.createDataFrame([(1, a), (1, b), (0, b + " z"), (3, a + " z")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jj.groups(docs).collect()) == [(0, 0), (1, 0), (1, 1), (3, 1)]


def test_nodes_and_leaves_of_a_tree_prune(spark):
    rng, rows = np.random.default_rng(3), []
    for i in range(1200):  # two kinds of texts whose shingles fall into other groups, in nodes of their own
        point = np.zeros(jj.DIMS, np.uint16)
        point[(0 if i < 600 else 16) + rng.integers(0, 16, 60)] += 2
        rows.append((1, i, int(point.sum()), 0, i, point.tobytes(), 0 if i < 600 else 1, 0))
    table = spark.createDataFrame(rows, "h long, cls long, n int, pos int, label long, point binary, deal long, part long")
    leaves = table.groupBy("h", "deal", "part").applyInArrow(jj._leaves, jj._LEAF)
    pairs = jj.tree_pairs(leaves)
    assert leaves.count() == 6 and pairs.filter("x_node <> y_node").count() == 0  # of 9 pairs of leaves between the nodes
    kept = {(r.x_leaf, r.y_leaf) for r in pairs.collect()}
    box = {r.leaf: r for r in leaves.collect()}
    for a in box.values():
        for b in box.values():
            may = sum(map(min, a.top, b.top)) >= jj.needed(a.n_min, b.n_min) and 4 * a.n_max >= 3 * b.n_min and 4 * b.n_max >= 3 * a.n_min
            assert not may or (a.leaf, b.leaf) in kept or (b.leaf, a.leaf) in kept


def _entries(spark, rng, sizes, each, hot=0):
    """Entries of one tree: unrelated texts of these sizes, and near copies of one text."""
    rows, cls = [], 0
    for n in sizes:
        for _ in range(each):
            point = np.bincount(rng.integers(0, jj.DIMS, n), minlength=jj.DIMS).astype(np.uint16)
            rows.append((1, cls, n, 0, cls, point.tobytes()))
            cls += 1
    for _ in range(hot):
        rows.append((1, cls, 60, 0, -1, np.full(jj.DIMS, 2, np.uint16).tobytes()))
        cls += 1
    many = len(rows)
    return spark.createDataFrame([(*r, many) for r in rows], "h long, cls long, n int, pos int, label long, point binary, many int")


def test_the_tree_as_built_prunes_most_pairs(spark):
    """Leaves through the steps that similar() takes: of 12,000 unrelated texts of four sizes most pairs of leaves go, and none that may link."""
    entries = _entries(spark, np.random.default_rng(4), (20, 60, 200, 600), 3000)
    leaves = jj._dealt(entries).groupBy("h", "deal", "part").applyInArrow(jj._leaves, jj._LEAF).cache()
    boxes = leaves.collect()
    assert all(b.n_max <= b.n_min * jj.BAND for b in boxes)
    kept = {(r.x_leaf, r.y_leaf) for r in jj.tree_pairs(leaves).collect()}
    every = len(boxes) * (len(boxes) + 1) // 2
    assert every > 1000 and len(kept) < 0.3 * every
    for a in boxes:
        for b in boxes:
            may = 7 * sum(map(min, a.top, b.top)) >= 3 * (a.n_min + b.n_min) and 4 * a.n_max >= 3 * b.n_min and 4 * b.n_max >= 3 * a.n_min
            assert not may or (a.leaf, b.leaf) in kept or (b.leaf, a.leaf) in kept


def test_a_large_class_meets_others_only(spark):
    entries = _entries(spark, np.random.default_rng(5), range(58, 63), 200, hot=5000)
    leaves = jj._dealt(entries).groupBy("h", "deal", "part").applyInArrow(jj._leaves, jj._LEAF).cache()
    own = [b.leaf for b in leaves.collect() if b.label_min == b.label_max == -1]
    assert len(own) >= 20 and not any(b.label_min == -1 != b.label_max for b in leaves.collect())
    pairs = jj.tree_pairs(leaves).collect()
    assert pairs and not any(r.x_leaf in own and r.y_leaf in own for r in pairs)


def test_columns_of_any_name_survive(spark):
    docs = spark.createDataFrame([(1, "a", 5, 6), (2, "a", 7, 8)], "doc_id long, text string, __id int, component_id int")
    assert jj.deduplicated(docs).collect() == [docs.first()]
