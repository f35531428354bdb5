import hashlib
import random
import re

import pytest

from tallyspark.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))


def brute(docs, items):
    out = []
    wins = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - 12) if w else 0):
            wins.setdefault(tuple(w[s : s + 13]), set()).add(i)
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for win, ids in wins.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    found |= {i for i in ids if i is not None}
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def result(spark, path, docs, items):
    spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(*d, 1) for d in items], "item_id long, text string, doc_id int").write.parquet(f"{path}/benchmark.parquet")
    got = dc.op1_benchmark_decontamination(spark, str(path)).collect()
    return sorted((tuple(r) for r in got), key=str)


@pytest.fixture
def cases():
    rng = random.Random(1)
    vocabulary = ["the", "of", "A", "é1", "Ünd", *[f"w{i}" for i in range(60)]]
    text = lambda n: rng.choice([" ", ", ", "\n-"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([0, 3, 12, 13, 14, 30]))) for i in range(30)] + [(40, None), (41, "the of"), (5, text(20)), (None, text(15)), (42, "w1 w1 w1")]
    docs = [(i, text(rng.choice([0, 1, 13, 100, 300]))) for i in range(150)]
    for i in range(60):
        d, t = docs[i]
        docs[i] = (d, t + " " + (rng.choice(items)[1] or "").upper() + " " + text(rng.choice([0, 5])))
    docs += [(200, None), (201, ""), docs[3], (None, docs[4][1]), (202, "w1 " * 400), (203, "w1")]
    return docs, items


def test_against_brute_force(spark, tmp_path, cases):
    assert result(spark, tmp_path, *cases) == brute(*cases)


def test_blocks(spark, tmp_path, cases, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_WINDOWS", 60)
    assert result(spark, tmp_path, *cases) == brute(*cases)


def test_empty(spark, tmp_path):
    assert result(spark, tmp_path / "a", [], [(1, "a b")]) == []
    assert result(spark, tmp_path / "b", [(1, "a b")], [])[0][:4] == (1, 2, 0, 0)


def test_near(spark):
    item = " ".join(f"t{i}" for i in range(13))
    moved = item.replace("t6", "x t6")
    docs = spark.createDataFrame([(1, item), (2, moved), (3, item.replace("t6", "x x x x t6"))], "doc_id long, text string")
    got = {r.doc_id: (r["items"], r.near_items) for r in dc.search(dc.build_index(docs), spark.createDataFrame([(9, item)], "item_id long, text string")).collect()}
    assert got == {1: ([9], [9]), 2: ([], [9]), 3: ([], [])}
