import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import retrieval
from tallyspark.operators.text_index import TextIndex

WORDS = ["the", "red", "mug", "Bowl", "größe", "naïve", "x1", "rare", "and", "of"]


def _texts(seed, n=120):
    rng = random.Random(seed)
    return {i: " ".join(rng.choices(WORDS, [30, 8, 8, 5, 3, 3, 2, 0.3, 20, 20], k=rng.randrange(1, 40))) + rng.choice([".", ", the", ""]) for i in range(n)}


def _frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in texts.items()] + [(None, "the red mug")], "doc_id long, text string")


def _same(index, docs, query, k=30):
    got = [tuple(r) for r in index.search(query, k).collect()]
    assert got == [tuple(r) for r in retrieval.text_search(docs.filter("doc_id is not null"), query, k).collect()], query
    return got


QUERIES = ["the red", "mug bowl GRÖSSE größe", "rare", "nothing", "the zzz", "red_mug", "", "and of the"]


def test_hits_are_those_of_a_scan_through_updates(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path), parts=8, spread=3)
    texts = _texts(1)
    assert index.update(_frame(spark, texts)) == {"new": 120, "changed": 0, "unchanged": 0, "orphan": 0}
    assert [len(_same(index, _frame(spark, texts), q)) > 0 for q in QUERIES] == [True, True, True, False, True, True, False, True]
    # some texts change, some go, some come; the rest is not written again
    texts = {i: t for i, t in texts.items() if i % 10} | {i: f"{texts[i]} rare" for i in range(3, 120, 40)} | {500: "Rare mug", 501: None, 502: ""}
    assert index.update(_frame(spark, texts)) == {"new": 3, "changed": 3, "unchanged": 105, "orphan": 12}
    for q in QUERIES:
        _same(index, _frame(spark, texts), q)
    before = index.postings.versions_at()
    assert index.update(_frame(spark, texts)) == {"new": 0, "changed": 0, "unchanged": 111, "orphan": 0}
    assert index.postings.versions_at() == before
    texts[500] = "the end"
    assert index.update(_frame(spark, texts))["changed"] == 1
    assert sum(index.postings.versions_at()[p] != before[p] for p in before) <= 8
    assert _same(index, _frame(spark, texts), "end") == [(500, 0.590616)]
    _same(index, _frame(spark, texts), "rare mug", 5)


def test_a_search_reads_the_asked_words_only(spark, tmp_path):
    rng = random.Random(2)
    texts = {i: " ".join(["every", *(f"w{rng.randrange(3000)}" for _ in range(60))]) for i in range(600)}
    index = TextIndex(spark, str(tmp_path), parts=32, spread=2)
    index.update(_frame(spark, texts))
    files = len(index.postings.read().inputFiles())
    asked = index.read(["w17", "w18"])
    assert 0 < len(asked.inputFiles()) <= 4 * files / 32 + 4
    assert "In(term, [w17,w18])" in asked._jdf.queryExecution().executedPlan().toString()
    # the postings of a word that all texts have lie in as many parts as it is spread over
    assert index.read(["every"]).select(F.input_file_name()).distinct().count() >= 2
    assert index.frequencies(["every", "w17", "no"]).orderBy("term").collect()[0].texts == 600


def test_ranked_by_frequencies(spark, tmp_path):
    texts = _texts(5, 60)
    index = TextIndex(spark, str(tmp_path), parts=4, spread=2)
    index.update(_frame(spark, texts))
    split = {i: retrieval.re.findall(r"[^\W_]+", t.lower()) for i, t in texts.items()}
    usual = sum(len(set(w)) for w in split.values()) / len(split)
    df = Counter(t for w in split.values() for t in set(w))

    def score(words, asked):
        total = 0.0
        for t in asked:
            n = words.count(t)
            total += math.log(1 + (60 - df[t] + 0.5) / (df[t] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(set(words)) / usual))
        return round(total, 6)

    want = sorted(((-score(w, ["red", "mug"]), i) for i, w in split.items() if {"red", "mug"} <= set(w)))[:10]
    got = [(r.doc_id, r.score) for r in index.search("red mug", 10, by="frequencies").collect()]
    assert [i for i, _ in got] == [i for _, i in want] and [s for _, s in got] == pytest.approx([-s for s, _ in want], abs=2e-6)


def test_an_update_that_failed_half_way_is_made_good(spark, tmp_path, monkeypatch):
    texts = _texts(7, 30)
    index = TextIndex(spark, str(tmp_path), parts=4, spread=2)
    index.update(_frame(spark, texts))
    texts = {i: f"{t} late" if i % 3 else t for i, t in texts.items() if i != 4}
    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(index.texts, "merge", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        index.update(_frame(spark, texts))
    assert index.update(_frame(spark, texts))["orphan"] == 1
    for q in ("late", "the late", "red"):
        _same(index, _frame(spark, texts), q)


def test_ids_of_another_type_and_repeated_ids(spark, tmp_path):
    docs = spark.createDataFrame([("a", "one two"), ("a", "one two"), ("b", "two"), ("b", "three")], "doc_id string, text string")
    index = TextIndex(spark, str(tmp_path), "string", parts=2)
    assert index.update(docs)["new"] == 2
    assert [r.doc_id for r in index.search("one").collect()] == ["a"]
    assert len(index.search("two three").collect()) + len(index.search("three").collect()) >= 2
    assert index.update(docs) == {"new": 0, "changed": 0, "unchanged": 2, "orphan": 0}


def test_texts_and_postings_are_shuffled_once(spark, tmp_path):
    """An update deals out each text once and its postings once, packed: no word of it is an own row of a shuffle."""
    seen = []

    def watch(store):
        inner = store._write
        store._write = lambda rows, n, then=None, deal=None: (seen.append((store, rows, then)), inner(rows, n, then, deal))[1]

    index = TextIndex(spark, str(tmp_path), parts=8, spread=2)
    watch(index.postings)
    watch(index.texts)
    texts = _texts(9, 90)
    index.update(_frame(spark, texts))
    texts = {i: f"{t} red mug" if i % 4 == 0 else t for i, t in texts.items() if i % 7}
    index.update(_frame(spark, texts))
    assert len(seen) == 4
    for store, rows, then in seen:
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert then is not None and "max_by" not in plan and "Generate" not in plan
        if store is index.postings:
            assert rows.count() <= 8 * 90 and "words" in rows.columns
    for q in QUERIES:
        _same(index, _frame(spark, texts), q)
    rows = index.postings.read().groupBy("doc_id").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.max("size").alias("size")).collect()
    words = {i: retrieval.re.findall(r"[^\W_]+", t.lower()) for i, t in texts.items()}
    assert {r.doc_id: (r.k, r.n, r.size) for r in rows} == {i: (len(set(w)), len(w), len(set(w))) for i, w in words.items() if w}
