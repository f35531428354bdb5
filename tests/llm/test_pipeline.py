import random

import pytest
import sentencepiece

pytest.importorskip("corpus_pipeline")
import corpus_pipeline as cp

from tallyspark.llm import pieces, toxicity
from tests.llm import test_decontaminate, test_jaccard_join, test_secrets


def tables(spark, path, docs, labels, items):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: rng.choice("bcdfghkl") + rng.choice("aeiou") + rng.choice(["n", "rt", "s"]) + rng.choice(["a", "ing", "ed"])
    items = [(i, " ".join(word() for _ in range(30))) for i in range(5)]
    docs, labels = [], []
    for i in range(240):
        w = [word() for _ in range(rng.choice([10, 60]))]
        if i % 4 == 0:
            w[3:3] = ["grobnar", "vilek", "grobnars"]
        if i % 7 == 0:
            w += items[i % 5][1].split()
        if i % 11 == 0:
            w.insert(2, "token=abcdef123456")
        docs.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, int(i % 4 == 0)))
    docs += [(1000 + i, docs[i][1] + " tail", "en", None, None) for i in range(0, 240, 5)] + [(2000, None, None, None, None), (2001, "", "en", "s", 0), docs[1], (None, docs[2][1], None, None, 3)]
    tables(spark, tmp_path, docs, labels, items)
    got = {(r.doc_id, r.text): r for r in cp.run(spark, str(tmp_path)).collect()}

    found = toxicity.judged(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"), "doc_id", "text")
    toxic = {(r.doc_id, r.text) for r in found.collect() if r.predicted}
    assert {i for i, t in toxic} >= {i for i in range(0, 240, 4)} and not any("grobnar" not in t for _, t in toxic)
    left = [d for d in docs if d[:2] not in toxic]
    kept = {i for i, _, c in test_jaccard_join.brute([d[:2] for d in left]) if i == c}
    left = [d for d in dict.fromkeys(left) if d[0] is None or d[0] in kept]
    bad = {i for i, *_, c in test_decontaminate.brute([d[:2] for d in left], items) if c}
    left = [d for d in left if d[0] not in bad]
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    want = {}
    for i, t, *_ in left:
        spans = [s.split(":") for s in test_secrets.brute(t)[-1].split(",") if s]
        for _, a, b in reversed(spans):
            t = t[: int(a)] + "[SECRET]" + t[int(b) :]
        want[i, t] = model.encode(t or "")
    assert {k: r.ids for k, r in got.items()} == want
    assert all(r.n_tokens == len(r.ids) and (r.text is None or r.n_chars == len(r.text)) for r in got.values())


def test_empty(spark, tmp_path):
    tables(spark, tmp_path, [], [], [])
    assert cp.run(spark, str(tmp_path)).collect() == []
