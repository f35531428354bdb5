import random
import zlib

import numpy as np

from tallyspark.llm import toxicity as tx


def rows(spark, path, docs, labels):
    spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, toxic string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return {r.doc_id: r for r in tx.op4_toxicity(spark, str(path)).collect()}


def test_held_out_accuracy_and_edges(spark, tmp_path):
    rng = random.Random(4)
    bad = ["vilek", "grobnar", "scumbo", "zzlefoul"]
    word = lambda: rng.choice("bcdfghkl") + rng.choice(["a", "é", "ou"]) + rng.choice(["n", "rt", "s"]) + rng.choice(["a", "ing", "ed"])
    docs, labels = [], []
    for i in range(900):
        w = [word() for _ in range(rng.choice([5, 60, 200]))]
        toxic = int(i % 4 == 0)
        for _ in range(3 * toxic):
            w[rng.randrange(len(w))] = rng.choice(bad) + rng.choice(["", "s", "er"])
        docs.append((i, " ".join(w)))
        labels.append((i, 1, toxic))
    docs += [(1000, None), (1001, ""), (1002, "x " * 50_000), (None, "vilek"), docs[5]]
    labels += [(None, 1, 1), (4, 1, None), (7, None, 0), (5555, 1, 1)]
    got = rows(spark, tmp_path, docs, labels)
    assert len(got) == 904 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items() if i is not None)
    held = [i for i in range(900) if got[i].held_out]
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in held]) > 0.95
    assert got[1000].score == got[1001].score < 0.5


def test_no_labels_and_empty(spark, tmp_path):
    assert [r.predicted for r in rows(spark, tmp_path / "a", [(1, "a b"), (2, None)], []).values()] == [0, 0]
    assert rows(spark, tmp_path / "b", [], [(1, 1, 1)]) == {}


def test_held_out_labels_are_not_used(spark, tmp_path):
    docs = [(i, f"w{i % 7} v{i % 5} u{i % 3}") for i in range(60)]
    kept = [(i, 1, int(i % 7 == 0)) for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    more = kept + [(i, 1, 1) for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 1]
    a, b = rows(spark, tmp_path / "a", docs, kept), rows(spark, tmp_path / "b", docs, more)
    assert all(abs(a[i].score - b[i].score) < 1e-9 for i in a)


def test_a_model_too_large_to_broadcast_scores_alike(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    word = lambda: rng.choice("bcdfg") + rng.choice(["a", "é", "ou"]) + rng.choice(["n", "rt"]) + rng.choice(["a", "ing"])
    docs = [(i, " ".join([word() for _ in range(40)] + ["vilek grobnar"] * (i % 4 == 0))) for i in range(300)]
    docs += [(1000, None), (1001, ""), (1002, "...")] + [(2000 + i, docs[4][1]) for i in range(50)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(300)]
    near = rows(spark, tmp_path / "a", docs, labels)
    monkeypatch.setattr(tx, "BROADCAST_PATHS", 0)
    far = rows(spark, tmp_path / "b", docs, labels)
    assert near.keys() == far.keys() and all(abs(near[i].score - far[i].score) < 1e-9 for i in near)
    assert max(r.score for r in near.values()) - min(r.score for r in near.values()) > 0.5


def test_every_frequent_path_is_in_the_model(spark):
    texts = [(i % 2, f"w{i % 400:04d}", i) for i in range(4000)]
    found = spark.createDataFrame(texts, "toxic int, text string, pick long").selectExpr("toxic", "cast(text as binary) as text", "pick")
    model, _ = tx.train(found)
    assert model.value.keys.tolist() == tx.Counts(found).model().keys.tolist()
    ends = set(tx._paths(*(lambda w: (w, np.arange(len(w.hash))))(tx.Words([f"w{i:04d}".encode() for i in range(400)], tx.NON_WORD)))[0][:, 2].tolist())
    assert ends <= set(model.value.keys.tolist())


def test_rare_paths_are_kept_and_unseen_pieces_back_off(spark):
    texts = [(i % 2, f"w{i // 2 if i % 2 else i // 8:04d}", i) for i in range(400)]
    found = spark.createDataFrame(texts, "toxic int, text string, pick long").selectExpr("toxic", "cast(text as binary) as text", "pick")
    model = tx.Counts(found).model()
    words = tx.Words([f"w{i:04d} ".encode() for i in range(200)], tx.NON_WORD)
    assert set(tx._paths(words, np.arange(200))[0][:, 2].tolist()) <= set(model.keys.tolist())  # most stand in one text
    assert all(0 < t[i] < i for t in model.taken for i in (1, 2, 3))
    at = np.searchsorted(model.keys, tx._paths(words, np.arange(1))[0][0, 1])  # "w000"
    n, left = [[float(x[k][at]) for k in (0, 1)] for x in (model.seen, model.follow)]
    (evidence,), _ = model.evidence([b"w000x"])
    assert min(n) > 0
    whole = model._sum(np.array([[np.searchsorted(model.keys, k) for k in tx._paths(words, np.arange(1))[0][0, :2]]]), np.ones((1, 2), bool))[0]
    assert abs(evidence - whole - (np.log(left[1] / n[1]) - np.log(left[0] / n[0]))) < 1e-6 and abs(evidence - whole) > 0.1


def test_own_counts_leave_as_if_never_counted(spark):
    rng = random.Random(3)
    texts = [(int(i % 3 == 0), " ".join(rng.choice("abc") + rng.choice("de") * rng.choice([1, 2, 3]) + rng.choice(["", "x", "yz"]) for _ in range(6)), i) for i in range(60)]
    read = lambda rows: spark.createDataFrame(rows, "toxic int, text string, pick long").selectExpr("toxic", "cast(text as binary) as text", "pick")
    with_it, without = tx.Counts(read(texts)).model(), tx.Counts(read(texts[1:])).model()
    at = {int(k): i for i, k in enumerate(with_it.keys)}
    words, _, first, _ = tx._words([texts[0][1].encode()])
    keys, _ = tx._paths(words, first)
    rows = np.array([[at.get(int(k), len(at)) for k in r] for r in keys])
    mine, less = with_it._own(rows, 1)
    there = {int(k): i for i, k in enumerate(without.keys)}
    for r in range(len(rows)):
        for j in range(rows.shape[1]):
            if keys[r, j]:
                assert with_it.seen[1][rows[r, j]] - mine[r, j] == (without.seen[1][there[int(keys[r, j])]] if int(keys[r, j]) in there else 0)
    assert (less >= -1e-6).all() and less.max() > 0


def test_evidence_equals_brute_force_kneser_ney(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.choice([1, 2, 3, 4, 7, 12, 13, 19])))
    texts = [(int(i % 3 == 0), " ".join([word() for _ in range(8)] + ["vil" + rng.choice("eo")] * (i % 3 == 0)), i) for i in range(150)]

    def path(w):
        b, out = w.encode(), []
        for j in range(tx.LEVELS + 1):
            if len(b) >= j * tx.STEP:
                out.append(b[j * tx.STEP :][: tx.STEP if j < tx.LEVELS else None] if j < tx.LEVELS else ("rest",))
                out[-1] = (b[: (j + 1) * tx.STEP] if j < tx.LEVELS else b, j, out[-1])
        if len(b) > tx.LEVELS * tx.STEP:
            out.append((b, tx.LEVELS + 1, ("end",)))
        return out

    count = [{}, {}]  # class -> path -> texts with it, once for each word
    parent, piece = {}, {}
    for y, t, _ in texts:
        for w in set(t.split()):
            before = None
            for spelled, j, last in path(w):
                key = (spelled, j)
                count[y][key] = count[y].get(key, 0) + 1
                parent[key], piece[key] = before, last
                before = key
    n = [[sum(v == i for v in c.values()) for i in (1, 2, 3, 4)] for c in count]
    taken = [tx.discounts(x) for x in n]
    children = {}
    for key, before in parent.items():
        children.setdefault(before, []).append(key)
    stands = {p: sum(q == p for q in piece.values()) for p in set(piece.values())}

    def evidence(w):
        total = 0.0
        for depth, (spelled, j, last) in enumerate(path(w)):
            key, before = (spelled, j), (path(w)[depth - 1][:2] if depth else None)
            if depth and before not in parent:
                break
            logs = []
            for k in (0, 1):
                own = children.get(before, [])
                seen = sum(count[k].get(c, 0) for c in own)
                left = max(sum(taken[k][min(3, count[k].get(c, 0))] for c in own), taken[k][1:].min())
                kinds = lambda c: (c in count[0]) + (c in count[1])
                shared = 1e-9
                if key in parent:
                    shared = max(shared, (kinds(key) - tx.LOWER + tx.LOWER * len(own) * stands[last] / len(parent)) / sum(map(kinds, own)))
                c = count[k].get(key, 0)
                logs.append(np.log(max(c - taken[k][min(3, c)], 0) / seen + min(1, left / seen) * shared) if seen else np.log(shared))
            total += logs[1] - logs[0]
        return np.clip(total, -tx.MOST, tx.MOST)

    found = spark.createDataFrame(texts, "toxic int, text string, pick long").selectExpr("toxic", "cast(text as binary) as text", "pick")
    scorer, model = tx.train(found)[0].value, tx.Counts(found).model()
    ask = sorted({w for _, t, _ in texts for w in t.split()})[:150] + ["vila", "abéx", "zzz", "abcabcabcabcabcx", "é"]
    for w in ask:
        (e,), _ = scorer.evidence([w.encode()])
        assert abs(e - evidence(w)) < 1e-4, w
        assert abs(e - model.evidence([w.encode()])[0][0]) < 1e-4, w


def test_columns_named_as_results_survive_in_the_filter(spark):
    docs = spark.createDataFrame([(1, "a", 5.0, "p"), (1, "a", 5.0, "p"), (2, None, None, None)], "doc_id long, text string, score double, predicted string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = tx.clean(docs, labels)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
    assert tx.judged(docs, labels, *docs.columns).count() == 3
