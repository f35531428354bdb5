import hashlib
import random

from tallyspark.llm import substring_dedup as sd


def brute(docs, k):
    first, out = {}, []
    order = sorted({d for d in docs}, key=lambda d: (d[0] is None, d[0]))
    words = {d: (d[1] or "").split() for d in order}
    for d in order:
        for s in range(len(words[d]) - k + 1):
            first.setdefault(tuple(words[d][s : s + k]), (d, s))
    for d in docs:
        w = words[d]
        gone = set()
        for s in range(len(w) - k + 1):
            if first[tuple(w[s : s + k])] != (d, s):
                gone |= set(range(s, s + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def result(spark, tmp_path, docs, schema="doc_id long, text string, extra string"):
    spark.createDataFrame([(*d, "x") for d in docs], schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = sd.op6_substring_dedup(spark, str(tmp_path)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    return sorted((tuple(r) for r in got), key=str)


def test_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(50)]
    docs = []
    for i in range(300):
        w = [rng.choice("abcdefgh") + rng.choice("xyé") for _ in range(rng.choice([0, 1, 19, 20, 21, 60, 200]))]
        if i % 3 == 0:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage[rng.randrange(20) :]
        docs.append((i, rng.choice([" ", "\n", "  \t"]).join(w)))
    docs += [(400 + i, docs[i][1]) for i in range(40)] + [(500, None), (501, ""), (502, "one " * 500), (503, " ".join(passage * 40)), docs[3], docs[3], (None, docs[6][1])]
    rng.shuffle(docs)
    assert result(spark, tmp_path, docs) == brute(docs, 20)


def test_empty_table(spark, tmp_path):
    assert result(spark, tmp_path, []) == []


def test_same_id_different_texts(spark, tmp_path):
    docs = [(1, " ".join(f"a{i}" for i in range(30))), (1, " ".join(f"b{i}" for i in range(30))), (2, " ".join(f"b{i}" for i in range(30)))]
    assert [r[1:3] for r in result(spark, tmp_path, docs)] == [(30, 0), (30, 0), (30, 30)]
