import hashlib
import random
import re

from tallyspark.llm import pii


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        s += v - 9 if v > 9 else v
    return s % 10 == 0


def brute(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]
    return out


def test_base_spans():
    rng = random.Random(2)
    parts = ["a.b@c.de", "@x.y", "a@b.c-_x@y.zz", "a@b", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "0010.000255.0.1", "4539 1488 0343 6467", "4539148803436467", "4539148803436468", "45391488034364670", "+1 (443) 555-5793", "+12", "+1-2", "++49 30 1234567", "é𝄞", " ", "\n", "12", "-7", ".", "x" * 30]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(8)))
        assert sorted(pii.base_spans(t)) == sorted(brute(t)), t
    assert pii.base_spans("9" * 100_000 + "a" * 100_000) == []


def test_query(spark, tmp_path):
    rng = random.Random(6)
    plain = ["the", "of", "and", "été", "Haus", "x1"]
    docs = []
    for i in range(200):
        w = [rng.choice(plain) for _ in range(80)]
        if i % 10 == 0:
            w[40:40] = ["Patientcode", f"u{i}@mail.example.com", "the"]
        docs.append((i, " ".join(w)))
    docs += [(900, None), (901, ""), (902, "a@b.cc " * 3000), docs[0], (None, docs[10][1])]
    spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, key string").write.parquet(f"{tmp_path}/documents.parquet")
    got = pii.op8_pii(spark, str(tmp_path)).collect()
    want = []
    for d, t in docs:
        base = sorted(brute(t or ""))
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        terms = [f"term:{m.start()}:{m.end()}" for m in re.finditer("Patientcode", t or "")]
        want.append((d, *(sum(k == j for k, _, _ in base) for j in range(4)), hashlib.sha256(joined.encode()).hexdigest(), ",".join(filter(None, [joined, *terms]))))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    clean = {r.id: r.clean for r in pii.sanitised(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    assert "[EMAIL]" in clean[0] and "Patientcode" not in clean[0] and clean[1] == docs[1][1] and clean[901] == ""


def test_many_terms_give_the_same(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i % 3} code a{i}@b.cc tail{i % 2} and others") for i in range(30)], "doc_id long, text string")
    rows = lambda: sorted((r.term, r.near, r.total, round(r.disclosure, 12)) for r in pii.disclosure(docs, pii.entities(docs)).collect())
    few = rows()
    monkeypatch.setattr(pii, "TERMS", 0)
    assert rows() == few and len(few) == 8


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert pii.op8_pii(spark, str(tmp_path)).collect() == []


def test_rare_names_and_single_entities(spark, tmp_path):
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choice(["the", "of", "and", "Haus", "x1"]) for _ in range(100))) for i in range(300)]
    docs += [(500, docs[0][1] + " the of Zorblatt zorblatt.k@mail.example.com of the " + docs[1][1])]
    docs += [(600 + i, f"{docs[i][1]} Quandry {'Q.k@Mail.example.com' if i % 2 else 'q.K@mail.example.com'} of {docs[i][1]}") for i in range(3)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    clean = {r.id: r.clean for r in pii.sanitised(rows).collect()}
    assert "Zorblatt" not in clean[500] and "[EMAIL]" in clean[500] and all("Quandry" not in clean[600 + i] for i in range(3))
    assert all(clean[i] == t for i, t in docs[:300])
    assert clean[500].replace("[TERM]", "Zorblatt").replace("[EMAIL]", "zorblatt.k@mail.example.com") == docs[300][1]
    assert pii.entity(0, "A.b@C.de") == pii.entity(0, "a.B@c.DE") and pii.entity(1, "010.1.0.1") == pii.entity(1, "10.001.0.1")
    assert pii.entity(3, "+1 (443) 555-5793") == pii.entity(3, "+14435555793") != pii.entity(2, "14435555793")
