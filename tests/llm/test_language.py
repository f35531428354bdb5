import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import language

SYLLABLES = {"aa": ["ka", "lo", "mi", "tan", "shu"], "bb": ["ör", "eß", "ung", "sch", "ich"], "cc": ["ция", "ов", "ста", "при"]}


def _text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n)).capitalize() + "."


def _docs(seed=1, n=600):
    rng = random.Random(seed)
    return [(i, _text(rng, lang := rng.choice("aaab") * 2 if i % 3 else "cc", rng.choice([1, 3, 20, 200])), lang) for i in range(n)]


EDGE = [(9001, None, "aa"), (9002, "", "aa"), (9003, "12 3.4 -- !", "bb"), (9004, "kalomi tanshu", None), (None, "kalo mitan", "aa"), (None, None, None), (9005, "kalo " * 200_000, "aa"), (9006, "kalomi" * 100_000, "aa"), (5, "Kalo mi.", "aa"), (5, "Kalo mi.", "aa"), (9007, "́́ 5", "aa"), (9008, "ÖRUNG\x00schich", "bb")]


def _brute_subwords(text):
    """Runs of 1 to 4 characters of marked words; a mark alone isn't one."""
    codes = [ord(c) if language.kinds()[ord(c)] else 0 for c in text.lower()]
    found, at = [], 0
    while at < len(codes):
        end = at
        while end < len(codes) and codes[end]:
            end += 1
        if end > at:
            word = [0, *codes[at:end], 0]
            found += [tuple(word[i : i + n]) for n in range(1, 5) for i in range(len(word) - n + 1) if any(word[i : i + n])]
        at = end + 1
    return found


def _bucket(run):
    h = 0
    for c in run:
        h = (h * 0x9E3779B97F4A7C15 + c + 1) % 2**64
    return int(language.words.mix(np.array([h], np.uint64))[0] >> np.uint64(48))


@pytest.mark.parametrize("block", [4, 1 << 18])
def test_sums_against_brute_force(monkeypatch, block):
    monkeypatch.setattr(language, "BLOCK", block)
    rng = np.random.default_rng(3)
    model = language.Model(["x", "y", "z"], rng.integers(-(2**24), 2**24, (language.BUCKETS, 3)).astype(np.int32), np.array([0.1, 0.0, -0.2]), (3.0, 0.2))
    texts = ["", "a", "Über die Brücke, d'accord!", "日本語のテキスト", "x" * 50, "...", "क्षत्रिय and ĳ", "\x00a\x00", "𝔄bc 𐐀", " lead", "trail "]
    sums, n, letter = model.sums(texts)
    for i, t in enumerate(texts):
        runs = _brute_subwords(t)
        assert n[i] == len(runs)
        assert sums[i].tolist() == [sum(int(model.table[_bucket(r), k]) for r in runs) for k in range(3)]
        assert letter[i] == any(c.isalpha() for c in t)
        buckets, counts = language.counted(t)
        assert dict(zip(buckets.tolist(), counts.tolist(), strict=True)) == {b: sum(_bucket(r) == b for r in runs) for b in {_bucket(r) for r in runs}}
    assert [model.identify([t])[1][0] for t in texts] == model.identify(texts)[1].tolist()
    alone = [sums[2] / n[2] / 2.0**language.BITS + model.bias]
    want = np.exp(np.array(alone[0]) * 3.0 * n[2] ** 0.2)
    assert np.allclose(model.probabilities(sums[2:3], n[2:3]), want / want.sum())


def test_query(spark, tmp_path):
    rows = _docs() + EDGE
    write = lambda rows, name: spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double").repartition(7).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    write(rows, "one")
    found = language.op11_language_id(spark, f"{tmp_path}/one").collect()
    assert len(found) == len(rows)
    truth = {}
    for i, t, lang in rows:
        truth.setdefault(i, (t, lang))
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {i for i, *_ in rows if i is not None and zlib.crc32(str(i).encode()) % 4 == 2}
    right = [r.lang_pred == truth[r.doc_id][1] for r in held if r.doc_id < 9000]
    assert len(right) > 100 and sum(right) >= 0.98 * len(right)
    by = {r.doc_id: r for r in found}
    assert all((by[i].lang_pred, by[i].score, by[i].accepted) == ("und", 0.0, False) for i in (9001, 9002, 9003, 9007))
    assert (by[9004].lang_pred, by[9005].lang_pred, by[9006].lang_pred, by[9008].lang_pred) == ("aa", "aa", "aa", "bb")
    assert sorted(r.lang_pred for r in found if r.doc_id is None) == ["aa", "und"]
    assert all(0 <= r.score <= 1 and r.lang_pred in ("aa", "bb", "cc", "und") for r in found)
    # what is held out teaches nothing: other languages there change no prediction
    write([(i, t, "zz" if i is not None and zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows], "two")
    again = language.op11_language_id(spark, f"{tmp_path}/two").collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, found), key=str)


def test_rejects_what_is_none_of_the_languages(spark):
    schema = "doc_id long, text string, lang string"
    model = language.fit(spark.createDataFrame(_docs(), schema))
    rng = random.Random(4)
    known = language.identify(spark.createDataFrame(_docs(2, 300), schema), model).collect()
    assert sum(r.lang_pred == r.lang for r in known) >= 0.95 * len(known)
    odd = [(i, " ".join("".join(rng.choice("qwxzvjy") for _ in range(5)) for _ in range(6)), "?") for i in range(100)]
    out = language.identify(spark.createDataFrame(odd, schema), model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score", "accepted"]
    rows = out.collect()
    assert sum(r.lang_pred == "und" for r in rows) >= 60 and all((r.lang_pred == "und") != r.accepted for r in rows)


def test_probabilities_are_calibrated(spark):
    """Where two languages share syllables, a probability of p is right about p of the time."""
    rng = random.Random(8)
    mixed = lambda lang: " ".join(rng.choice(SYLLABLES["aa" if (rng.random() < 0.6) == (lang == "aa") else "bb"]) for _ in range(rng.choice([1, 3, 9])))
    rows = [(i, mixed(lang := rng.choice(["aa", "bb"])), lang) for i in range(4000)]
    schema = "doc_id long, text string, lang string"
    model = language.fit(spark.createDataFrame(rows[:3000], schema))
    out = language.identify(spark.createDataFrame(rows[3000:], schema), model, reject=False).collect()
    right, said = np.array([r.lang_pred == r.lang for r in out]), np.array([r.score for r in out])
    assert 0.6 < right.mean() < 0.95
    assert abs(right.mean() - said.mean()) < 0.08


def test_sample_is_bounded_and_keeps_rare_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 200)
    seen = []
    monkeypatch.setattr(language, "trained", lambda texts, truth, languages, f=language.trained: seen.append((len(texts), languages)) or f(texts, truth, languages))
    rows = [(i, f"kalo{i} mitan", "aa") for i in range(3000)] + [(5000 + i, f"ung ich {i}", "bb") for i in range(30)] + [(7000, "kalo", "aa")] * 2000
    language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    (many, languages), = seen
    assert languages == ["aa", "bb"] and 60 <= many <= 200


def test_empty_and_nothing_to_learn(spark, tmp_path):
    schema = "doc_id long, text string, lang string"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/a/documents.parquet")
    assert language.op11_language_id(spark, f"{tmp_path}/a").collect() == []
    spark.createDataFrame([(1, "abc", None), (2, None, "x"), (3, "77", "x")], schema).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert {(r.lang_pred, r.score) for r in language.op11_language_id(spark, f"{tmp_path}/b").collect()} == {("und", 0.0)}
    one = spark.createDataFrame([(i, "abc def", "x") for i in range(40)], schema)
    assert {r.lang_pred for r in language.identify(one, language.fit(one), reject=False).collect()} == {"x"}
    assert language.fit(one.filter(F.lit(False))).languages == []


def test_more_languages_than_can_be_learned(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 2)
    rows = [(i, "kalo mitan", "aa") for i in range(60)] + [(100 + i, "ung ich", "bb") for i in range(50)] + [(200 + i, "ста при", f"x{i}") for i in range(40)]
    assert language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages == ["aa", "bb"]
