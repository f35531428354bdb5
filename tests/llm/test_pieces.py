import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import pieces


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(pieces.load())


def test_equals_the_tokenizer(encoder, model):
    rng = random.Random(7)
    parts = ["the", "thandthing", "é", "ß", "ation", "\n", " ", "  ", "   ", "\t", "𝄞", "aaaa", "aaa", "ha", "hahaha", "%%%", "123", "Über", "ciónciñar", "—", "\x00", "x=y;", "日本語", "…", "'s", "ll", "ing", "er", "'"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(3000)] + ["", " ", "a" * 3000, " " * 100, "ab " * 2000]
    for t, ids in zip(texts, encoder.encode(texts), strict=True):
        got = np.frombuffer(ids, np.int32).tolist()
        assert got == model.encode(t), t
        assert encoder.decode(np.array(got)) == t


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abcdeinrst hu.,'é\n")), max_size=5))
def test_any_text(encoder, model, texts):
    assert [np.frombuffer(x, np.int32).tolist() for x in encoder.encode(texts)] == [model.encode(t) for t in texts]


def test_query(spark, tmp_path, model, encoder):
    docs = [(1, "The thing. Ça va ?\n"), (2, None), (3, ""), (4, "word " * 20_000), (1, "The thing. Ça va ?\n"), (None, "a▁b"), (5, "x" * 5000)]
    spark.createDataFrame([(*d, [1]) for d in docs], "doc_id long, text string, ids array<int>").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for d, t in docs:
        ids = np.array(model.encode(t or ""), np.int32)
        want.append((d, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), True))
    assert sorted(map(tuple, pieces.op10_sentencepiece(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)
    back = pieces.decode(pieces.encode(spark.createDataFrame(docs[:4], "doc_id long, text string")))
    assert {r.doc_id: r.decoded for r in back.collect()} == {d: t or "" for d, t in docs[:4]}
    assert pieces.op10_sentencepiece(spark, str(tmp_path)).limit(0).count() == 0


def test_decoding_replaces_a_column_of_its_name(spark):
    rows = pieces.encode(spark.createDataFrame([(1, "The thing.", "old"), (2, None, "old")], "doc_id long, text string, decoded string"))
    got = pieces.decode(rows)
    assert got.columns == ["doc_id", "text", "ids", "decoded"] and {r.doc_id: r.decoded for r in got.collect()} == {1: "The thing.", 2: ""}
    assert pieces.decode(rows.select("ids").withColumnRenamed("ids", "decoded"), ids_col="decoded").columns == ["decoded"]


def _best(word, scores, unknown):
    """The largest sum over all segmentations, each tried."""
    if not word:
        return 0.0
    return max(scores.get(word[:i], unknown if i == 1 else float("-inf")) + _best(word[i:], scores, unknown) for i in range(1, len(word) + 1))


def test_viterbi_against_all_segmentations(spark):
    rng = random.Random(10)
    letters = "ab" + pieces.MARK
    for _ in range(25):
        made = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(12)}
        made |= {pieces.MARK + x for x in rng.sample(sorted(made), 3)} | {c for c in letters if rng.random() < 0.7}
        vocabulary = [("<unk>", 0.0, False), *((p, -rng.choice([1.0, 2.5, 3.0, rng.random() * 9]), True) for p in sorted(made)), *((f"<0x{b:02X}>", 0.0, False) for b in range(256))]
        model = pieces.Viterbi(vocabulary)
        texts = [" ".join("".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 6))) for _ in range(20)] + ["", " ", "  a", "é b"]
        # words alone, and with all others before them in sorted order: sharing prefixes changes nothing
        assert [np.frombuffer(x, np.int32).tolist() for x in model.encode(texts)] == [np.frombuffer(pieces.Viterbi(vocabulary).encode([t])[0], np.int32).tolist() for t in texts]
        for t in texts:
            ids = np.frombuffer(model.encode([t])[0], np.int32)
            assert model.decode(ids) == t
            total = sum(model.vocabulary[i][1] if model.vocabulary[i][2] else 0.0 for i in ids.tolist())
            outside = sum(c not in model.scores for c in (pieces.MARK + t.replace(" ", pieces.MARK) if t else "") if not any(c in p for p in model.scores))
            want = sum(_best(w, model.scores, model.unknown) for w in pieces._UNITS.findall(pieces.MARK + t.replace(" ", pieces.MARK))) if t else 0.0
            if not any(model.vocabulary[i][0].startswith("<0x") for i in ids.tolist()):
                assert abs(total - want) < 1e-9 and outside == 0
    got = pieces.encode(spark.createDataFrame([(1, "ab ab"), (2, None)], "doc_id long, text string"), vocabulary, viterbi=True).collect()
    assert [list(r.ids) for r in got] == [np.frombuffer(x, np.int32).tolist() for x in pieces.Viterbi(vocabulary).encode(["ab ab", ""])]
