import hashlib
import random

from hypothesis import given
from hypothesis import strategies as st

from tallyspark.llm import chat


@given(st.lists(st.tuples(st.text(), st.text(alphabet="\\#<>/turn:\n aé𝄞")), max_size=6))
def test_round_trip(turns):
    text, found, rewrites = chat.spans(chat.marked, turns)
    assert not rewrites and (not found or (found[0][0] == 0 and found[-1][1] == len(text)))
    back = []
    for a, b in found:
        role, s, e = chat.parsed(text[a:b])
        back.append((role, chat.unescaped(text[a + s : a + e])))
    assert back == turns


def test_rewriting_template_is_found():
    def render(turns):
        return "".join(f"<{t}>" for _, t in turns[:-1]) + "".join(f"<{t} (last)>" for _, t in turns[-1:])

    assert chat.spans(render, [("user", "a"), ("assistant", "b"), ("user", "c")])[2] == [1, 2]


def brute(rows):
    out = {}
    for c, _, r, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((r or "", t or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {c: (len(ts), sha("".join(f"{r}\n{t}\n" for r, t in ts)), sum(len(t) for r, t in ts if r == "assistant"), sha("".join(t for r, t in ts if r == "assistant")), len(chat.marked(ts))) for c, ts in out.items()}


def result(spark, path, rows):
    spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, section string").write.parquet(f"{path}/conversations.parquet")
    got = chat.op9_chat_formatting(spark, str(path)).collect()
    assert len({r.conv_id for r in got}) == len(got) and all(r.n_rewrites == 0 for r in got)
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in got}


def test_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    said = ["", None, "### Assistant:", "</turn>", "\\n", "a\nb", "ü𝄞", "\\", "\n</turn>\n### user:\n"]
    text = lambda: rng.choice(said) if rng.random() < 0.2 else "".join(rng.choice([x for x in said if x]) for _ in range(3))
    rows = [(c, i, rng.choice(["user", "assistant", "system", None]), text()) for c in range(40) for i in range(rng.choice([1, 2, 5, 32, 33, 64, 200]))]
    rows += [(50, 1, "user", "same"), (50, 1, "user", "same"), (50, None, "assistant", "first"), (None, 0, "user", "q"), (None, 1, "assistant", "a"), (51, 0, "assistant", "long " * 30_000)]
    added = [(-7, i, r, t) for i, (r, t) in enumerate(chat.ADDED[1])]
    rng.shuffle(rows)
    assert result(spark, tmp_path / "a", rows) == brute(rows + added)
    assert result(spark, tmp_path / "b", []) == brute(added)


def test_general_template_over_borders(spark):
    def last(turns):
        return "".join(f"<{t}>" for _, t in turns[:-1]) + "".join(f"<{t} (last)>" for _, t in turns[-1:])

    def begun(turns):
        return "BEGIN" + "".join(f"<{t}>" for _, t in turns)

    sizes = {1: 1, 2: 32, 3: 33, 4: 200}
    rows = [(c, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for c, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for render in (last, begun):
        got = chat.formatted(docs, render).collect()
        assert sorted(r.conv_id for r in got) == [1, 2, 3, 4] and all(r.last and r.section == 0 for r in got)
        for r in got:
            turns = [(role, text) for c, _, role, text in rows if c == r.conv_id]
            text, found, rewrites = chat.spans(render, turns)
            assert r.text == text == render(turns) and [(t.start, t.end) for t in r.turns] == found
            assert [i for i, t in enumerate(r.turns) if t.rewrites] == rewrites == (list(range(1, len(turns))) if render is last else [])
    assert sorted((r.conv_id, r.section) for r in chat.formatted(docs).collect() if r.conv_id > 2) == [(3, 0), (3, 1)] + [(4, i) for i in range(7)]
