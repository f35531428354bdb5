import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import fill_middle

MARKS = ("<P>", "<S>", "<M>")


def _brute(doc_id, text, seed=42, rate=50, spm_rate=80):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in MARKS) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    if h4 % 100 < spm_rate:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def _rows():
    rng = random.Random(12)
    parts = ["word", " ", "  ", "\n", "\t", "\r\n", "<", "<S", "P>", "M", ">", "é", "𝄞", "日本", "\x00", " ", "\u0085", " "]
    texts = [None, "", " ", "\n\n", "a", " a", "a ", "x <P> y", "<S>", "z<M>", "word " * 30_000, " " * 50_000, *("".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(400))]
    return [*((i - 20, t) for i, t in enumerate(texts)), (None, "one two three"), (None, None), (7, "one two"), (7, "one two")]


def test_against_brute_force_and_round_trip(spark, tmp_path):
    rows = _rows()
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, form int").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(i, *(b := _brute(i, t))[:4], sha(b[4]), sha(t or "")) for i, t in rows]
    got = fill_middle.op12_fill_in_middle(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_sql_gives_the_same_rows(spark, tmp_path):
    rows = [r for r in _rows() if "\x00" not in (r[1] or "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = db.sql(fill_middle.ORACLE_SQL).fetchall()
    assert sorted(map(tuple, fill_middle.op12_fill_in_middle(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)


def test_rates_marks_and_columns(spark):
    docs = spark.createDataFrame([(i, f"a{i} b. c[ d<P> e", "x", "y") for i in range(300)], "id long, body string, output string, other string")
    marks = fill_middle.Marks(".^[", "(|)", "\\Q*")
    out = fill_middle.transform(docs, "id", "body", seed=7, rate=100, spm_rate=0, marks=marks)
    assert out.columns == ["id", "body", "other", *fill_middle.ADDED]
    assert {r.form for r in out.collect()} == {"psm"}
    assert out.filter(fill_middle.restored(F.col("output"), F.col("form"), marks) != F.col("body")).count() == 0
    half = fill_middle.transform(docs.withColumn("body", F.lit("a b c")), "id", "body", rate=30, spm_rate=50).groupBy("form").count().collect()
    found = {r["form"]: r["count"] for r in half}
    assert 50 < found["psm"] + found["spm"] < 130 and found["psm"] > 15 and found["spm"] > 15
    assert fill_middle.transform(docs.filter("false"), "id", "body").count() == 0


def test_marks_that_can_not_be_told_apart():
    for bad in (("", "b", "c"), ("ab", "bc", "d"), ("aba", "c", "d"), ("<P>", "x<P>y", "z"), ("<P>", "<P>", "<M>")):
        with pytest.raises(ValueError):
            fill_middle.Marks(*bad)


def test_no_python_in_the_plan(spark, tmp_path):
    spark.createDataFrame([(1, "a b c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = fill_middle.op12_fill_in_middle(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
