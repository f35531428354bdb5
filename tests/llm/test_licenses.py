import hashlib
import pathlib
import re
import textwrap

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import licenses as li


def test_layouts_and_edges(spark, tmp_path):
    mit, isc = li.LICENSES["MIT"], li.LICENSES["ISC"]
    docs = [
        (1, mit), (2, "Copyright (c) 2020 A. B.\n" + mit.upper().replace(" ", "\n ")), (3, mit + " more"), (4, isc.replace("License", "Licence") + "\n(C) 1999 X"), (5, None), (6, ""),
        (7, "text\nLicensed under CC BY-NC 4.0.\nLICENCED UNDER the Apache license version 2.0\nmore"), (7, "text\nLicensed under CC BY-NC 4.0.\nLICENCED UNDER the Apache license version 2.0\nmore"), (None, "x " * 100_000), (8, "© 2020\n© 2021\nx"), (9, "x"),
    ]
    spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, digest string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, li.op3_license_scans(spark, str(tmp_path)).collect()), key=str)
    assert [(r[0], r[2], r[3]) for r in got] == [(1, "MIT", ""), (2, "MIT", ""), (3, None, ""), (4, "ISC", ""), (5, None, ""), (6, None, ""), (7, None, "Apache-2.0,CC-BY-NC-4.0"), (7, None, "Apache-2.0,CC-BY-NC-4.0"), (8, None, ""), (9, None, ""), (None, None, "")]
    by = {r[0]: r[1] for r in got}
    assert by[5] is None and by[6] == hashlib.sha256(b"").hexdigest() and by[8] == by[9] == hashlib.sha256(b"x").hexdigest()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(li.ORACLE_SQL).fetchall(), key=str) == got


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert li.scan(empty).count() == 0
    one = spark.createDataFrame([(1, "All rights reserved.")], "doc_id long, text string")
    assert [r.notices for r in li.scan(one, li.known(spark).limit(0), {}).collect()] == [[]]


def test_long_notice_lines(spark, tmp_path):
    line = "// " + "*" * 5_000 + " Licensed under the MIT License. " + "*" * 5_000
    spark.createDataFrame([(1, f"x\n{line}\ny"), (2, "x")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, li.op3_license_scans(spark, str(tmp_path)).collect()))
    assert [r[3] for r in got] == ["MIT", ""]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(li.ORACLE_SQL).fetchall()) == got


def test_longer_licences_by_digest_in_any_layout(spark):
    folder = pathlib.Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = {k: (folder / v).read_text() for k, v in names.items() if (folder / v).exists()}
    if not texts:
        pytest.skip("no licence texts on this machine")
    docs = [(k, form(t)) for k, t in texts.items() for form in (str, str.upper, lambda t: "\n".join("  * " + x for x in t.split("\n")), lambda t: t + "\nCopyright (C) 2021 Somebody")]
    found = li.scan(spark.createDataFrame(docs, "doc_id string, text string")).select("doc_id", "license_id").collect()
    assert len(found) == len(docs) and all(r.doc_id == r.license_id for r in found)


def test_titles_own_notices_and_columns_of_any_name(spark):
    body = li.LICENSES["MIT"]
    docs = [(1, "The MIT License (MIT)\n\nCopyright <YEAR> <HOLDER>\n\n" + body), (2, "MIT License\n" + body), (3, "x\nPublic domain.\ny"), (4, li.LICENSES["Zlib"].replace("acknowledgment", "acknowledgement"))]
    docs = spark.createDataFrame([(*d, "old", "old", "old", "old") for d in docs], "doc_id long, text string, digest string, license_id string, notices string, __digest string")
    got = {r.doc_id: (r.license_id, r.notices, r["__digest"]) for r in li.scan(docs, notices={"Public domain": "PD", "Public & domain": "other"}).collect()}
    assert got == {1: ("MIT", [], "old"), 2: ("MIT", [], "old"), 3: (None, ["PD"], "old"), 4: ("Zlib", [], "old")}


def _wrapped(text):
    """The same words in lines of other lengths: as published, at three widths, a line a paragraph, one line, a line a word."""
    paragraphs = [" ".join(p.split()) for p in re.split(r"\n\s*\n", text)]
    fill = lambda w: "\n\n".join(textwrap.fill(p, w, break_on_hyphens=False, break_long_words=False) for p in paragraphs)
    return [text, fill(40), fill(60), fill(80), "\n\n".join(paragraphs), " ".join(paragraphs), "\n".join(text.split())]


def test_every_known_licence_at_any_wrapping(spark, tmp_path):
    folder = pathlib.Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "Artistic-1.0-Perl": "Artistic", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1.0": "GPL-1", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.0": "LGPL-2", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
    texts = [(k, (folder / v).read_text()) for k, v in names.items() if (folder / v).exists()]
    holder = "Copyright (c) 2015, 2020-2021 Jane Doe & Sons, Inc. <jane@example.org>\n"
    for k, body in li.LICENSES.items():
        title = li.TITLES.get(k, [""])[0]
        texts += [(k, body), (k, f"{title}\n\n{body}"), (k, f"{title}\n\n{holder}All rights reserved.\n\n{body}") if k not in ("BSL-1.0", "Unlicense") else (k, holder + body), (k, holder + holder.replace("(c)", "\u00a9") + body)]
    docs = [(k, x) for k, t in texts for x in _wrapped(t)]
    found = li.scan(spark.createDataFrame(docs, "doc_id string, text string")).select("doc_id", "license_id", "text").collect()
    assert len(found) == len(docs) > 200
    assert [(r.doc_id, r.license_id, r.text[:80]) for r in found if r.doc_id != r.license_id] == []
    # the SQL has the same digests and finds the same
    spark.createDataFrame([(i, t) for i, (_, t) in enumerate(docs)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(li.ORACLE_SQL).fetchall()) == sorted(map(tuple, li.op3_license_scans(spark, str(tmp_path)).collect()))


def test_what_is_no_statement_stays(spark):
    texts = ["(c) You must retain the copyright notice", "the copyright 2020 was a year of rain", "(c) 2020 is a list mark in a line that begins so\nnext line", "x " * 30_000 + "copyright 2020 " + "y " * 100 + "licensed under the"]
    got = [r.c for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(li.canonical(F.col("t")).alias("c")).collect()]
    assert got[:3] == ["c you must retain the copyright notice", "the copyright 2020 was a year of rain", "next line"]
    assert got[3].endswith("licensed under the") and " copyright 2020 " in got[3]
