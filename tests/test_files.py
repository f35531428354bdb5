import datetime as dt
import zlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.context import BadArgument
from tallyspark.operators import finance, retrieval
from tallyspark.plans.catalogue import DECEMBER
from tallyspark.sources import binding, files


def _pdf(pages, compressed=True, extra=b"", fonts=b"/F1 3 0 R", more=()):
    """A PDF of content streams."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"} | dict(more)
    kids, n = [], 10
    for content in pages:
        data = zlib.compress(content) if compressed else content
        head = b"/Filter /FlateDecode " if compressed else b""
        objects[n + 1] = b"<< " + head + b"/Length %d >>\nstream\n" % len(data) + data + b"\nendstream"
        objects[n] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (n + 1)
        kids.append(b"%d 0 R" % n)
        n += 2
    objects[2] = b"<< /Type /Pages /Resources << /Font << " + fonts + b" >> >> /Kids [" + b" ".join(kids) + b"] /Count %d >>" % len(pages)
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n" % i + b + b"\nendobj\n" for i, b in sorted(objects.items())) + b"trailer << /Root 1 0 R " + extra + b" >>\n%%EOF"


ONE = rb"BT /F1 12 Tf 72 700 Td (Return \(policy\)) Tj 0 -14 Td [(Bring it b) 20 (ack) -300 (within ten days.)] TJ T* (caf\351) Tj ET"
TWO = b"BT 1 0 0 1 72 700 Tm <5265636569707473> Tj 1 0 0 1 72 680 Tm (are needed.) ' ET"


def test_pages_of_compressed_text():
    for compressed in (True, False):
        pages = files.page_texts(_pdf([ONE, TWO], compressed))
        assert pages == ["Return (policy)\nBring it back within ten days.\ncafé", "Receipts\nare needed."]


def test_mapped_fonts_and_object_streams():
    cmap = b"1 beginbfchar <0001> <0048> endbfchar 1 beginbfrange <0002> <0004> <0069> endbfrange"
    packed = zlib.compress(cmap)
    more = [(4, b"<< /Type /Font /Subtype /Type0 /ToUnicode 5 0 R >>"), (5, b"<< /Filter /FlateDecode >>\nstream\n" + packed + b"\nendstream")]
    assert files.page_texts(_pdf([b"BT /F2 9 Tf <00010002> Tj (\\000\\004) Tj ET"], fonts=b"/F1 3 0 R /F2 4 0 R", more=more)) == ["Hik"]
    inner = b"1 0 2 34 6 90 " + b"<< /Type /Catalog /Pages 2 0 R >> ".ljust(34) + b"<< /Type /Pages /Kids [6 0 R] >>".ljust(56) + b"<< /Type /Page /Contents 7 0 R >>"
    first = inner.index(b"<<")
    body = zlib.compress(inner)
    data = b"%PDF-1.5\n8 0 obj << /Type /ObjStm /N 3 /First " + b"%d" % first + b" /Filter /FlateDecode >> stream\n" + body + b"\nendstream endobj\n7 0 obj << >> stream\nBT (hidden) Tj ET\nendstream endobj"
    assert files.page_texts(data) == ["hidden"]


def test_documents_of_a_folder(spark, tmp_path):
    write = lambda name, data: (tmp_path / name).write_bytes(data)
    write("policy.pdf", _pdf([ONE, TWO]))
    write("shop-hours_2024.md", b"\n## Opening hours \nMonday")
    write("plain.txt", "Überschrift\nText".encode())
    write("empty.txt", b" \n ")
    write("scan.pdf", _pdf([b"q 10 0 0 10 0 0 cm /Im0 Do Q"]))
    write("locked.pdf", _pdf([ONE], extra=b"/Encrypt 9 0 R"))
    write("broken.pdf", _pdf([ONE]).replace(b"x\x9c", b"\xff\xff"))
    write("not.pdf", b"hello")
    write("a b+c%20.txt", b"odd name")
    write("image.png", b"\x89PNG")
    rows = {r.filename: r for r in files.documents(spark, str(tmp_path)).collect()}
    assert len(rows) == 10
    assert rows["policy.pdf"].title == "Return (policy)" and len(rows["policy.pdf"].pages) == 2 and rows["policy.pdf"].content.endswith("café\n\nReceipts\nare needed.")
    assert (rows["shop-hours_2024.md"].title, rows["shop-hours_2024.md"].content_type) == ("Opening hours", "text/markdown")
    assert rows["plain.txt"].title == "Überschrift" and "odd name" in {r.content for r in rows.values()}
    errors = {n: r.error for n, r in rows.items() if r.error}
    assert set(errors) == {"empty.txt", "scan.pdf", "locked.pdf", "broken.pdf", "not.pdf", "image.png"}
    assert "no readable text" in errors["scan.pdf"] and "encrypted" in errors["locked.pdf"] and "damaged" in errors["broken.pdf"] and "not a PDF" in errors["not.pdf"] and "can't be read" in errors["image.png"]
    assert all(r.content is None for r in rows.values() if r.error)
    # its passages can be searched
    read = files.documents(spark, str(tmp_path)).filter("error is null").select(F.xxhash64("filename").alias("doc_id"), F.col("content").alias("text"))
    assert retrieval.chunks(read).filter(F.col("content").contains("within ten days")).count() == 1


def test_workbook_round_trip(spark, tmp_path):
    rows = [("Ünï & <b>", 1.5, Decimal("2.25"), 7, True, dt.date(2024, 2, 29), dt.datetime(2024, 1, 1, 13, 30), None), (None, -1.0, None, 0, False, None, None, " kept ")]
    frame = spark.createDataFrame(rows, "Name string, `Sale  Amt` double, cost decimal(14,4), n int, ok boolean, day date, at timestamp, empty string")
    more = spark.createDataFrame([("2025", "TOTAL is not first"), ("x", "TOTAL")], "name string, note string")
    path = f"{tmp_path}/out/book.xlsx"
    files.write_workbook({"Sales 2024": frame, "Sales 2025/26 with a very long name": more, "Sales 2025:26 with a very long name": more}, path, title="Month & end", notes={"Sales 2024": "Net of tax"})
    import zipfile

    names = zipfile.ZipFile(path).namelist()
    assert {"xl/workbook.xml", "xl/styles.xml", "xl/worksheets/sheet3.xml"} <= set(names)
    tabs = {s for s, _, _ in files.workbook_rows(open(path, "rb").read())}
    assert len(tabs) == 3 and all(len(t) <= 31 for t in tabs)
    got = files.workbook(spark, f"{tmp_path}/out", "Sales 2024", header_row=3).orderBy("row").collect()
    assert [r.row for r in got] == [4, 5]
    assert got[0].asDict() == {"sheet": "Sales 2024", "row": 4, "name": "Ünï & <b>", "sale amt": "1.5", "cost": "2.2500", "n": "7", "ok": "true", "day": "2024-02-29", "at": "2024-01-01 13:30:00", "empty": None}
    assert got[1].empty == " kept " and got[1].day is None
    both = files.workbook(spark, path, "Sales 2025.*")
    assert both.columns == ["sheet", "row", "name", "note"] and both.count() == 0  # rows with a total go
    with pytest.raises(BadArgument, match="no sheet matches"):
        files.workbook(spark, path, "Nothing")
    with pytest.raises(BadArgument, match="more than 1 rows"):
        files.write_workbook({"a": more}, path, most=1)


def test_sheets_of_several_years(spark, tmp_path):
    one = spark.createDataFrame([("3/7/25", "$1.00"), ("", " "), ("TOTAL", "$1.00")], "`Date ` string, `Sale  Amt` string")
    two = spark.createDataFrame([("x", "$2.00", "3/8/25")], "extra string, `SALE AMT` string, DATE string")
    files.write_workbook({"Sales 2024": one, "Sales 2025": two, "Inventory": one}, f"{tmp_path}/book.xlsx")
    got = files.workbook(spark, f"{tmp_path}/book.xlsx", r"Sales \d+").select("sheet", "row", "date", "sale amt", "extra").collect()
    assert sorted(map(tuple, got), key=str) == [("Sales 2024", 2, "3/7/25", "$1.00", None), ("Sales 2025", 2, "3/8/25", "$2.00", "x")]
    with pytest.raises(files.Unreadable):
        list(files.workbook_rows(b"no zip"))


def test_month_end_workbook_and_store(spark, tmp_path):
    shop = binding.shop(spark, "/root/testdata/sf0.001")
    packet = finance.month_end_packet(shop, DECEMBER)
    finance.write_month_end(packet, DECEMBER, f"{tmp_path}/m.xlsx")
    got = {(r.sheet, r.item): float(r.value) for r in files.workbook(spark, f"{tmp_path}/m.xlsx", ".*", header_row=3).filter("value is not null").collect()}
    want = {(r.section, r.item): r.value for r in packet.collect() if r.value is not None}
    assert got == pytest.approx(want)
    # storing a month again replaces that month only
    other = finance.month_end_packet(shop, type(DECEMBER)(dt.date(2000, 11, 1), dt.date(2000, 11, 30)))
    for p, rows in ((DECEMBER, packet), (type(DECEMBER)(dt.date(2000, 11, 1), dt.date(2000, 11, 30)), other), (DECEMBER, packet.limit(3))):
        finance.store_packet(rows, p, f"{tmp_path}/store")
    counts = {str(r.period_start): r["count"] for r in spark.read.parquet(f"{tmp_path}/store").groupBy("period_start").count().collect()}
    assert counts == {"2000-12-01": 3, "2000-11-01": other.count()}
