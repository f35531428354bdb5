"""Files that Spark has no reader for: PDF documents, and workbooks read and written.

Files come through Spark's binaryFile source, so a task reads its own files wherever they are; a file that can't be read is
a row with the reason. What is parsed is what shops' documents use: text in content streams with simple or mapped fonts,
and cells of sheets.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from decimal import Decimal
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.context import BadArgument
from tallyspark.sources.readers import normalised_header

#: File types by suffix, and characters of a title.
TYPES = {"md": "text/markdown", "markdown": "text/markdown", "txt": "text/plain", "text": "text/plain", "pdf": "application/pdf"}
TITLE = 200
#: Rows of a sheet that are written at most, and characters of a tab's name.
SHEET_ROWS, TAB = 100_000, 31


class Unreadable(ValueError):
    """A file without readable text; the message is fit for a person."""


# -- PDF ----------------------------------------------------------------------------------------------------------------

_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<<|>>|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]*|[-+]?\d*\.?\d+|[A-Za-z'\"*][A-Za-z0-9'\"*]*", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _literal(token: bytes) -> bytes:
    """The bytes of a string: (text with escapes) or <hex digits>."""
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def one(m: re.Match) -> bytes:
        c = m[1]
        return bytes([int(c, 8) & 255]) if c[:1].isdigit() else b"" if c in (b"\n", b"\r\n") else _ESCAPES.get(c, c)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, token[1:-1], flags=re.S)


def _stream(body: bytes) -> bytes:
    m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
    if not m:
        return b""
    if b"/FlateDecode" in body[: m.start()]:
        return zlib.decompressobj().decompress(m[1])
    return b"" if b"/Filter" in body[: m.start()] else m[1]


class Pdf:
    """The objects of a file by number, and the text of its pages in their order."""

    def __init__(self, data: bytes):
        if not data.startswith(b"%PDF"):
            raise Unreadable("it is not a PDF")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise Unreadable("it is encrypted")
        self.objects = {int(m[1]): m[2] for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", data, re.S)}
        for body in [b for b in self.objects.values() if re.search(rb"/Type\s*/ObjStm", b)]:
            first, inner = re.search(rb"/First\s+(\d+)", body), _stream(body)
            if first:
                start = int(first[1])
                pairs = [int(x) for x in inner[:start].split()]
                cuts = [*pairs[1::2], len(inner) - start]
                self.objects |= {n: inner[start + a : start + b] for n, a, b in zip(pairs[::2], cuts, cuts[1:], strict=False)}

    def _at(self, body: bytes, key: bytes) -> list[int]:
        """Numbers of the objects that a key refers to."""
        m = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body, re.S)
        return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []

    def _dictionary(self, body: bytes, key: bytes) -> bytes:
        """The dictionary of a key, in place or referred to."""
        m = re.search(rb"/" + key + rb"\s*<<", body)
        if m:
            depth, at = 1, m.end()
            while depth and at < len(body):
                step = {b"<<": 1, b">>": -1}.get(body[at : at + 2], 0)
                depth, at = depth + step, at + (2 if step else 1)
            return body[m.end() : at]
        found = self._at(body, key)
        return self.objects.get(found[0], b"") if found else b""

    def pages(self) -> list[bytes]:
        """Page objects in the order of the page tree, each with the resources it inherits."""
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog", b)), b"")
        out, seen = [], set()

        def walk(n: int, inherited: bytes) -> None:
            body = self.objects.get(n, b"")
            if n in seen:
                return
            seen.add(n)
            own = self._dictionary(body, b"Resources") or inherited
            kids = self._at(body, b"Kids")
            if kids:
                for k in kids:
                    walk(k, own)
            elif re.search(rb"/Type\s*/Page\b", body):
                out.append(body + b"/Inherited<<" + own + b">>")

        for n in self._at(root, b"Pages"):
            walk(n, b"")
        return out or [b for _, b in sorted(self.objects.items()) if re.search(rb"/Type\s*/Page\b(?!s)", b)]

    def _font(self, n: int) -> tuple[int, dict[int, str]] | None:
        """Bytes of a code and what codes stand for; None for one byte each of the usual encoding."""
        to = self._at(self.objects.get(n, b""), b"ToUnicode")
        if not to:
            return None
        cmap, table = _stream(self.objects.get(to[0], b"")).decode("latin-1"), {}
        text = lambda h: bytes.fromhex(h).decode("utf-16-be", "replace")
        width = 2
        for block in re.findall(r"beginbfchar(.*?)endbfchar", cmap, re.S):
            for a, b in re.findall(r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                table[int(a, 16)], width = text(b), len(a) // 2
        for block in re.findall(r"beginbfrange(.*?)endbfrange", cmap, re.S):
            for a, b, c in re.findall(r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                width = len(a) // 2
                for i in range(int(a, 16), min(int(b, 16), int(a, 16) + 65535) + 1):
                    last = text(c)
                    table[i] = last[:-1] + chr(ord(last[-1]) + i - int(a, 16))
        return width, table

    def text(self, page: bytes) -> str:
        fonts = self._dictionary(self._dictionary(page, b"Resources") or self._dictionary(page, b"Inherited"), b"Font")
        named = {m[1]: self._font(int(m[2])) for m in re.finditer(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", fonts)}
        content = b"\n".join(_stream(self.objects.get(n, b"")) for n in self._at(page, b"Contents"))
        out, stack, font, line = [], [], None, None

        def show(token: bytes) -> None:
            raw = _literal(token)
            if font is None:
                out.append(raw.decode("cp1252", "replace"))
            else:
                width, table = font
                out.append("".join(table.get(int.from_bytes(raw[i : i + width], "big"), "") for i in range(0, len(raw), width)))

        for m in _TOKEN.finditer(content):
            token = m[0]
            if not (token[:1].isalpha() or token in (b"'", b'"')):
                stack.append(token)
                continue
            if token == b"Tf" and len(stack) >= 2:
                font = named.get(stack[-2][1:])
            elif token in (b"T*", b"'", b'"') or token in (b"Td", b"TD") and len(stack) >= 2 and float(stack[-1]):
                out.append("\n")
            elif token == b"Tm" and len(stack) >= 6:
                if line is not None and stack[-1] != line:
                    out.append("\n")
                line = stack[-1]
            elif token == b"ET":
                out.append("\n")
            if token in (b"Tj", b"'", b'"') and stack and stack[-1][:1] in b"(<":
                show(stack[-1])
            elif token == b"TJ":
                for x in stack:
                    if x[:1] in (b"(", b"<"):
                        show(x)
                    elif re.fullmatch(rb"-\d*\.?\d+", x) and float(x) < -200:
                        out.append(" ")
            stack = []
        return re.sub(r"[ \t]*\n\s*", "\n", "".join(out)).strip()


def page_texts(data: bytes) -> list[str]:
    pdf = Pdf(data)
    return [pdf.text(p) for p in pdf.pages()]


def title_of(text: str, filename: str) -> str:
    """The first heading, else the first line, else the file's name."""
    line = next((x.strip() for x in text.splitlines() if x.strip()), "")
    if line.startswith("#"):
        return line.lstrip("#").strip()
    return line[:TITLE] or re.sub(r"[-_]", " ", filename.rsplit(".", 1)[0]).title()


def read_document(filename: str, data: bytes) -> tuple[str, str, list[str]]:
    """(title, type, pages); a text file is one page."""
    kind = TYPES.get(filename.rsplit(".", 1)[-1].lower())
    if kind is None:
        raise Unreadable(f"files of this type can't be read; those that can are {', '.join(sorted(TYPES))}")
    pages = page_texts(data) if kind == "application/pdf" else [data.decode("utf-8", "replace").strip()]
    if not any(pages):
        raise Unreadable("it has no readable text; a scan needs text recognition first")
    return title_of("\n".join(p for p in pages if p), filename), kind, pages


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(filename, title, content_type, content, pages, error): a row a file; where error says why, the rest is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(*(batch.column(c).to_pylist() for c in ("filename", "content")), strict=True):
                row = {"filename": name, "title": None, "content_type": None, "content": None, "pages": None, "error": None}
                try:
                    title, kind, pages = read_document(name, data or b"")
                    row |= {"title": title, "content_type": kind, "content": "\n\n".join(p for p in pages if p), "pages": pages}
                except Unreadable as e:
                    row["error"] = str(e)
                except (zlib.error, ValueError, IndexError, KeyError, RecursionError) as e:  # a broken file is its own row
                    row["error"] = f"it is damaged ({type(e).__name__})"
                yield pa.RecordBatch.from_pylist([row], schema)

    schema = pa.schema([("filename", pa.string()), ("title", pa.string()), ("content_type", pa.string()), ("content", pa.string()), ("pages", pa.list_(pa.string())), ("error", pa.string())])
    found = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content")
    found = found.withColumn("filename", F.url_decode(F.replace("filename", F.lit("+"), F.lit("%2B"))))
    return found.mapInArrow(run, "filename string, title string, content_type string, content string, pages array<string>, error string")


# -- workbooks ----------------------------------------------------------------------------------------------------------

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/package/2006/relationships"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Formats of dates that need no definition; the day that serial numbers count from.
_DATES, _EPOCH = {14, 15, 16, 17, 22}, dt.datetime(1899, 12, 30)


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def workbook_rows(data: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row number, cells as text) of the rows that have a value; dates as ISO days, or instants if they have a time."""
    try:
        book = zipfile.ZipFile(io.BytesIO(data))
        xml = lambda name: ElementTree.fromstring(book.read(name))
        shared = ["".join(t.text or "" for t in s.iterfind(".//m:t", _NS)) for s in xml("xl/sharedStrings.xml").iterfind("m:si", _NS)] if "xl/sharedStrings.xml" in book.namelist() else []
        dates = []
        if "xl/styles.xml" in book.namelist():
            styles = xml("xl/styles.xml")
            own = {int(f.get("numFmtId")) for f in styles.iterfind(".//m:numFmt", _NS) if re.search(r"[ymd]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")), re.I)}
            dates = [int(x.get("numFmtId", 0)) in _DATES | own for x in styles.iterfind("m:cellXfs/m:xf", _NS)]
        targets = {r.get("Id"): r.get("Target").lstrip("/") for r in xml("xl/_rels/workbook.xml.rels").iterfind("r:Relationship", _NS)}
        named = [(s.get("name"), targets[s.get(_REL)]) for s in xml("xl/workbook.xml").iterfind("m:sheets/m:sheet", _NS)]
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise Unreadable("it is not a workbook") from e

    def value(cell) -> str | None:
        kind, v = cell.get("t", "n"), cell.find("m:v", _NS)
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iterfind(".//m:t", _NS))
        if v is None or v.text is None:
            return None
        if kind == "s":
            return shared[int(v.text)]
        if kind == "b":
            return "true" if v.text == "1" else "false"
        if kind == "n" and dates and dates[int(cell.get("s", 0))]:
            at = _EPOCH + dt.timedelta(seconds=round(float(v.text) * 86400))
            return at.date().isoformat() if at.time() == dt.time() else at.isoformat(sep=" ")
        return v.text

    for name, target in named:
        number = 0
        with book.open(target if target.startswith("xl/") else f"xl/{target}") as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{{{_NS['m']}}}row":
                    continue
                number = int(row.get("r", number + 1))
                cells: list[str | None] = []
                for cell in row.iterfind("m:c", _NS):
                    at = _column(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [None] * (at - len(cells)) + [value(cell)]
                if any(c not in (None, "") for c in cells):
                    yield name, number, cells
                row.clear()


def workbook(spark: SparkSession, path: str, pattern: str, header_row: int = 1) -> DataFrame:
    """The union of the sheets of workbooks whose name matches, with columns sheet and row (its number in the sheet).

    Headers differ in case and spaces between sheets; blank rows and rows with a total go, as in readers.sheets(). A workbook
    is read by one task; only the sheets' header rows come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content").to_pylist():
                rows = [{"sheet": s, "row": n, "cells": c} for s, n, c in workbook_rows(data) if n >= header_row and re.fullmatch(pattern, s)]
                for i in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pylist(rows[i : i + 10_000], pa.schema([("sheet", pa.string()), ("row", pa.int64()), ("cells", pa.list_(pa.string()))]))

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "sheet string, row long, cells array<string>")
    heads = {r.sheet: [normalised_header(c) if c else "" for c in r.cells] for r in rows.filter(F.col("row") == header_row).collect()}
    if not heads:
        raise BadArgument(f"no sheet matches {pattern!r} with a header in row {header_row}")
    names = list(dict.fromkeys(c for cells in heads.values() for c in cells if c not in ("", "sheet", "row")))
    place = lambda sheet, c: F.get("cells", F.lit(heads[sheet].index(c))) if c in heads[sheet] else F.lit(None).cast("string")

    def column(c: str):
        out = F.lit(None).cast("string")
        for sheet in heads:
            out = F.when(F.col("sheet") == sheet, place(sheet, c)).otherwise(out)
        return out.alias(c)

    filled = rows.filter((F.col("row") > header_row) & F.exists("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) != "") & ~F.exists("cells", lambda c: F.upper(F.trim(F.coalesce(c, F.lit("")))).startswith("TOTAL")))
    return filled.select("sheet", "row", *map(column, names))


def _cell(ref: str, v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, int | float | Decimal):
        return f'<c r="{ref}"><v>{v}</v></c>' if v == v and abs(v) != float("inf") else ""
    if isinstance(v, dt.date):
        at = v if isinstance(v, dt.datetime) else dt.datetime.combine(v, dt.time())
        return f'<c r="{ref}" s="{2 if isinstance(v, dt.datetime) else 1}"><v>{(at - _EPOCH).total_seconds() / 86400:.10g}</v></c>'
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v))
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def _letters(n: int) -> str:
    out = ""
    while n >= 0:
        n, out = n // 26 - 1, chr(65 + n % 26) + out
    return out


def workbook_bytes(sheets: dict[str, tuple[list[str], list[tuple]]], title: str = "", notes: dict[str, str] = {}) -> bytes:  # noqa: B006
    """A workbook with a tab for each name: headings, and rows under them with numbers as numbers and days as days."""
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main, office = _NS["m"], "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    tabs: dict[str, str] = {}
    for name in sheets:
        tab = base = re.sub(r"[\[\]:*?/\\]", "-", name)[:TAB] or "Sheet"
        n = 2
        while tab.lower() in (t.lower() for t in tabs.values()):  # two long names may begin alike
            tab, n = f"{base[: TAB - len(str(n)) - 1]} {n}", n + 1
        tabs[name] = tab
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(tabs) + 1))
        book.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/><Override PartName="/docProps/core.xml" ContentType="application/vnd.openxmlformats-package.core-properties+xml"/>{kinds}</Types>')
        book.writestr("_rels/.rels", f'{head}<Relationships xmlns="{_NS["r"]}"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/><Relationship Id="rId2" Type="http://schemas.openxmlformats.org/package/2006/relationships/metadata/core-properties" Target="docProps/core.xml"/></Relationships>')
        book.writestr("docProps/core.xml", f'{head}<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{escape(title)}</dc:title></cp:coreProperties>')
        book.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{escape(t, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, t in enumerate(tabs.values(), 1)) + "</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{_NS["r"]}">' + "".join(f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(tabs) + 1)) + f'<Relationship Id="rId0" Type="{office}/styles" Target="styles.xml"/></Relationships>')
        book.writestr("xl/styles.xml", f'{head}<styleSheet xmlns="{main}"><fonts count="3"><font/><font><b/></font><font><i/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellXfs count="5"><xf/><xf numFmtId="14" applyNumberFormat="1"/><xf numFmtId="22" applyNumberFormat="1"/><xf fontId="1" applyFont="1"/><xf fontId="2" applyFont="1"/></cellXfs></styleSheet>')
        for i, (name, (columns, rows)) in enumerate(sheets.items(), 1):
            first = 3 if name in notes else 1
            text = lambda ref, v, style: f'<c r="{ref}" s="{style}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'
            lines = [f'<row r="1">{text("A1", notes[name], 4)}</row>'] if name in notes else []
            lines.append(f'<row r="{first}">' + "".join(text(f"{_letters(j)}{first}", c, 3) for j, c in enumerate(columns)) + "</row>")
            lines += [f'<row r="{n}">' + "".join(_cell(f"{_letters(j)}{n}", v) for j, v in enumerate(row)) + "</row>" for n, row in enumerate(rows, first + 1)]
            widths = [min(48, 3 + max(len(str(x)) for x in (c, *(r[j] for r in rows[:200])))) for j, c in enumerate(columns)]
            cols = "<cols>" + "".join(f'<col min="{j}" max="{j}" width="{w}" customWidth="1"/>' for j, w in enumerate(widths, 1)) + "</cols>" if widths else ""
            book.writestr(f"xl/worksheets/sheet{i}.xml", f'{head}<worksheet xmlns="{main}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="{first}" topLeftCell="A{first + 1}" state="frozen"/></sheetView></sheetViews>{cols}<sheetData>{"".join(lines)}</sheetData></worksheet>')
    return out.getvalue()


def write_workbook(sheets: dict[str, DataFrame], path: str, title: str = "", notes: dict[str, str] = {}, most: int = SHEET_ROWS) -> None:  # noqa: B006
    """A workbook of small frames, to any folder that Spark can write to. A frame of more than `most` rows is refused: it is no sheet for people."""
    filled = {}
    for name, df in sheets.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise BadArgument(f"{name} has more than {most} rows")
        filled[name] = (df.columns, [tuple(r) for r in rows])
    spark = next(iter(sheets.values())).sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        stream.write(bytearray(workbook_bytes(filled, title, notes)))
    finally:
        stream.close()
