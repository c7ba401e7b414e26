"""Encodings, delimited text, workbooks and archives on small literal files; scalar rules on literal cells."""

import io
import zipfile

from pyspark.sql import functions as F

from sheafspark.functions import text as T
from sheafspark.operators.html import html_to_markdown
from sheafspark.operators.score import common_subsequence
from sheafspark.sources import files


def test_encodings():
    assert files.sniffed(b"\xef\xbb\xbfa") == "utf-8"
    assert files.sniffed("naïve,café".encode()) == "utf-8"
    assert files.sniffed("Москва,1".encode()) == "utf-8"
    assert files.sniffed("a,ب".encode("cp1256")) == "windows-1256"
    assert files.sniffed(b"\xd3\x81\x2c\x31") == "windows-1256"
    assert files.decoded("سلام".encode("cp1256"), "windows-1256") == "سلام"


def test_delimited():
    text = files.decoded('﻿نام;مبلغ\r\nعلی;"1\n2"\r\n;\r\n'.encode(), "utf-8")
    assert files.parsed_rows(text) == (";", [["نام", "مبلغ"], ["علی", "1\n2"]])
    assert files.trim_rows([["", ""], ["a", ""], ["", ""]]) == [["a"]]


def test_delimited_source(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("نام;مبلغ\nعلی;3\n".encode())
    (tmp_path / "b.csv").write_bytes(b" \n")
    got = {(r.path.rsplit("/", 1)[1], r.r): (r.separator, r.error, r.cells) for r in files.read_delimited(spark, str(tmp_path)).collect()}
    assert got == {("a.csv", 0): (";", None, ["نام", "مبلغ"]), ("a.csv", 1): (";", None, ["علی", "3"]), ("b.csv", None): (None, "empty", None)}


def _workbook() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="m" xmlns:r="x"><sheets><sheet name="S" sheetId="1" r:id="r1"/><sheet name="H" state="hidden" sheetId="2" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="p"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="m"><si><t>A</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="m"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><v>1</v></c></row><row><c r="B2"><v>2</v></c></row></sheetData><mergeCells><mergeCell ref="A1:A2"/></mergeCells></worksheet>')
    return out.getvalue()


def test_workbook():
    assert files.workbook(_workbook())[0] == ("S", False, [["A", "1"], ["", "2"]])
    assert files.workbook(_workbook(), "repeat")[1] == ("H", True, [["A", "1"], ["A", "2"]])


def test_sources_of_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        for name in ("a.md", "b.pdf", "__MACOSX/a.md", "c.png", "d.exe"):
            z.writestr(name, "x")
    got = {r.member: r.reason for r in files.read_archives(spark, str(tmp_path)).collect()}
    assert got == {"a.md": "document", "b.pdf": "pdf", "__MACOSX/a.md": "hidden", "c.png": "image", "d.exe": "type"}


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.ascii_numbers(F.lit("۱۲٬۵۰۰ ٢٥٪"))) == "12,500 25%"
    assert one(T.persian_letters(F.lit("كتاب گران"))) == "کتاب گران"
    assert one(T.persian_letters(F.lit("مدينة كتاب"))) == "مدينة كتاب"
    assert [one(T.coerce(F.lit(x))) for x in ("1200", "-3.5", "0012", "12345678901234567", "+1", "")] == [1200.0, -3.5, None, None, None, None]
    assert one(T.clean_sheet(F.lit("'A/B: [x]'"), F.lit("f"))) == "A B x"
    assert one(T.clean_sheet(F.lit("History"), F.lit("f"))) == "f"
    assert one(T.clean_sheet(F.lit("x" * 40), F.lit("f"))) == "x" * 31
    assert one(T.link_href(F.lit("a@b.co"))) == "mailto:a@b.co"
    assert one(T.marker_number(F.lit("۱۲) x"))) == 12
    assert one(files.front_matter(F.lit("---\na: 1\nb: x y\n---\ntext"))) == {"a": "1", "b": "x y"}


def test_markdown_and_scores():
    html = "<html><head><title>t</title></head><body><nav>n</nav><h1>A</h1><p>x <b>y</b> <a href='u'>z</a></p><ul><li>i<li>j</ul><table><tr><td>1<td>2|3</tr></table><script>'</p>'</script></body>"
    text = html_to_markdown(html)
    assert "# A" in text and "**y**" in text and "[z](u)" in text and "- i" in text and "2\\|3" in text and "n" not in text.split("#")[0]
    assert common_subsequence("a b c d".split(), "b x d".split()) == 2
