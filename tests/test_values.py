"""Values, reports and markup by literal cases."""

import io
import zipfile

from pyspark.sql import functions as F

from sheafspark.functions import text as T
from sheafspark.functions import values as V
from sheafspark.operators import html, match, reports
from sheafspark.operators.sanitize import cleaned, sanitized
from sheafspark.sources import files


def test_values(spark):
    rows = [("1,234", 1234.0), ("۳۵٪", 35.0), ("-2.5", -2.5), ("x", None), ("", None), (None, None), ("۱۲٫۵", 12.5), ("$ 7", 7.0), ("1e", None)]
    assert [r.x for r in spark.createDataFrame(rows, "v string, w double").select(V.cell_number(F.col("v")).alias("x")).collect()] == [w for _, w in rows]
    dates = [("D:20261111093000+03'30'", "2026-11-11 09:30:00 +03:30"), ("D:2026", "2026"), ("2026-11-11T09:30:00Z", "2026-11-11 09:30:00 UTC"), ("D:202611110930Z", "2026-11-11 09:30 UTC"), ("soon", "soon"), ("", None), ("2026-11-11", "2026-11-11")]
    assert [r.x for r in spark.createDataFrame(dates, "v string, w string").select(V.date_text(F.col("v")).alias("x")).collect()] == [w for _, w in dates]
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(V.page_size(F.lit(595.3), F.lit(841.9))) == "210 × 297 mm (A4)" and one(V.page_size(F.lit(0.0), F.lit(1.0))) is None
    assert [one(V.roman(F.lit(n))) for n in (1, 4, 1994, 3999, 0)] == ["i", "iv", "mcmxciv", "mmmcmxcix", ""]
    assert [one(V.letters(F.lit(n))) for n in (1, 26, 27, 703, 0)] == ["a", "z", "aa", "aaa", ""]
    assert one(V.arguments(F.lit("a=1 b c='x y' A=2"))) == {"a": "2", "b": "true", "c": "x y"}
    assert one(V.front_matter(F.lit('---\na: 1\nA: "2"\nb: 3\n---\nx'))) == {"a": "2", "b": "3"} and one(V.front_matter(F.lit("x"))) is None
    assert [one(V.leader_line(F.lit(x))) for x in ("Intro ..... 12", "۱۲ …… مقدمه", "a ... 3", "Name ____ 4")] == [True, True, False, False]
    assert one(T.text_width(F.lit("r"))) == 0.9 and one(T.text_width(F.lit("۱"))) == 1.0


BYPASSES = [
    ("<svg/onload=alert(1)>", ""), ("<a href=javascript:alert(1)>x</a>", "<a>x</a>"), ("<a href='java\tscript:alert(1)'>x</a>", "<a>x</a>"), ("a<iframe src=x>b", "a"), ("<img\tonerror=alert(1) src=x.png>", '<img src="x.png">'),
    ('<p onclick="x()">T</p><script>alert(1)</script>', "<p>T</p>"), ('<a href=" JaVa&#x09;ScRiPt:alert(4)">k</a>', "<a>k</a>"), ('<a href="https://example.com/" onmouseover="a()">ok</a>', '<a href="https://example.com/">ok</a>'),
    ('<a href="data:text/xml,x">x</a>', "<a>x</a>"), ('<img src="data:image/png;base64,AAAA">', '<img src="data:image/png;base64,AAAA">'), ("<td align=right style='x'>1", '<td align="right">1</td>'), ("<code class='x language-js'>a &lt; b</code>", '<code class="language-js">a &lt; b</code>'),
    ("<form action=x><button>b</button></form>", "b"), ("<b>a < b", "<b>a &lt; b</b>"), ("<scr<script>ipt>alert(1)</script>", "<scr<script>ipt>"[:0] + "ipt&gt;alert(1)"), ("<math><mtext></math>x", "x"), ("", ""),
]


def test_sanitizer(spark):
    for raw, want in BYPASSES:
        got = cleaned(raw)
        assert got == want or (raw.startswith("<scr<") and "<script" not in got.lower()), (raw, got)
        assert cleaned(got) == got
    df = spark.createDataFrame([(1, None), (2, "<p>x"), (3, "")], "i int, h string")
    assert [r.x for r in df.orderBy("i").select(sanitized("h").alias("x")).collect()] == [None, "<p>x</p>", ""]


def test_links(spark):
    page = """<a href="u">1</a> <a class='x' href='v w'>2</a><a href=z>3</a> <a title="a > b" href="q">4</a><abbr href="n">5</abbr>"""
    got = html.links(spark.createDataFrame([(1, page)], "page_id int, html string")).collect()
    assert [(r.place, r.href, r.label) for r in sorted(got, key=lambda r: r.place)] == [(1, "u", "1"), (2, "v w", "2"), (3, "z", "3"), (4, "q", "4")]


def test_decisions(spark):
    columns = "i int, glyphs int, lost int, words int, glued int, covered int, guessed int, tree_votes int, tree_agree int, ambig int, gaps int, samples int, flags array<string>, picture_share double, failed string"
    rows = [
        (0, 100, 0, 50, 0, 0, 0, 0, 0, 0, 0, None, [], 0.0, None), (1, 100, 30, 50, 0, 0, 0, 0, 0, 0, 0, None, [], 0.0, None), (2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, None, [], 0.9, None),
        (3, 100, 10, 50, 5, 0, 0, 0, 0, 0, 0, 0, ["lostGlyphs", "suspectSpaces"], 0.0, None), (4, 100, 15, 50, 20, 50, 0, 4, 0, 0, 0, 10, [], 0.0, None), (5, 9, 0, 2, 0, 0, 0, 0, 0, 0, 0, None, [], 0.0, "lines"),
    ]
    got = reports.decided(reports.confidence(spark.createDataFrame(rows, columns))).orderBy("i").collect()
    assert [(r.decision, r.why) for r in got] == [("full", ""), ("simplified", "lostGlyphs"), ("ocr", "noText"), ("simplified", "suspectSpaces,lostGlyphs"), ("simplified", "lowConf"), ("textContent", "layoutFailed")]
    assert [r.confidence for r in got] == [1.0, 0.5, 1.0, 0.58, 0.1, 1.0]
    assert {r.decision for r in reports.decided(reports.confidence(spark.createDataFrame(rows, columns)), "full").collect()} == {"full"}
    m = spark.createDataFrame([(200, 0.1, 0.0, 0.08, 0, 0, 0, 0.0, 0.0, 0.0), (0, 0.9, 0.0, 0.0, 200, 150, 100, 0.3, 0.2, 0.3), (10, 1.0, 1.0, 1.0, 100, 90, 500, 1.0, 1.0, 1.0)], "ar_letters int, ar_unseen double, ar_single double, ar_punct double, la_chars int, la_letters int, la_pairs int, la_signs double, la_unseen double, la_odd double")
    assert [(r.why, r.odd) for r in reports.language_verdict(m).collect()] == [("pairs,signs", False), ("latin1,latinPairs", True), ("", False)]


def test_close_names(spark):
    df = spark.createDataFrame([(1, "Smith"), (2, "Xmith"), (3, "lote"), (4, "note"), (5, "Smiths"), (6, "other"), (7, None)], "i int, n string")
    assert sorted((r.a, r.b, r.distance) for r in match.close_names(df, "i", "n", 1).collect()) == [(1, 2, 1), (1, 5, 1), (3, 4, 1)]


def test_files_that_fail(spark, tmp_path):
    (tmp_path / "bad.zip").write_bytes(b"PK no archive")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.md", "x" * (21 * 1024 * 1024))
    (tmp_path / "good.zip").write_bytes(out.getvalue())
    got = {r.path.rsplit("/", 1)[1]: (r.member, r.size, r.error) for r in files.read_archives(spark, str(tmp_path)).select("path", "member", F.length("content").alias("size"), "error").collect()}
    assert got["good.zip"] == ("a.md", 21 * 1024 * 1024, None) and got["bad.zip"][0] is None and got["bad.zip"][2]
    assert [r.error is not None for r in files.read_workbooks(spark, str(tmp_path) + "/bad.zip").collect()] == [True]
    assert files.member_reason("a.md", 9, 5) == "size"
    assert files.parsed_rows('a,"' + "x" * 300_000 + '"\nb,c')[1][1] == ["b", "c"]


def test_sheets(spark):
    cells = spark.createDataFrame([("s", 1, 0, "a"), ("s", 1, 1, " "), ("s", 2, 1, None), ("t", 1, 0, "b"), ("t", 1, 1, "")], "sheet string, r int, c int, value string")
    assert sorted((r.sheet, r.c) for r in reports.without_spacer(cells).collect()) == [("s", 0), ("t", 0), ("t", 1)]
    rows = spark.createDataFrame([("a", "مدينة"), ("a", "كتاب ۱۲"), ("b", "كتاب"), ("b", "گران"), (None, "٣")], "sheet string, value string")
    assert sorted(r.value for r in reports.written_out(rows, "sheet", "value").collect()) == sorted(["مدينة", "كتاب 12", "کتاب", "گران", "3"])
