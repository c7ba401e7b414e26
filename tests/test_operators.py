"""Layout, tables and streams on small literal inputs."""

from pyspark.sql import functions as F

from sheafspark.operators import layout, lines, match, tables
from sheafspark.streaming import documents as streams


def test_reading_order(spark):
    boxes = [(1, 1, 0.0, 0.0, 100.0, 20.0), (1, 2, 0.0, 40.0, 100.0, 60.0), (1, 3, 200.0, 0.0, 300.0, 20.0), (1, 4, 200.0, 40.0, 300.0, 60.0)]
    got = layout.xy_cut(spark.createDataFrame(boxes, "page long, box long, x0 double, y0 double, x1 double, y1 double")).orderBy("place").collect()
    assert [r.box for r in got] == [1, 2, 3, 4]


def test_lines_and_paragraphs(spark):
    text = "one two\nthree\nfour\n\n\nfive   six"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = layout.line_texts(layout.glyph_lines(layout.typeset(docs)))
    assert [(r.text, r.segments) for r in found.orderBy("line").collect()] == [("one two", 1), ("three", 1), ("four", 1), ("five six", 2)]
    assert [r.text for r in layout.paragraphs(found).orderBy("paragraph").collect()] == ["one two three four", "five six"]


def test_tables_in_markdown(spark):
    md = "# A\n\n| a | b |\n| --- | --- |\n| 1 | x\\|y |\n\n```\n| no | table |\n| --- | --- |\n```\n\n**B**:\n\n| c |\n|---|\n| 2 |\n\n| not | one |\n"
    got = tables.find_tables(spark.createDataFrame([(1, md)], "k long, md string"), "k", "md").orderBy("table_no", "row").collect()
    assert [(r.table_no, r.name, r.row, r.cells) for r in got] == [(1, "A", 0, ["a", "b"]), (1, "A", 1, ["1", "x|y"]), (2, "B", 0, ["c"]), (2, "B", 1, ["2"])]


def test_sheet_round_trip(spark):
    rows = spark.createDataFrame([("s", 1, "a|b", "x_y"), ("s", 2, "line\none", "*n*")], "sheet string, r int, a string, b string")
    md = tables.to_markdown(rows, "sheet", "r", ["a", "b"]).first().markdown
    assert md == "## s\n\n| a | b |\n| --- | --- |\n| a\\|b | x_y |\n| line<br>one | \\*n\\* |\n"


def test_csv_like_and_slides(spark):
    docs = spark.createDataFrame([(1, "a,b\n1,2"), (2, "a,b\n1"), (3, 'a;"x;y"\n1;2')], "doc_id long, text string")
    assert {r.doc_id: r.separator for r in lines.csv_like(docs).collect()} == {1: ",", 2: None, 3: ";"}
    slides = spark.createDataFrame([(1, "## a\n" + "w " * 301), (2, "no heading"), (3, "## a\nok")], "doc_id long, text string")
    got = lines.slide_verdicts(lines.sections(lines.doc_lines(slides)))
    assert {r.doc_id: r.verdict for r in got.collect()} == {1: "slide-too-long,many-long", 2: "no-slides", 3: ""}


def test_gate(spark):
    a = spark.createDataFrame([("x", 90.0), ("y", 80.0), ("z", 70.0)], "f string, s double")
    b = spark.createDataFrame([("x", 90.4), ("y", 82.0), ("w", 1.0)], "f string, s double")
    assert {r.f: r.state for r in match.gate(a, b, "f", "s", F.lit(0.5)).collect()} == {"x": "same", "y": "worse", "z": "new", "w": "lost"}


def test_streams(spark, tmp_path):
    rows = [(1, "the cat\nthe dog", "en", "s", 15), (2, "", "en", "s", 0)]
    spark.createDataFrame(rows, streams.DOCUMENTS).write.parquet(str(tmp_path / "in"))
    docs = streams.document_stream(spark, str(tmp_path / "in"))
    for name, df, mode in (("stream_lines", streams.stream_lines(docs), "append"), ("stream_words", streams.stream_lexicon(docs), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("stream_lines").count() == 3
    assert {r.word: r.n for r in spark.table("stream_words").collect()} == {"the": 2, "cat": 1, "dog": 1}
