"""Assembly on literal inputs."""

from pyspark.sql import functions as F

from sheafspark.operators import assembly


def test_contents_and_direction(spark):
    md = "# One\n\n## Two *x*\n\n```\n# no\n```\n\n## Two x\n\n#### deep"
    docs = spark.createDataFrame([(1, md), (2, "| abc |\nسلام"), (3, "123"), (4, "| abc |")], "k long, md string")
    assert [(r.k, r.toc) for r in assembly.contents(docs, "k", "md").collect()] == [(1, "- [One](#one)\n  - [Two x](#two-x)\n  - [Two x](#two-x-1)")]
    assert {r.k: r.direction for r in assembly.document_direction(docs, "k", "md").collect()} == {1: "ltr", 2: "rtl", 4: "ltr"}


def test_lists_forms_and_fences(spark):
    items = spark.createDataFrame([(1, i, v) for i, v in enumerate([1, 2, 2, 1, 2, 3, 2])], "k long, i long, level long")
    assert [r.number for r in assembly.list_numbers(items, "k", ["i"], "level").orderBy("i").collect()] == [1, 1, 2, 2, 1, 1, 2]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(["a: 1", "b: 2", "x", "c: 3", "d：4", "e:", "http://x"])], "k long, i long, line string")
    assert [(r.label, r.value) for r in assembly.form_rows(lines, "k", "i", "line").orderBy("i").collect()] == [("c", "3"), ("d", "4"), ("e", "")]
    assert spark.range(1).select(assembly.hidden_block(F.lit("a ```` b")).alias("x")).first().x == "`````\na ```` b\n`````"


def test_empty(spark):
    none = spark.createDataFrame([], "page long, x double, y double")
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 9.0)], "page long, x0 double, y0 double, x1 double, y1 double")
    assert assembly.in_boxes(none, boxes, "page").count() == 0
    assert assembly.preview(none, "page", ["x"]).count() == 0
