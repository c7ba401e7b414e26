"""Markup rules on literal texts."""

from pyspark.sql import functions as F

from sheafspark.functions import markup as M
from sheafspark.operators.html import filled_grid


def test_grid():
    assert filled_grid([[("A", 2, 1), ("1", 1, 1)], [("2", 1, 1)]]) == [["A", "1"], ["", "2"]]
    assert filled_grid([[("A", 2, 1), ("1", 1, 1)], [("2", 1, 1)]], repeat=True) == [["A", "1"], ["A", "2"]]
    assert filled_grid([[("A", 1, 2), ("b", 1, 1)]]) == [["A", "", "b"]]


def test_columns(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(M.tidy(F.lit("a  \n\n\n\nb"))) == "a\n\nb"
    words = F.array(F.lit("wonderful"))
    assert one(M.dehyphenated(F.lit("wonder-"), F.lit("ful"), words)) == "wonderful"
    assert one(M.dehyphenated(F.lit("well-"), F.lit("known"), words)) == "well-known"
    assert one(M.first_words(F.lit("x\n# Title #\ny"))) == "Title"
    assert one(M.alert_kind(F.lit("> [!TIP]\n> x"))) == "tip"
