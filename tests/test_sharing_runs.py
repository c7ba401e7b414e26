"""Documents and the items they share runs of words with."""

from sheafspark.operators import match


def test_items_of_any_number_are_found(spark):
    items = spark.createDataFrame([(3, "one two three four five six"), (147, "Alpha, beta gamma delta epsilon!"), (199, "Zeta eta"), (5, "...")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x ALPHA beta gamma delta epsilon y"), (2, "zeta, eta and two three four five six"), (3, "one two three four")], "doc_id long, text string")
    assert sorted(tuple(r) for r in match.sharing_runs(docs, items).collect()) == [(1, 147), (2, 3), (2, 199)]
