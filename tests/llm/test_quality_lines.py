"""The line rules in the cleaned text, against a version in plain Python."""

import re

from pyspark.sql import functions as F

from sheafspark.llm import quality_rules as rules

INK = re.compile(r"[^\x20\x09-\x0D]")


def cleaned(text):
    lines = text.split("\n")

    def hard(x):
        if not INK.search(x):
            return False
        m = re.sub(r"[^|»·#*$%&<>{}~^\\!?]+", "", x)
        bars = len(re.sub(r"[^|»·]+", "", m))
        phrase = len(x) <= 120 and any(re.search(rf"\b{p}\b", x, re.I) for p in rules.BOILERPLATE)
        return (bars >= 3 and bars * 40 >= len(x)) or (len(m) >= 3 and (len(m) - bars) * 8 >= len(x)) or phrase

    opened = [len(x) < 20 and bool(INK.search(x)) and not re.search(rules.CLOSED, x) and not re.search(rules.ITEM, x) for x in lines]
    run = lambda i: any(j >= 0 and j + 3 <= len(lines) and all(opened[j : j + 3]) for j in (i - 2, i - 1, i))
    return "\n".join(x for i, x in enumerate(lines) if not hard(x) and not run(i))


TEXTS = [
    "The council was empowered by the people of the old town to act.",
    "They showered by the tower and went on.\nPOWERED BY someone\nAll Rights Reserved 2020",
    "A title\nA plain sentence stands here, and another one follows it.\nHome\nNews\nAbout\nContact\nThe end is here.",
    "- milk\n- bread\n- eggs\n# Heading\nText after it.",
    "one\ntwo\nthree",
    "one\ntwo\n\nthree",
    "यह एक वाक्य है।\nयह दूसरा है।\nतीसरा।",
    "a | b | c | d\nBUY!! NOW!!\nPlain words of a sentence, long enough.",
    "", "\n\n", "x" * 50_000,
]


def test_clean_text(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    got = {r.doc_id: r for r in rules.measured(df, min_words=1).collect()}
    for i, t in enumerate(TEXTS):
        want = cleaned(t)
        assert got[i].clean_text == want, t
        chars, left = (len(re.sub(r"[\x20\x09-\x0D]", "", x)) for x in (t, want))
        assert got[i].lost_chars == chars - left
        assert got[i].kept == (bool(t.split()) and 100 * (chars - left) <= 50 * chars)
    kept = {r.doc_id for r in rules.clean(df).collect()}
    assert 0 in kept and 8 not in kept
    assert rules.clean(df, min_words=40).count() == 0
    assert rules.clean(df.withColumn("kept", F.lit(7)).withColumn("n_words", F.lit("x"))).columns == ["doc_id", "text", "kept", "n_words"]
