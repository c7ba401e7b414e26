"""Corpus statistics and verdicts on text quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A word: letters only. Pairs and n-grams are taken inside words.
LETTERS = r"\p{L}+"


def letter_words(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, word: each run of letters, in lower case."""
    return docs.select(*keys, F.explode(F.regexp_extract_all(F.lower(text), F.lit(f"({LETTERS})"), 1)).alias("word"))


def ngrams(words: DataFrame, keys: list[str], n: int, weight: Column | None = None) -> DataFrame:
    """keys, gram, count: the n-letter runs inside words.

    Words are counted before they are cut, so the rows that are cut are distinct words, not the text's.
    """
    counted = words.groupBy(*keys, "word").agg((F.count("*") if weight is None else F.sum(weight)).alias("_n"))
    at = F.explode(F.sequence(F.lit(1), F.length("word") - n + 1)).alias("_i")
    grams = counted.where(F.length("word") >= n).select(*keys, "word", "_n", at).select(*keys, F.col("word").substr(F.col("_i"), F.lit(n)).alias("gram"), "_n")
    return grams.groupBy(*keys, "gram").agg(F.sum("_n").alias("count"))


def letter_pairs(docs: DataFrame, by: str = "lang", least: int = 2) -> DataFrame:
    """by, gram, count of the letter pairs seen at least so often."""
    return ngrams(letter_words(docs, [by]), [by], 2).where(F.col("count") >= least)


def language_model(docs: DataFrame, by: str = "lang", order: int = 3, vocabulary: int = 10) -> DataFrame:
    """by, n, gram, count for n of 1 to order; words stand between ^ and $ marks and occur at least vocabulary times."""
    words = letter_words(docs, [by]).groupBy(by, "word").agg(F.count("*").alias("_n")).where(F.col("_n") >= vocabulary)
    marked = words.select(by, F.concat(F.lit("^^"), "word", F.lit("$")).alias("word"), "_n")
    out = None
    for n in range(1, order + 1):
        grams = ngrams(marked, [by], n, F.col("_n")).withColumn("n", F.lit(n))
        out = grams if out is None else out.unionByName(grams)
    return out.select(by, "n", "gram", "count")


def unseen_pair_share(docs: DataFrame, known: DataFrame, key: str = "doc_id", by: str = "lang") -> DataFrame:
    """key, pairs, unseen: pairs of letters in a text, and those its language's known pairs (by, gram) don't have."""
    found = ngrams(letter_words(docs, [key, by]), [key, by], 2)
    seen = known.select(F.col(by).alias("_by"), F.col("gram").alias("_gram"))
    joined = found.join(seen, (F.col(by) == F.col("_by")) & (F.col("gram") == F.col("_gram")), "left")
    return joined.groupBy(key).agg(F.sum("count").alias("pairs"), F.sum(F.when(F.col("_gram").isNull(), F.col("count")).otherwise(0)).alias("unseen"))


def unseen_by_others(docs: DataFrame, key: str = "doc_id", by: str = "lang", least: int = 2) -> DataFrame:
    """key, pairs, unseen for every text: unseen are those that the other texts of its language have less than so often."""
    found = ngrams(letter_words(docs, [key, by]), [key, by], 2)
    total = ngrams(letter_words(docs, [by]), [by], 2).select(F.col(by).alias("_by"), F.col("gram").alias("_gram"), F.col("count").alias("_total"))
    # A language's letter pairs are as many as its alphabet allows, whatever the input.
    joined = found.join(F.broadcast(total), (F.col(by) == F.col("_by")) & (F.col("gram") == F.col("_gram")))
    sums = joined.groupBy(key).agg(F.sum("count").alias("pairs"), F.sum(F.when(F.col("_total") - F.col("count") < least, F.col("count")).otherwise(0)).alias("unseen"))
    return docs.select(key).distinct().join(sums, key, "left").select(key, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("pairs", "unseen")))


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, letters, words, single (words of one letter), punct (signs inside words), odd (signs that are neither letter, digit nor common mark)."""
    t = F.col(text)
    n = lambda p: F.regexp_count(t, F.lit(p))
    return docs.select(
        key, n(r"\p{L}").alias("letters"), n(r"\p{L}+").alias("words"), n(r"(?:^|[^\p{L}])\p{L}(?:$|[^\p{L}])").alias("single"), n(r"\p{L}[.,;:!?]\p{L}").alias("punct"), n(r"[^\p{L}\p{N}\s.,;:!?'\"()\-]").alias("odd")
    )


def verdicts(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """found (measures with pairs, unseen) with verdict codes; no verdict below 150 letters.

    Latin thresholds: unseen pairs over 12 % of at least 100, signs inside over 25 % of words, odd signs over 20 %.
    """
    enough = F.col("letters") >= 150
    codes = F.concat_ws(
        ",",
        F.when(enough & (F.col("pairs") >= 100) & (F.col("unseen") * 100 > F.col("pairs") * 12), "unseen"),
        F.when(enough & (F.col("punct") * 4 > F.col("words")), "signs"),
        F.when(enough & (F.col("odd") * 5 > F.col("letters")), "odd"),
    )
    return found.withColumn("verdict", codes)


def page_flags(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, glyphs, lost, words, glued and flags: lostGlyphs (5 or more and 2 %), suspectSpaces (4 or more and 3 %)."""
    t = F.col(text)
    n = lambda p: F.regexp_count(t, F.lit(p)).cast("long")
    out = docs.select(key, n(r"\S").alias("glyphs"), n(r"[\x{FFFD}\x{E000}-\x{F8FF}]").alias("lost"), n(r"\S+").alias("words"), n(r"[A-Za-z]{20,}").alias("glued"))
    flags = F.concat_ws(
        ",",
        F.when((F.col("lost") >= 5) & (F.col("lost") * 50 >= F.col("glyphs")), "lostGlyphs"),
        F.when((F.col("glued") >= 4) & (F.col("glued") * 100 >= F.col("words") * 3), "suspectSpaces"),
    )
    return out.withColumn("flags", flags)


def lexicon(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_hyphenated: distinct words of letters, and those with hyphens, not counting a line's last piece with one."""
    body = F.regexp_replace(F.lower(text), r"\p{L}+-\n", " ")
    found = F.array_distinct(F.regexp_extract_all(body, F.lit(r"(\p{L}+(?:-\p{L}+)*)"), 1))
    return docs.select(key, F.size(found).alias("n_words"), F.size(F.filter(found, lambda w: w.contains("-"))).alias("n_hyphenated"))


def modal(rows: DataFrame, by: str, value: Column) -> DataFrame:
    """by, mode, n: the commonest value; the least of equals."""
    counted = rows.groupBy(by, value.alias("mode")).agg(F.count("*").alias("n"))
    first = counted.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("less"), "mode")).alias("x"))
    return first.select(by, "x.mode", (-F.col("x.less")).alias("n"))


def percentiles(rows: DataFrame, by: str, value: str, shares: dict[str, float], bins: int = 4096) -> DataFrame:
    """by and, for each name of shares, that exact percentile of value, between two neighbours in proportion.

    The first pass counts equal-width bins of each group, the second looks only into the bins that hold a wanted rank,
    so no task gathers a group's values. Null values don't count; a group without others has nulls; NaN is the largest.
    """
    v = F.col("_v")
    ends = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    rows = rows.select(F.col(by).alias("_by"), F.col(value).cast("double").alias("_v"))
    groups = rows.groupBy("_by").agg(F.min(F.when(~ends, v)).alias("_low"), F.max(F.when(~ends, v)).alias("_high"), F.count("_v").alias("_n"))
    own = lambda d, *more: F.col("_by").eqNullSafe(d["_of"]) if not more else F.col("_by").eqNullSafe(d["_of"]) & (F.col("_bin") == d["_at"])
    limits = groups.withColumnRenamed("_by", "_of")
    place = F.when(v == float("-inf"), -1).when(ends, bins + 1).when(F.col("_high") == F.col("_low"), 0).otherwise(F.floor((v / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2) * bins))
    binned = rows.where("_v is not null").join(limits, own(limits)).select("_by", "_v", place.cast("int").alias("_bin"))

    counted = binned.groupBy("_by", "_bin").agg(F.count("*").alias("_c"))
    upto = Window.partitionBy("_by").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumns({"_before": F.coalesce(F.sum("_c").over(upto), F.lit(0)), "_n": F.sum("_c").over(Window.partitionBy("_by"))})
    rank = lambda p, f: f(F.lit(p) * (F.col("_n") - 1)).cast("long")
    ranks = F.array(*(F.struct(F.lit(f"{name}{side}").alias("name"), rank(p, f).alias("rank")) for name, p in shares.items() for side, f in (("<", F.floor), (">", F.ceil))))
    wanted = counted.withColumn("_w", F.explode(ranks)).where("_w.rank >= _before and _w.rank < _before + _c")
    wanted = wanted.select(F.col("_by").alias("_of"), F.col("_bin").alias("_at"), F.col("_w.name").alias("_name"), (F.col("_w.rank") - F.col("_before")).alias("_k"))

    needed = wanted.select("_of", "_at").distinct()
    inside = binned.join(needed, own(needed, 1), "left_semi").groupBy("_by", "_bin", "_v").agg(F.count("*").alias("_c"))
    within = Window.partitionBy("_by", "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("_before", F.coalesce(F.sum("_c").over(within), F.lit(0)))
    hits = inside.join(wanted, own(wanted, 1)).where("_k >= _before and _k < _before + _c")
    found = hits.groupBy("_of").agg(*(F.max(F.when(F.col("_name") == f"{name}{side}", v)).alias(f"_{name}{side}") for name in shares for side in "<>"))
    part = lambda p: F.lit(p) * (F.col("_n") - 1) - F.floor(F.lit(p) * (F.col("_n") - 1))
    value_of = lambda name, p: F.when(F.col(f"_{name}<") == F.col(f"_{name}>"), F.col(f"_{name}<")).otherwise(F.col(f"_{name}<") + (F.col(f"_{name}>") - F.col(f"_{name}<")) * part(p))
    return groups.join(found, own(found), "left").select(F.col("_by").alias(by), *(value_of(name, p).alias(name) for name, p in shares.items()))


def drift(rows: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """by, slope: least squares from sums."""
    return rows.groupBy(by).agg(F.regr_slope(y, x).alias("slope"))
