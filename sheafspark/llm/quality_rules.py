"""Operator 9: line-first quality rules, in DataFrame functions only.

Every line is judged (punctuation, navigation, boilerplate); failing lines are removed; a document that loses too much
of its text is rejected, and so is one that repeats itself or has fewer words than a parameter asks for: MIN_WORDS for
the query's contract, 1 for `clean`, as a short document whose lines pass is no bad one.

Null and empty texts have no words: all counts are 0 and the document is rejected. Repeated rows are judged each by
themselves; an empty table gives an empty result; other columns pass through `clean` untouched, and result columns
replace columns of the same name.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafspark.llm.common import INK, bound, inked, table, words

MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30
#: A document is rejected if more than so many percent of its words' characters are on failing lines.
MAX_LOST_PERCENT = 50
SYMBOLS = r"[#*$%&|<>]"

#: Phrases of boilerplate lines, found as whole words in either case.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "accept cookies", "accept all cookies", "privacy policy", "terms of use", "terms of service", "enable javascript", "lorem ipsum", "click here to", "skip to content", "powered by", "licensed under", "released under the",
)
#: A line over so many code points is prose even if it names a boilerplate phrase.
BOILERPLATE_CHARS = 120
#: A line without closing punctuation fails if it has fewer code points than this; `clean_text` keeps it unless it is
#: one of OPEN_RUN or more such lines in a row, so that a title or a stray cell stays.
OPEN_CHARS = 20
OPEN_RUN = 3
CLOSED = r"[.!?…:;。！？؟۔।॥】」』][\"'”’»)\]]*[\x20\x09-\x0D]*$"
#: A heading, list item or table row needs no closing punctuation.
ITEM = r"^[\x20\x09]*(?:#{1,6}\x20|[-*+•]\x20|[0-9]{1,3}[.)]\x20|\|)"

_MARKS = r"[|»·#*$%&<>{}~^\\!?]"
_PHRASE = r"(?i)\b(?:" + "|".join(BOILERPLATE) + r")\b"


def _named(text: Column) -> Column:
    """Whether some phrase may occur: a cheap look at the whole text before any line is matched."""
    return bound(F.lower(text), lambda t: reduce(or_, (F.contains(t, F.lit(x)) for x in BOILERPLATE)))


def _open(line: Column) -> Column:
    return (F.length(line) < OPEN_CHARS) & line.rlike(INK) & ~line.rlike(CLOSED) & ~line.rlike(ITEM)


def _hard(line: Column, marked: Column, named: Column) -> Column:
    """The rule that a line fails whatever lines are around it; marked and named: whether the document has a mark, a phrase."""
    n = F.length(line)
    marks = bound(
        F.regexp_replace(line, r"[^|»·#*$%&<>{}~^\\!?]+", ""),
        lambda m: bound(
            F.length(F.regexp_replace(m, r"[^|»·]+", "")),
            lambda bars: F.when((bars >= 3) & (bars * 40 >= n), F.lit("navigation")).when((F.length(m) >= 3) & ((F.length(m) - bars) * 8 >= n), F.lit("punctuation")),
        ),
    )
    phrase = F.when(named & (n <= BOILERPLATE_CHARS) & line.rlike(_PHRASE), F.lit("boilerplate"))
    return F.when(marked | named, F.when(line.rlike(INK), F.coalesce(F.when(marked, marks), phrase)))


def line_verdict(line: Column) -> Column:
    """The rule a line fails by itself: navigation, punctuation or boilerplate; null if none (lines without a word pass).

    navigation: three or more separators, at least one every 40 code points; punctuation: a symbol or more every
    eight code points, or no closing punctuation on a line under OPEN_CHARS; boilerplate: a short line with a fixed
    phrase.
    """
    yes = F.lit(True)
    return F.coalesce(_hard(line, yes, yes), F.when(_open(line), F.lit("punctuation")))


def _good_lines(body: Column) -> Column:
    flags = F.struct(body.rlike(_MARKS).alias("marked"), _named(body).alias("named"), F.split(body, "\n").alias("lines"))
    judged = lambda f: F.transform(f["lines"], lambda x: F.struct(x.alias("x"), _hard(x, f["marked"], f["named"]).isNull().alias("good"), _open(x).alias("open")))

    def kept(lines: Column) -> Column:
        at = lambda i: F.coalesce(F.get(lines, i)["open"], F.lit(False))
        runs = lambda i: reduce(or_, (reduce(lambda p, q: p & q, (at(i + j + k) for k in range(OPEN_RUN))) for j in range(1 - OPEN_RUN, 1)))
        return F.transform(F.filter(lines, lambda x, i: x["good"] & ~(x["open"] & runs(i))), lambda x: x["x"])

    return bound(bound(flags, judged), kept)


def _covered(ws: Column, n: int) -> Column:
    """Words in n-word windows found twice or more: the windows are sorted and the cover of equal neighbours summed."""
    none = F.lit(None).cast("string")
    at = lambda s, j: F.when((j >= 1) & (j <= F.size(s)), F.element_at(s, F.greatest(F.least(j, F.size(s)), F.lit(1)))["w"]).otherwise(none)
    windows = F.transform(F.sequence(F.lit(1), F.size(ws) - n + 1), lambda i: F.struct(F.array_join(F.slice(ws, i, n), " ").alias("w"), i.alias("i")))
    hits = bound(F.array_sort(windows), lambda s: F.transform(s, lambda x, j: F.when((at(s, j) == x["w"]) | (at(s, j + 2) == x["w"]), x["i"])))
    return F.aggregate(
        F.array_sort(F.array_compact(hits)),
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("free")),
        lambda a, i: F.struct((a["sum"] + i + n - F.greatest(a["free"], i)).cast("long").alias("sum"), (i + n).cast("int").alias("free")),
        lambda a: a["sum"],
    )


def _paired(column: str, k: int) -> Column:
    return F.transform(column, lambda h, i: F.xxhash64(h, F.get(F.col(column), i + k)))


def with_repeats(df: DataFrame, ws: str, n: int, out: str) -> DataFrame:
    """df with column out: how many of the words in array ws are in n-word windows found twice or more; n: a power of 2.

    Hashes of 1, 2, 4, ... words rule out most documents (windows that run off the end equal no other); only
    documents with two equal hashes are sorted. The arrays are columns, each used twice, so none is computed again.
    """
    hashed = F.transform(F.col(ws), lambda w: F.xxhash64(w))
    df, k = df.withColumn("_h1", hashed), 1
    while k < n:
        df, k = df.withColumn(f"_h{2 * k}", _paired(f"_h{k}", k)), 2 * k
    twice = (F.size(ws) > n) & (F.size(F.array_distinct(f"_h{n}")) < F.size(f"_h{n}"))
    # As a generator of one row: no later filter is pushed below it, which would compute the arrays anew for every use.
    df = df.withColumn(out, F.explode(F.array(F.when(twice, _covered(F.col(ws), n)).otherwise(F.lit(0).cast("long")))))
    return df.drop(*(f"_h{2**i}" for i in range(n.bit_length())))


def measured(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars, kept, clean_text."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(INK))
    df = with_repeats(docs.withColumn("_ws", words(body)), "_ws", REPEAT_WINDOW, "n_repeat_words")
    return (
        df.withColumns(
            {
                "n_words": F.size("_ws").cast("long"),
                "word_chars": inked(body),
                "n_symbols": F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long"),
                "n_dup_lines": bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
                "clean_text": F.array_join(_good_lines(body), "\n"),
            }
        )
        .withColumn("lost_chars", F.col("word_chars") - inked(F.col("clean_text")))
        .withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
        .withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= MAX_LOST_PERCENT * F.col("word_chars")))
        .drop("_ws")
    )


def clean(docs: DataFrame, text: str = "text", min_words: int = 1) -> DataFrame:
    """The documents kept, with failing lines removed; columns as in docs."""
    own = docs.columns
    judged = measured(docs.select(*own, F.struct(*own).alias("__sheaf_row")), text, min_words).where("kept")
    return judged.select(*(F.col("clean_text").alias(c) if c == text else F.length("clean_text").cast("long").alias(c) if c == "n_chars" else F.col(f"__sheaf_row.{c}").alias(c) for c in own))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_PATTERN = lambda x: x.replace("'", "''")
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
w AS (SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS ws FROM d),
places AS (SELECT rid, ws, unnest(range(1, len(ws) - {REPEAT_WINDOW - 2})) AS i FROM w),
found AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(ws[i:i + {REPEAT_WINDOW - 1}], ' ')) AS n FROM places),
repeats AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM found, range({REPEAT_WINDOW}) r(k) WHERE n > 1 GROUP BY rid),
split AS (SELECT rid, unnest(string_split(body, chr(10))) AS x, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM d),
marks AS (SELECT *, length(x) AS n, regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') AS ink, regexp_replace(x, '[^|»·#*$%&<>{{}}~^\\!?]+', '', 'g') AS m FROM split),
bars AS (SELECT *, length(regexp_replace(m, '[^|»·]+', '', 'g')) AS bars FROM marks),
judged AS (
  SELECT *, ink <> '' AND ((bars >= 3 AND bars * 40 >= n) OR (length(m) >= 3 AND (length(m) - bars) * 8 >= n) OR (n <= {BOILERPLATE_CHARS} AND regexp_matches(x, '{_PHRASE}'))) AS bad,
    CAST(n < {OPEN_CHARS} AND ink <> '' AND NOT regexp_matches(x, '{_PATTERN(CLOSED)}') AND NOT regexp_matches(x, '{ITEM}') AS INT) AS op FROM bars),
near AS (
  SELECT *, coalesce(lag(op, 2) OVER o, 0) AS a, coalesce(lag(op, 1) OVER o, 0) AS b, coalesce(lead(op, 1) OVER o, 0) AS c, coalesce(lead(op, 2) OVER o, 0) AS e
  FROM judged WINDOW o AS (PARTITION BY rid ORDER BY i)),
lines AS (
  SELECT rid, count(*) FILTER (ink <> '') - count(DISTINCT x) FILTER (ink <> '') AS n_dup_lines,
    sum(CASE WHEN bad OR op = 1 AND (a + b = 2 OR b + c = 2 OR c + e = 2) THEN length(ink) ELSE 0 END) AS lost, sum(length(ink)) AS word_chars FROM near GROUP BY rid),
based AS (
  SELECT w.rid, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, lost
  FROM w JOIN lines USING (rid) LEFT JOIN repeats USING (rid)),
failed AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM based)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * lost <= {MAX_LOST_PERCENT} * word_chars AS kept FROM failed
"""
