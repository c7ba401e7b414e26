"""The line model: texts as numbered lines, sections, furniture and delimited-text detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheafspark.functions.text import furniture_key, strip_marks


def doc_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_no (from 1), line, kind: blank, fence, heading, table, quote, list or text."""
    rows = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    kind = (
        F.when(F.col("line").rlike(r"^[ \t]*$"), "blank")
        .when(F.col("line").rlike(r"^ {0,3}(```|~~~)"), "fence")
        .when(F.col("line").rlike(r"^ {0,3}#{1,6}[ \t]"), "heading")
        .when(F.col("line").rlike(r"^[ \t]*\|.*\|[ \t]*$"), "table")
        .when(F.col("line").rlike(r"^ {0,3}>"), "quote")
        .when(F.col("line").rlike(r"^[ \t]*([-*+]|[0-9]{1,9}[.)])[ \t]"), "list")
        .otherwise("text")
    )
    return rows.select(key, (F.col("line_no") + 1).cast("long").alias("line_no"), "line", kind.alias("kind"))


def outside_fences(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """lines with in_code: whether an odd number of fences stands above, or the line is one."""
    above = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    fence = (F.col("kind") == "fence").cast("int")
    return lines.withColumn("in_code", (F.coalesce(F.sum(fence).over(above), F.lit(0)) % 2 == 1) | (F.col("kind") == "fence"))


def sections(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, section (0 before the first heading), title, n_lines, n_words; lines: of doc_lines."""
    marked = outside_fences(lines, key)
    head = (F.col("kind") == "heading") & ~F.col("in_code")
    upto = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("section", F.sum(head.cast("int")).over(upto)).withColumn("_title", F.when(head, strip_marks(F.regexp_replace("line", r"^ {0,3}#{1,6}[ \t]+", ""))))
    n_words = F.when(head, 0).otherwise(F.regexp_count("line", F.lit(r"[^ \t\n\r]+")))
    return marked.groupBy(key, "section").agg(F.max("_title").alias("title"), F.count("*").alias("n_lines"), F.sum(n_words).alias("n_words"))


def slide_verdicts(found: DataFrame, key: str = "doc_id", most: int = 300, long: int = 250, free: int = 60) -> DataFrame:
    """key and verdict codes of a text as slides: no section, a section too long, too many long ones, a long opening."""
    count = lambda c: F.count_if(c)
    body = F.col("section") > 0
    out = found.groupBy(key).agg(
        count(body).alias("slides"), F.max(F.when(body, F.col("n_words"))).alias("longest"), count(body & (F.col("n_words") > long)).alias("long_slides"), F.coalesce(F.max(F.when(~body, F.col("n_words"))), F.lit(0)).alias("intro_words")
    )
    codes = [(F.col("slides") == 0, "no-slides"), (F.col("longest") > most, "slide-too-long"), (F.col("long_slides") * 2 > F.col("slides"), "many-long"), (F.col("intro_words") > free, "long-intro")]
    return out.withColumn("verdict", F.concat_ws(",", *(F.when(c, code) for c, code in codes)))


def furniture(docs: DataFrame, group: str = "source", key: str = "doc_id", text: str = "text", share: float = 0.25) -> DataFrame:
    """Lines, digits folded, that stand in at least two and in a share of a group's documents: group, line_key, n_docs.

    Keys are counted by group and document first, so one very common line is never gathered.
    """
    total = docs.groupBy(group).agg(F.count_distinct(key).alias("docs_of_group"))
    keys = docs.select(group, key, F.explode(F.split(text, "\n")).alias("line")).select(group, key, furniture_key(F.col("line")).alias("line_key")).where("line_key <> ''").distinct()
    counted = keys.groupBy(group, "line_key").agg(F.count("*").alias("n_docs"))
    return counted.join(total, group).where((F.col("n_docs") >= 2) & (F.col("n_docs") >= F.ceil(F.col("docs_of_group") * share))).select(group, "line_key", "n_docs", "docs_of_group")


def csv_like(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, separator: a text of two records or more, each with as many of one separator; tab, then comma, then ;."""
    # A quoted field is one letter, so that neither its separators nor its line ends count.
    plain = F.regexp_replace(text, '"[^"]*"', "q")
    lines = docs.select(key, F.explode(F.slice(F.split(plain, "\n"), 1, 50)).alias("line")).where(~F.col("line").rlike(r"^[ \t]*$"))
    bare = F.col("line")
    found = None
    for sep in ("\t", ",", ";"):
        n = F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit("")))
        same = (F.min(n) == F.max(n)) & (F.min(n) >= 1) & (F.count("*") >= 2) & ~F.bool_or(F.col("line").rlike(r"^[ \t]*\|"))
        found = F.when(same, sep) if found is None else found.when(same, sep)
    return lines.groupBy(key).agg(found.alias("separator"))
