"""Column functions on values as people write them: numbers, dates, sizes, arguments, counters, page references.

A null gives null unless a function says otherwise; an empty text has no number, no date and no arguments.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheafspark.functions.text import ASCII_DIGITS, OTHER_DIGITS

#: Paper sizes in millimetres, and the Roman numerals from one up.
PAPER = (("A3", 297, 420), ("A4", 210, 297), ("A5", 148, 210), ("B5", 176, 250), ("Letter", 216, 279), ("Legal", 216, 356))
ROMAN = ("i", "v", "x", "l", "c", "d", "m", "", "")
DIGIT = "[0-9۰-۹٠-٩]"
LEADER = r"(?:(?:\.\s?){4,}|…{2,}|_{5,}|(?:·\s?){4,})"


def cell_number(text: Column) -> Column:
    """The number in a table cell, whatever its digits, group marks, percent or currency signs; null if there is none."""
    t = F.replace(F.translate(text, OTHER_DIGITS, ASCII_DIGITS), F.lit("٫"), F.lit("."))
    t = F.regexp_replace(t, r"[^0-9.+\-eE]", "")
    return F.when(t.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), t.try_cast("double"))


def date_text(value: Column) -> Column:
    """A PDF or ISO date laid out as text with only the parts it gives and the zone as written; others as they are."""
    v = F.btrim(value)
    pdf = r"^D:([0-9]{4})([0-9]{2})?([0-9]{2})?([0-9]{2})?([0-9]{2})?([0-9]{2})?\s*(Z|[+-][0-9]{2}'?[0-9]{0,2}'?)?"
    part = lambda i: F.nullif(F.regexp_extract(v, pdf, i), F.lit(""))
    zone = F.regexp_extract(v, pdf, 7)
    minutes = F.coalesce(F.nullif(F.substring(F.replace(zone, F.lit("'"), F.lit("")), 4, 2), F.lit("")), F.lit("00"))
    shown = F.when(zone == "Z", " UTC").when(zone != "", F.concat(F.lit(" "), F.substring(zone, 1, 3), F.lit(":"), minutes)).otherwise("")
    day = F.concat_ws("-", part(1), part(2), F.when(part(2).isNotNull(), part(3)))
    time = F.when(part(3).isNotNull() & part(4).isNotNull(), F.concat(F.lit(" "), F.concat_ws(":", part(4), part(5), F.when(part(5).isNotNull(), part(6))), shown)).otherwise("")
    iso = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})(?:T([0-9]{2}:[0-9]{2}(?::[0-9]{2})?)(?:\.[0-9]+)?)?\s*(Z|[+-][0-9]{2}:[0-9]{2})?$"
    rest = lambda i: F.regexp_extract(v, iso, i)
    laid = F.concat(rest(1), F.when(rest(2) == "", "").otherwise(F.concat(F.lit(" "), rest(2))), F.when(rest(3) == "", "").when(rest(3) == "Z", " UTC").otherwise(F.concat(F.lit(" "), rest(3))))
    return F.when(v == "", F.lit(None)).when(v.rlike(pdf), F.concat(day, time)).when(v.rlike(iso), laid).otherwise(v)


def page_size(width: Column, height: Column) -> Column:
    """Points as millimetres, with the name of the paper that is within 2 mm; null unless both are above 0."""
    w, h = (F.floor(x * 25.4 / 72 + 0.5).cast("long") for x in (width, height))
    name = F.lit("")
    for paper, a, b in reversed(PAPER):
        fits = (F.abs(F.least(w, h) - a) <= 2) & (F.abs(F.greatest(w, h) - b) <= 2)
        name = F.when(fits, f" ({paper})").otherwise(name)
    return F.when((width > 0) & (height > 0), F.concat(w.cast("string"), F.lit(" × "), h.cast("string"), F.lit(" mm"), name))


def leader_line(line: Column) -> Column:
    """Whether a line of a table of contents runs by leaders to a page number, at either end."""
    bare = F.regexp_replace(line, r"[\x{200B}-\x{200F}]", "")
    return bare.rlike(rf"^\s*{DIGIT}{{1,4}}\s*{LEADER}") | bare.rlike(rf"{LEADER}\s*{DIGIT}{{1,4}}\s*$")


def roman(n: Column) -> Column:
    """A whole number up to 3999 in lower-case Roman numerals; empty below 1."""

    def place(power: int, one: str, five: str, ten: str) -> Column:
        names = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
        return F.element_at(F.array(*map(F.lit, names)), (F.floor(n / power) % 10 + 1).cast("int"))

    return F.when(n < 1, "").otherwise(F.concat(*(place(10**i, *ROMAN[2 * i : 2 * i + 3]) for i in (3, 2, 1, 0))))


def letters(n: Column) -> Column:
    """1 a, 26 z, 27 aa and so on; empty below 1."""
    step = lambda a, _: F.struct(
        F.when(a["left"] > 0, F.concat(F.chr(97 + (a["left"] - 1) % 26), a["out"])).otherwise(a["out"]).alias("out"), F.when(a["left"] > 0, F.floor((a["left"] - 1) / 26)).otherwise(F.lit(0)).cast("long").alias("left")
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), F.struct(F.lit("").alias("out"), n.cast("long").alias("left")), step, lambda a: a["out"])


def last_wins(entries: Column) -> Column:
    """A map from an array of (key, value): of equal keys the last."""
    later = lambda e, i: F.exists(F.slice(entries, i + 2, F.size(entries)), lambda y: y["key"] == e["key"])
    return F.map_from_entries(F.filter(entries, lambda e, i: ~later(e, i)))


def _unquoted(value: Column) -> Column:
    return F.regexp_replace(value, r"""(?s)^(["'])(.*)\1$""", "$2")


def arguments(text: Column) -> Column:
    """a=1 b c='x y' as a map: keys and bare words in lower case, a bare word's value is true."""
    tokens = F.regexp_extract_all(text, F.lit(r"""[\w-]+\s*=\s*(?:"[^"]*"|'[^']*'|\S+)|"[^"]*"|\S+"""), 0)
    keyed = r"(?s)^([\w-]+)\s*=\s*(.+)$"
    bare = lambda t: F.lower(F.regexp_replace(t, r'(?s)^"(.*)"$', "$1"))
    entry = lambda t: F.when(t.rlike(keyed), F.struct(F.lower(F.regexp_extract(t, keyed, 1)).alias("key"), _unquoted(F.regexp_extract(t, keyed, 2)).alias("value"))).otherwise(F.struct(bare(t).alias("key"), F.lit("true").alias("value")))
    return last_wins(F.transform(tokens, entry))


def front_matter(text: Column) -> Column:
    """The flat key: value block a text begins with, as a map with keys in lower case; null if there is none."""
    body = F.regexp_replace(text, r"\r\n?", "\n")
    block = F.regexp_extract(body, r"(?s)\A\x{FEFF}?---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\z)", 1)
    pattern = r"^\s*([\w-]+)\s*:\s*(.*?)\s*$"
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(pattern))
    entries = F.transform(lines, lambda x: F.struct(F.lower(F.regexp_extract(x, pattern, 1)).alias("key"), _unquoted(F.regexp_extract(x, pattern, 2)).alias("value")))
    return F.when(block != "", last_wins(entries))

