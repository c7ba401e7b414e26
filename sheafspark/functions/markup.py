"""Column functions on markup: titles, leads, alerts, fences, list numbers, lengths and colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points in a unit of length.
POINTS = {"pt": 1.0, "px": 0.75, "in": 72.0, "cm": 28.346, "mm": 2.8346, "pc": 12.0}
TENS, ONES = ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"), ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")


def first_words(text: Column, n: int = 6) -> Column:
    """The first heading of level 1, else the first words."""
    heading = F.regexp_extract(text, r"(?m)^# +(.+?) *#*$", 1)
    words = F.array_join(F.slice(F.split(F.regexp_replace(text, r"^[ \t\n\r]+", ""), r"[ \t\n\r]+"), 1, n), " ")
    return F.when(heading != "", heading).otherwise(words)


def lead_label(text: Column) -> Column:
    """The label of **Label** followed by a dash or colon; empty if there is none."""
    return F.regexp_extract(text, r"^\*\*([^*]+)\*\* *[—–:-] *", 1)


def lead_detail(text: Column) -> Column:
    return F.regexp_extract(text, r"^\*\*[^*]+\*\* *[—–:-] *(.*)$", 1)


def alert_kind(text: Column) -> Column:
    """note, tip, important, warning or caution of a quote that begins with such a mark."""
    return F.lower(F.regexp_extract(text, r"^> *\[!(NOTE|TIP|IMPORTANT|WARNING|CAUTION)\]", 1))


def fence_language(line: Column) -> Column:
    return F.lower(F.regexp_extract(line, r"^ {0,3}(?:```+|~~~+) *([A-Za-z0-9+#.-]+)", 1))


def roman(n: Column) -> Column:
    """1 to 99 as Roman numerals."""
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    return F.concat(pick(TENS, F.floor(n / 10)), pick(ONES, n % 10))


def points(length: Column) -> Column:
    """A CSS length in points; null for other units."""
    unit = F.regexp_extract(length, r"^[0-9.]+ *([a-z]+)$", 1)
    factor = F.lit(None).cast("double")
    for name, value in POINTS.items():
        factor = F.when(unit == name, F.lit(value)).otherwise(factor)
    return F.nullif(F.regexp_extract(length, r"^([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).cast("double") * factor


def luminance(colour: Column) -> Column:
    """Relative luminance of a colour of six hex digits."""

    def linear(at: int) -> Column:
        c = F.conv(F.substring(colour, at, 2), 16, 10).cast("double") / 255
        return F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * linear(1) + 0.7152 * linear(3) + 0.0722 * linear(5)


def tidy(text: Column) -> Column:
    """Blanks at line ends gone, three line ends or more as two; for text outside code."""
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")


def dehyphenated(left: Column, right: Column, words: Column) -> Column:
    """A word cut at a line end, joined: without the hyphen if it is a soft one or the words hold the whole, else with it."""
    bare = F.regexp_replace(left, "[-\\x{00AD}]$", "")
    whole = F.concat(bare, right)
    return F.when(left.endswith("­") | F.array_contains(words, F.lower(whole)), whole).otherwise(F.concat(left, right))
