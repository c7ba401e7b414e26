"""Column functions on text: digits, letters, direction, cells, escaping, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits of two scripts and what they are folded to, letters that show Persian, and ranges of scripts.
OTHER_DIGITS, ASCII_DIGITS = "۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩", "01234567890123456789"
PERSIAN_EVIDENCE = "[پچژگ]"
URDU_KURDISH = "[ٹڈڑےۆێڕڵ]"
RTL = r"[\x{0590}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFC}]"
LTR = r"[A-Za-z\x{00AA}\x{00B5}\x{00BA}\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{02B8}\x{0370}-\x{058F}]"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&nbsp;": " ", "&copy;": "©", "&amp;": "&"}
#: Width of a character by its class, in parts of an average digit.
WIDTHS = (("[A-Z]", 1.15), ("[mw]", 1.35), (r"[ijlft.,;:'|!]", 0.5), ("[0-9۰-۹٠-٩]", 1.0), (r"[ ]", 0.45), (RTL, 0.8))
WIDTH_OF_OTHERS = 0.9


def _between(text: Column, marks: str, to: str) -> Column:
    """Each of the marks that stands between two ASCII digits, replaced."""
    return F.regexp_replace(text, f"(?<=[0-9])[{marks}](?=[0-9])", to)


def ascii_numbers(text: Column) -> Column:
    """Digits of two scripts as ASCII, their separators between digits and their percent sign beside one."""
    text = F.translate(text, OTHER_DIGITS, ASCII_DIGITS)
    text = _between(_between(text, "٬،", ","), "٫", ".")
    return F.regexp_replace(text, "(?<=[0-9])٪|٪(?=[0-9])", "%")


def persian_letters(text: Column, evidence: Column | None = None) -> Column:
    """Arabic yeh and kaf as Persian ones if a letter that only Persian has occurs (in evidence, else in the text)."""
    of = text if evidence is None else evidence
    base = F.translate(text, "يىك", "ییک")
    return F.when(of.rlike(PERSIAN_EVIDENCE), F.when(of.rlike(URDU_KURDISH), base).otherwise(F.translate(base, "ەھ", "هه"))).otherwise(text)


def coerce(text: Column, zeros: bool = True) -> Column:
    """The number a cell holds, or null: no leading +, no leading zeros if they are kept, 15 digits at most."""
    trimmed = F.btrim(text)
    ok = trimmed.rlike(r"^-?[0-9]+(?:\.[0-9]+)?$") & (F.length(F.regexp_replace(trimmed, "[^0-9]", "")) <= 15)
    if zeros:
        ok = ok & ~trimmed.rlike("^-?0[0-9]")
    return F.when(ok, trimmed.try_cast("double"))


def cell_class(text: Column) -> Column:
    """empty, num, fa, en or sym: a number first, then the script of any letter, then any digit."""
    t = F.btrim(F.coalesce(text, F.lit("")))
    return (
        F.when(t == "", "empty")
        .when(t.rlike(r"^[-+]?[0-9]+(?:\.[0-9]+)?$"), "num")
        .when(t.rlike(RTL), "fa")
        .when(t.rlike(LTR), "en")
        .when(t.rlike("[0-9۰-۹٠-٩]"), "num")
        .otherwise("sym")
    )


def first_strong(text: Column) -> Column:
    """rtl or ltr by the first letter of either; null if there is none."""
    first = F.regexp_extract(text, f"({RTL}|{LTR})", 1)
    return F.when(first.rlike(RTL), "rtl").when(first != "", "ltr")


def is_ltr_text(text: Column) -> Column:
    right, left = F.regexp_count(text, F.lit(RTL)), F.regexp_count(text, F.lit(LTR))
    return (left > 0) & ((right == 0) | ((first_strong(text) == "ltr") & (left > right)))


def is_rtl_text(text: Column) -> Column:
    return text.rlike(RTL) & ~is_ltr_text(text)


def no_justify(text: Column) -> Column:
    """A run of 32 characters without a blank, or an address of 16."""
    return text.rlike(r"\S{32,}") | text.rlike(r"https?://\S{9,}")


def text_width(text: Column) -> Column:
    """Width by classes of characters; each character counts in the first class that it is in."""
    rest, total = text, F.lit(0.0)
    for pattern, width in WIDTHS:
        left = F.regexp_replace(rest, pattern, "")
        total = total + (F.length(rest) - F.length(left)) * F.lit(width)
        rest = left
    return total + F.length(rest) * F.lit(WIDTH_OF_OTHERS)


def decode_entities(text: Column, entities: dict[str, str] = ENTITIES) -> Column:
    """Named entities; the ampersand last, so that what it uncovers stays."""
    for name, to in entities.items():
        text = F.replace(text, F.lit(name), F.lit(to))
    return text


def clean_sheet(name: Column, fallback: Column) -> Column:
    """A legal sheet name of 31 characters at most."""
    t = F.btrim(F.regexp_replace(F.regexp_replace(name, r"[\\/?*\[\]:]", " "), r"[ \t\n]+", " "))
    t = F.rtrim(F.substring(F.btrim(t, F.lit("'")), 1, 31))
    return F.when((t == "") | (F.lower(t) == "history"), fallback).otherwise(t)


def csv_field(value: Column, sep: str = ",") -> Column:
    """Quoted if it holds the separator, a quote or a line end, or has a blank at an edge."""
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.rlike(f'[{sep}"\\r\\n]|^[ \\t]|[ \\t]$'), quoted).otherwise(value)


def table_cell(value: Column) -> Column:
    """A cell of a Markdown table: one line, bars and marks escaped."""
    t = F.regexp_replace(F.btrim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\r\n?|\n", "<br>")), r"([*`$~])", r"\\$1")
    return F.replace(t, F.lit("|"), F.lit("\\|"))


def strip_marks(text: Column) -> Column:
    """Inline Markdown as plain text: links by their label, images, tags and emphasis gone."""
    t = F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)", "")
    t = F.regexp_replace(t, r"\[([^\]]*)\]\([^)]*\)", "$1")
    t = F.regexp_replace(F.regexp_replace(t, r"<[^>]+>", ""), r"[*_`~]+", "")
    return F.btrim(F.regexp_replace(t, r"[ \t\n\r]+", " "))


def held_out_share(name: Column, salt: str) -> Column:
    """A fixed place of a name in [0, 1), by its hash."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(salt + "\n"), name), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def marker_number(text: Column) -> Column:
    """The number of a list marker such as 9. or 12), in any of the three digit sets."""
    return F.nullif(F.regexp_extract(F.translate(text, OTHER_DIGITS, ASCII_DIGITS), r"^[ \t]*\(?([0-9]{1,9})[.)][ \t]", 1), F.lit("")).cast("long")


def link_href(value: Column) -> Column:
    """mailto: before an address, https: before a bare site."""
    t = F.btrim(value)
    return F.when(t.rlike(r"^[^\s@:/]+@[^\s@:/]+\.[A-Za-z]{2,}$"), F.concat(F.lit("mailto:"), t)).when(t.rlike(r"^(?:[a-z0-9-]+\.)+[a-z]{2,}(?:[/?#]\S*)?$"), F.concat(F.lit("https://"), t)).otherwise(t)


def furniture_key(line: Column) -> Column:
    """A line without what changes from page to page: digits folded, blanks and zero-width characters gone."""
    return F.regexp_replace(F.regexp_replace(line, "[0-9۰-۹٠-٩]", "#"), r"[ \t\n\r\x{00A0}\x{200B}-\x{200F}\x{FEFF}]", "")


def natural_key(name: Column) -> list[Column]:
    """Sort keys by which a2 comes before a10: the letters before the first number, the number, the rest."""
    low = F.lower(name)
    return [F.regexp_extract(low, "^([^0-9]*)", 1), F.coalesce(F.nullif(F.regexp_extract(low, "^[^0-9]*([0-9]{1,15})", 1), F.lit("")).cast("long"), F.lit(-1)), low]
