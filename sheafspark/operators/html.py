"""HTML as text: titles, metadata, links, plain text, sanitized markup, provenance, Markdown."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sheafspark.functions.text import ENTITIES, decode_entities

#: Tags of formatted text; two letters beyond ASCII that SQL takes for k and s without regard to case.
RICH = r"(?i)<(table|ul|ol|h[1-6]|bloc[k\x{212A}]quote|pre|img|b|[s\x{017F}]trong|i|em|a)[ \t\n>/]"
#: Patterns in producer strings and addresses, and the engines they show.
ENGINES = (("wordpress", "wordpress"), ("libreoffice|openoffice", "libreoffice"), ("microsoft|mso", "word"), ("wkhtmltopdf", "wkhtmltopdf"), ("skia|chrom(e|ium)", "chrome"), ("pandoc", "pandoc"), ("blog", "blog"))


def without_scripts(html: Column) -> Column:
    """Scripts, styles and comments first: their text may hold tags."""
    t = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", "")
    t = F.regexp_replace(t, r"(?is)<style[^>]*>.*?</style>", "")
    return F.regexp_replace(t, r"(?s)<!--.*?-->", "")


def title(html: Column, entities: dict[str, str] = ENTITIES) -> Column:
    """The first title with those entities decoded, without blanks of any width at its edges."""
    text = decode_entities(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), entities)
    return F.regexp_replace(text, r"\A\p{Zs}+|\p{Zs}+\z", "")


def language(html: Column) -> Column:
    """The page's language in lower case, letter by letter: no letter becomes two or depends on its place."""
    return F.lower(F.translate(F.regexp_extract(html, r'(?i)<html[^>]* lang="([^"]*)"', 1), "İΣ", "iσ"))


def meta(html: Column, name: str) -> Column:
    """The content of the first meta tag of the name."""
    return F.regexp_extract(html, rf'(?i)<meta name="{name}" content="([^"]*)"', 1)


def plain_text(html: Column) -> Column:
    """Visible text on one line: tags become blanks."""
    t = F.regexp_replace(without_scripts(html), r"<[^>]*>", " ")
    return F.btrim(F.regexp_replace(decode_entities(t), r"[ \t\n\r]+", " "))


def is_rich(html: Column, office: bool = True) -> Column:
    """Whether the page has tags of formatted text or, unless office is False, marks of an office program."""
    return html.rlike(RICH) | html.rlike(r'class="?Mso|urn:schemas-microsoft-com:office') if office else html.rlike(RICH)


def links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, place (from 1), href, label of each link, however its address is quoted."""
    tag = r"""(?is)<a\s(?:[^>"']|"[^"]*"|'[^']*')*?(?<=[\s"'])href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)(?:[^>"']|"[^"]*"|'[^']*')*>(.*?)</a\s*>"""
    found = F.transform(F.regexp_extract_all(html, F.lit(tag), 1), lambda x: F.regexp_replace(x, r"""^["']|["']$""", ""))
    labels = F.regexp_extract_all(html, F.lit(tag), 2)
    rows = pages.select(key, F.posexplode(F.arrays_zip(found.alias("href"), labels.alias("label"))).alias("i", "x"))
    label = F.btrim(F.regexp_replace(decode_entities(F.regexp_replace("x.label", r"<[^>]*>", " ")), r"[ \t\n\r]+", " "))
    return rows.select(key, (F.col("i") + 1).cast("long").alias("place"), F.col("x.href").alias("href"), label.alias("label"))


def provenance(text: Column, engines: tuple[tuple[str, str], ...] = ENGINES) -> Column:
    """The first of the engines that a producer or generator string names; unknown if none."""
    out = None
    for pattern, engine in engines:
        test = F.lower(text).rlike(pattern)
        out = F.when(test, engine) if out is None else out.when(test, engine)
    return out.otherwise("unknown")


class _ToMarkdown(HTMLParser):
    """Writes headings, paragraphs, lists, quotes, tables, links and emphasis as Markdown; skips furniture."""

    SKIP, BLOCK = {"script", "style", "nav", "footer", "head", "iframe"}, {"p", "div", "article", "section", "ul", "ol", "table", "blockquote", "pre"}
    MARK = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip, self.lists, self.href, self.cells = 0, [], [], None

    def gap(self, n: int = 2) -> None:
        if self.cells is None:
            self.out.append("\n" * n)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SKIP:
            self.skip += 1
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n" + "  " * (len(self.lists) - 1) + ("1. " if self.lists[-1:] == ["ol"] else "- "))
        elif tag == "br":
            self.out.append("<br>" if self.cells is not None else "\n")
        elif tag == "tr":
            self.cells = []
        elif tag in ("td", "th") and self.cells is not None:
            self.cells.append(len(self.out))
        elif tag == "a":
            self.href.append(dict(attrs).get("href") or "")
            self.out.append("[")
        elif tag in self.MARK:
            self.out.append(self.MARK[tag])
        elif tag in self.BLOCK:
            if tag in ("ul", "ol"):
                self.lists.append(tag)
            self.gap(1 if len(self.lists) > 1 else 2)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "tr" and self.cells is not None:
            edges = [*self.cells, len(self.out)]
            row = ["".join(self.out[a:b]).strip().replace("|", "\\|").replace("\n", " ") for a, b in zip(edges, edges[1:])]
            first = not any(x.startswith("\n| ") for x in self.out[-2:])
            del self.out[edges[0] :]
            self.out.append("\n| " + " | ".join(row) + " |" + ("\n|" + " --- |" * len(row) if first else ""))
            self.cells = None
        elif tag == "a" and self.href:
            self.out.append(f"]({self.href.pop()})")
        elif tag in self.MARK:
            self.out.append(self.MARK[tag])
        elif tag in self.BLOCK or tag.startswith("h"):
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
            self.gap()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.out.append(" ".join(data.split()) if data.strip() else " ")


def html_to_markdown(html: str | None) -> str:
    import re

    parser = _ToMarkdown()
    parser.feed(html or "")
    parser.close()
    text = re.sub(r"[ \t]+\n", "\n", "".join(parser.out))
    return re.sub(r"\n{3,}", "\n\n", text).strip() + "\n"


@F.pandas_udf(StringType())
def markdown(html: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Structure of a page as Markdown: needs a parser's state, so it runs in Python by Arrow batches."""
    for part in html:
        yield part.map(html_to_markdown)


def filled_grid(rows: list[list[tuple[str, int, int]]], repeat: bool = False) -> list[list[str]]:
    """Cells (text, rowspan, colspan) placed on a grid: across columns the text once, down rows once or repeated."""
    grid: list[dict[int, str]] = []
    for r, cells in enumerate(rows):
        while len(grid) <= r:
            grid.append({})
        c = 0
        for text, down, across in cells:
            while c in grid[r]:
                c += 1
            for i in range(max(down, 1)):
                while len(grid) <= r + i:
                    grid.append({})
                for j in range(max(across, 1)):
                    grid[r + i][c + j] = text if j == 0 and (i == 0 or repeat) else ""
            c += max(across, 1)
    wide = max((max(g, default=-1) + 1 for g in grid), default=0)
    return [[g.get(c, "") for c in range(wide)] for g in grid[: len(rows)]]
