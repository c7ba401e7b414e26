"""Markup reduced to an allow-list of tags, attributes and addresses, by a parser in Arrow batches.

A null text stays null, an empty one empty; markup that isn't closed is read as a browser would: what an open script or
frame swallows is gone. Repeated rows are cleaned each by themselves.
"""

from __future__ import annotations

import re
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Tags that stay, tags that go with all they hold, tags that can't hold anything, attributes that stay.
KEPT = frozenset(
    "a abbr address article aside b bdi bdo big blockquote br caption center cite code col colgroup dd del details dfn dir div dl dt em figcaption figure font footer h1 h2 h3 h4 h5 h6 header hr i img ins kbd li main mark nav ol p pre q rp rt ruby s samp section small span strike strong sub summary sup table tbody td tfoot th thead time tr tt u ul var wbr".split()
)
GONE = frozenset("script style title svg math iframe frame frameset noembed noframes noscript template audio video object applet xmp plaintext head".split())
VOID = frozenset("br col hr img wbr".split())
ATTRIBUTES = frozenset("href src alt title colspan rowspan start dir".split())
ADDRESSES = frozenset(("href", "src"))
ADDRESS = re.compile(r"^(?:(?:https?|mailto|tel):|[^a-z]|[a-z+.-]+(?:[^a-z+.\-:]|$))", re.I)
#: Characters that a browser drops from an address.
DROPPED = re.compile(r"[\s\x00-\x1f\x7f-\x9f᠎​-‍]")


def safe_address(tag: str, name: str, value: str) -> bool:
    bare = DROPPED.sub("", value)
    return bool(ADDRESS.match(bare)) or not bare or (tag == "img" and name == "src" and bare.lower().startswith("data:image/"))


class _Cleaner(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.out: list[str] = []
        self.inside: list[str] = []  # open tags of the GONE kind
        self.open: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in GONE and tag != "head":
            self.inside.append(tag)
        if self.inside or tag not in KEPT:
            return
        kept = []
        for name, value in attrs:
            value = value or ""
            language = re.search(r"\blanguage-([\w+#-]+)", value) if name == "class" else None
            if language:
                kept.append(f'class="language-{language[1]}"')
            elif name == "align" and tag in ("td", "th") and value.lower() in ("left", "right", "center"):
                kept.append(f'align="{value.lower()}"')
            elif name in ATTRIBUTES and (name not in ADDRESSES or safe_address(tag, name, value)):
                kept.append(f'{name}="{escape(value)}"')
        self.out.append(f"<{' '.join([tag, *kept])}>")
        if tag not in VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in GONE:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in GONE:
            if tag in self.inside:
                del self.inside[len(self.inside) - 1 - self.inside[::-1].index(tag) :]
        elif not self.inside and tag in self.open:
            while (last := self.open.pop()) != tag:
                self.out.append(f"</{last}>")
            self.out.append(f"</{tag}>")

    def handle_data(self, data: str) -> None:
        if not self.inside:
            self.out.append(data.replace("<", "&lt;").replace(">", "&gt;"))

    def handle_entityref(self, name: str) -> None:
        if not self.inside:
            self.out.append(f"&{name};")

    def handle_charref(self, name: str) -> None:
        if not self.inside:
            self.out.append(f"&#{name};")


def cleaned(html: str) -> str:
    parser = _Cleaner()
    parser.feed(html)
    parser.close()
    return "".join(parser.out) + "".join(f"</{t}>" for t in reversed(parser.open))


@F.pandas_udf(StringType())
def sanitized(html: pd.Series) -> pd.Series:
    return html.map(lambda x: None if x is None else cleaned(x))
