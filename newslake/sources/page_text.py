"""Text of landed pages by their element tree: unwanted elements go, whatever text is left is collapsed."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from newslake.functions.text import collapsed, remove_boilerplate

# Elements that are dropped, and parts of class and id values that drop theirs.
UNWANTED = ("script", "style", "nav", "header", "footer", "aside", "iframe", "noscript")
UNWANTED_PARTS = ("ad", "sponsor", "promo")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end tag may be left out, with those whose start ends them.
_ENDED_BY = {
    "p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]),
}


class _Text(HTMLParser):
    """Character references are decoded by the base class; open elements are a stack of (name, whether it is dropped)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []
        self.parts: list[str] = []

    def handle_starttag(self, tag, attrs):
        while self.open and tag in _ENDED_BY.get(self.open[-1][0], ()):
            self.open.pop()
        if tag not in _VOID:
            named = any(k in ("class", "id") and any(p in (v or "") for p in UNWANTED_PARTS) for k, v in attrs)
            self.open.append((tag, tag in UNWANTED or named or bool(self.open and self.open[-1][1])))

    def handle_endtag(self, tag):
        if any(name == tag for name, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not self.open or not self.open[-1][1]:
            self.parts.append(data)


def text_of(page: str | None) -> str:
    p = _Text()
    p.feed(page or "")
    p.close()
    return "".join(p.parts)


def page_text(html: Column) -> Column:
    @F.pandas_udf("string")
    def left(pages: pd.Series) -> pd.Series:
        return pd.Series([text_of(x if isinstance(x, str) else "") for x in pages], dtype=object)

    return remove_boilerplate(collapsed(left.asNondeterministic()(html)))
