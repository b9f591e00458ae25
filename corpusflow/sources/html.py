"""Web pages as text with Markdown headings and lists."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import web_clean

#: Elements whose content is no text of the page, that are read, that have no end, and that end when another begins.
SKIPPED = {"script", "style", "nav", "header", "footer", "aside", "noscript", "iframe", "form"}
READ = {"h1": "\n# {}\n", "h2": "\n## {}\n", "h3": "\n### {}\n", "h4": "\n### {}\n", "p": "{}", "li": "- {}", "td": "{}", "th": "{}"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CLOSED_BY = {"p": {"p", "ul", "ol", "div", "table", "h1", "h2", "h3", "h4", "article", "section", "footer", "header", "nav", "aside", "form"}, "li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}}


class Reader(HTMLParser):
    """Gathers the text of each read element in the order in which they begin; text in nested ones belongs to all of them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int | None]] = []
        self.found: list[tuple[str, list[str]]] = []
        self.skipped = 0

    def handle_starttag(self, tag, attrs):
        while self.open and tag in CLOSED_BY.get(self.open[-1][0], ()):
            self._close()
        if tag in VOID:
            return
        at = None
        if tag in SKIPPED:
            self.skipped += 1
        elif tag in READ and not self.skipped:
            at = len(self.found)
            self.found.append((tag, []))
        self.open.append((tag, at))

    def _close(self):
        tag, _ = self.open.pop()
        self.skipped -= tag in SKIPPED

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while self.open[-1][0] != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        if not self.skipped and data.strip():
            for _, at in self.open:
                if at is not None:
                    self.found[at][1].append(data.strip())


def structured(html: str) -> str:
    reader = Reader()
    reader.feed(html)
    reader.close()
    return "\n".join(READ[tag].format(" ".join(parts)) for tag, parts in reader.found if parts)


def page_text(html: Column, least: int = 100) -> Column:
    """The text of a page: its headings, paragraphs, lists and cells if that is over 100 characters, else all of it, cleaned. Null for null."""

    @F.arrow_udf("string")
    def read(pages: pa.Array) -> pa.Array:
        return pa.array((structured(h.as_py()) if h.is_valid else None for h in pages), pa.string())

    # not deterministic for the planner, which would read a page again for each condition on its text
    made = F.transform(F.array(read.asNondeterministic()(html)), web_clean)
    text = F.get(F.transform(made, lambda t: F.when(F.length(t) > least, t).otherwise(web_clean(html))), F.lit(0))
    return F.when(html.isNotNull(), text)
