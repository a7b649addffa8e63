"""Article text of raw HTML pages, as a scan."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

# Tags whose content is no article text; shortest text that is believed; where the headline is looked for.
JUNK = {"script", "style", "nav", "header", "footer", "aside", "form", "noscript", "iframe", "figcaption"}
SHORTEST, HEAD = 50, 200

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Reader(HTMLParser):
    """Collects text by place: paragraphs per container, body, page, title."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[list[str]]]] = []
        self.page: list[str] = []
        self.first: dict[str, list[str]] = {}
        self.paragraphs: dict[str, list[list[str]]] = {"article": [], "main": [], "page": []}

    def _tags(self) -> set[str]:
        return {t for t, _ in self.open}

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        if tag == "p" and any(t == "p" for t, _ in self.open):
            self.handle_endtag("p")
        sinks = []
        if not self._tags() & JUNK:
            if tag in ("body", "title", "article", "main") and tag not in self.first:
                self.first[tag] = []
                sinks.append(self.first[tag])
            if tag == "p":
                own: list[str] = []
                sinks.append(own)
                self.paragraphs["page"].append(own)
                for scope in ("article", "main"):
                    if any(s is self.first.get(scope) for _, owners in self.open for s in owners):
                        self.paragraphs[scope].append(own)
        self.open.append((tag, sinks))

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data):
        data = data.strip()
        if data and not self._tags() & JUNK:
            for sink in (self.page, *(s for _, sinks in self.open for s in sinks)):
                sink.append(data)


def article_text(html: str | None, most: int | None = None) -> str:
    """Headline and paragraphs of the first article, main or page; "" for none.

    Pages with next to no paragraph text give all text of the body.  A new
    paragraph ends an open one.  The text is whole unless ``most`` characters
    are asked for.
    """
    page = _Reader()
    page.feed(html or "")
    page.close()
    scope = next((s for s in ("article", "main") if s in page.first), "page")
    text = " ".join(" ".join(p) for p in page.paragraphs[scope])
    if len(text.strip()) < SHORTEST:
        text = " ".join(page.first.get("body", page.page))
    headline = " ".join(page.first.get("title", []))
    if headline and headline.lower() not in text[:HEAD].lower():
        text = f"{headline}. {text}"
    return re.sub(r"\s+", " ", text).strip()[:most]


def extract(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key and text of every page; one pass, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "text": [article_text(h) for h in b[html]]})

    return pages.select(key, html).mapInPandas(run, f"{key} long, text string")
