"""Fields of HTML pages. Broken markup never raises; what cannot be read stays empty."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from textharbor.functions.urls import canonical, resolve

# Elements whose text is not shown, elements without end tags, most alts and sources kept.
HIDDEN = {"script", "style", "nav", "footer", "header", "noscript", "svg"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
MOST_IMAGES = 32

EXTRACTED = StructType(
    [
        StructField("title", StringType()),
        StructField("headings", ArrayType(StringType())),
        StructField("body", StringType()),
        StructField("links", ArrayType(StructType([StructField("url", StringType()), StructField("anchor", StringType())]))),
        StructField("image_alts", ArrayType(StringType())),
        StructField("image_srcs", ArrayType(StringType())),
        StructField("canonical", StringType()),
        StructField("description", StringType()),
    ]
)


class _Page(HTMLParser):
    def __init__(self, url: str) -> None:
        super().__init__(convert_charrefs=True)
        self.url, self.open = url, []
        self.title: str | None = None
        self.text: list[str] = []
        self.headings: list[str] = []
        self.links: list[dict] = []
        self.alts: list[str] = []
        self.srcs: list[str] = []
        self.canonical = self.description = None
        self.collecting: list[tuple[str, list[str], str | None]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "img":
            if len(self.alts) < MOST_IMAGES and a.get("alt", "").strip():
                self.alts.append(a["alt"].strip())
            if len(self.srcs) < MOST_IMAGES and (src := resolve(self.url, a.get("src", ""))):
                self.srcs.append(src)
        elif tag == "link" and "canonical" in a.get("rel", "").lower().split() and self.canonical is None:
            self.canonical = resolve(self.url, a.get("href", ""))
        elif tag == "meta" and "description" in (a.get("name", "").lower(), a.get("property", "").lower().removeprefix("og:")) and self.description is None:
            self.description = a.get("content", "").strip() or None
        if tag in VOID:
            return
        self.open.append(tag)
        if tag == "a" or tag in HEADINGS or (tag == "title" and self.title is None):
            self.collecting.append((tag, [], a.get("href")))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            while self.open and self.open.pop() != tag:
                pass
        for i in range(len(self.collecting) - 1, -1, -1):
            if self.collecting[i][0] == tag:
                self._done(*self.collecting.pop(i))
                break

    def _done(self, tag: str, parts: list[str], href: str | None) -> None:
        text = " ".join(" ".join(parts).split())
        if tag == "title":
            self.title = text if self.title is None else self.title
        elif tag == "a":
            if href is not None and (url := resolve(self.url, href)):
                self.links.append({"url": url, "anchor": text})
        elif text:
            self.headings.append(text)

    def handle_data(self, data: str) -> None:
        for _, parts, _ in self.collecting:
            parts.append(data)
        if not HIDDEN.intersection(self.open) and data.strip():
            self.text.append(" ".join(data.split()))


def extract(url: str, html: str | None) -> dict:
    """The fields of one page. The body holds all shown text, the title's included."""
    page = _Page(url or "")
    try:
        page.feed(html or "")
        page.close()
    except (AssertionError, ValueError):
        pass
    for left in page.collecting:
        page._done(*left)
    return {
        "title": page.title or "",
        "headings": page.headings,
        "body": " ".join(page.text),
        "links": page.links,
        "image_alts": page.alts,
        "image_srcs": page.srcs,
        "canonical": canonical(page.canonical) if page.canonical else None,
        "description": page.description,
    }


@F.pandas_udf(EXTRACTED)
def extract_html(pages: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Struct of the fields of (url, html)."""
    for url, html in pages:
        yield pd.DataFrame([extract(u, h) for u, h in zip(url, html)], columns=EXTRACTED.fieldNames())
