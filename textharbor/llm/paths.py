"""Consensus host paths (problem 4): votes of a host's pages on the generalised paths of their containers.

1. *Containers.* From HTML, every block of text with its tag-class path: tags and class names from the root down, digits in names ``#``,
   positions dropped (``containers_of_html``). From pages whose tags are gone, every line with a path of its
   shape: what kind of line it is, how long, and between which neighbours (``containers_of_lines``); a run of lines of one kind is what a list was.
2. *Score.* On every page, each path's lines are scored by how many lie within the running text, from its first to its last
   prose line, less those that are links.
3. *Vote.* A page votes for a path if its score is a half or more. A host keeps a path if at least half of its pages with that path vote
   for it; hosts with under ``least`` such pages follow the vote of all hosts.
4. *Extraction.* Lines on paths that were kept are main content, all others are furniture.

Defined results: null and empty bodies have no containers; pages without host count as one host each; repeated rows of one key count
once; a page without any prose line has no running text, and nothing of it is kept unless its host's other pages keep the path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textharbor.llm.common import cut, host_of, map_batches, one_per_key, sized

LEAST_PAGES = 5
KEEP = 0.5
PROSE_WORDS = 7
# Elements that hold a block of text, elements whose text is not shown, elements without end tags.
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "dd", "div", "dt", "figcaption", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "html", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul"}
UNSHOWN = {"script", "style", "noscript", "template", "svg", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def _norm(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " ")))


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str]] = []
        self.blocks: list[list] = []  # path, text, characters of links
        self.fresh = True

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS or tag == "br":
            self.fresh = True
        if tag not in VOID:
            names = sorted({re.sub(r"\d+", "#", x) for k, v in attrs if k in ("class", "id") and v for x in v.lower().split()})
            self.open.append((tag, ".".join([tag, *names])))

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass
        if tag in BLOCKS:
            self.fresh = True

    def handle_data(self, data: str) -> None:
        if not (text := " ".join(data.split())) or any(t in UNSHOWN for t, _ in self.open):
            return
        if self.fresh or not self.blocks:
            self.blocks.append(["/".join(p for t, p in self.open if t in BLOCKS and t not in ("html", "body")), "", 0])
            self.fresh = False
        block = self.blocks[-1]
        block[1] = f"{block[1]} {text}".strip()
        if any(t == "a" for t, _ in self.open):
            block[2] += len(text)


def blocks_of(html: str | None) -> list[tuple[str, str, bool]]:
    """(tag-class path, text, whether it is mostly links) of every block of text of a page. Broken markup never raises."""
    page = _Blocks()
    try:
        page.feed(html or "")
        page.close()
    except (AssertionError, ValueError):
        pass
    return [(path, text, 2 * linked > len(text)) for path, text, linked in page.blocks]


def containers_of_html(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """(key, host, no, path, text, link, prose) of the blocks of ``html``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("key", "host", "no", "path", "text", "link")}
            for key, host, page in zip(*(b.column(c).to_pylist() for c in ("key", "host", "html"))):
                for no, (path, text, link) in enumerate(blocks_of(page)):
                    for k, v in zip(out, (key, host, no, path, text, link)):
                        out[k].append(v)
            yield out

    rows = one_per_key(pages, key).where(F.col(key).isNotNull() & F.col(html).isNotNull())
    rows = rows.select(F.col(key).cast("long").alias("key"), _host(url, key), F.col(html).alias("html"))
    found = map_batches(rows, work, "key long, host string, no int, path string, text string, link boolean")
    return found.withColumn("prose", ~F.col("link") & _is_prose(F.col("text")))


def _host(url: str, key: str) -> Column:
    return F.coalesce(host_of(F.col(url)), F.concat(F.lit("#"), F.col(key).cast("string"))).alias("host")


def _words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def _is_prose(text: Column) -> Column:
    return (_words(text) >= PROSE_WORDS) & F.trim(text).rlike(r"[.!?…)]$")


def containers_of_lines(pages: DataFrame, key: str) -> DataFrame:
    """(key, host, no, path, text, link, prose) of the lines of ``pages(key, url, body[, title, links])``."""
    anchors = F.array_distinct(F.transform(F.coalesce("links", F.array().cast(pages.schema["links"].dataType)), lambda x: _norm(x["anchor"]))) if "links" in pages.columns else F.array().cast("array<string>")
    title = _norm(F.col("title")) if "title" in pages.columns else F.lit(None).cast("string")
    rows = one_per_key(pages, key).where(F.col(key).isNotNull() & (F.col("body") != ""))
    rows = rows.select(F.col(key).cast("long").alias("key"), _host("url", key), title.alias("title"), anchors.alias("anchors"), F.posexplode(F.split("body", "\n")).alias("no", "text"))
    rows = rows.where(F.trim("text") != "").withColumn("form", _norm(F.col("text"))).withColumn("words", _words(F.col("text")))
    is_link = F.coalesce(F.array_contains("anchors", F.col("form")) & (F.col("form") != F.coalesce("title", F.lit(""))), F.lit(False))
    end = F.trim("text").rlike(r"[.!?…)]$")
    kind = (
        F.when(F.col("form") == F.col("title"), "title")
        .when(F.col("link"), "link")
        .when(F.col("text").rlike(r"\s[|·•>/»]\s"), "trail")
        .when(F.col("text").rlike(r"^\s*(?:[*•–-]|\d+[.)])\s"), "item")
        .when(F.col("text").rlike(r"[©®™]"), "sign")
        .when(F.col("prose"), F.when(F.col("words") >= 25, "paragraph").otherwise("sentence"))
        .when(end, "remark")
        .when(F.col("words") <= 3, "label")
        .otherwise("phrase")
    )
    rows = rows.select("key", "host", "no", "text", "words", is_link.alias("link"), "form", "title").withColumn("prose", ~F.col("link") & (F.col("words") >= PROSE_WORDS) & end)
    rows = rows.withColumn("kind", kind)
    page = Window.partitionBy("key").orderBy("no")
    before, after = F.coalesce(F.lag("kind").over(page), F.lit("^")), F.coalesce(F.lead("kind").over(page), F.lit("$"))
    size = F.floor(F.log2(F.greatest("words", F.lit(1)).cast("double"))).cast("string")
    # like neighbours are a list; unlike ones are what stands before and after
    inside = F.when((before == F.col("kind")) & (after == F.col("kind")), F.lit("list")).otherwise(F.concat_ws("+", before, after))
    return rows.select("key", "host", "no", F.concat_ws("/", inside, F.concat_ws(".", F.col("kind"), size)).alias("path"), "text", "link", "prose")


def path_votes(containers: DataFrame, least: int = LEAST_PAGES, keep: float = KEEP) -> tuple[DataFrame, DataFrame]:
    """(host, path) of the paths that a host votes out, where it has pages enough to vote, and (path) of those that all hosts vote out.

    The first one has ``out``, false for the paths that a host keeps, as these overrule the vote of all.
    """
    page = Window.partitionBy("key")
    first, last = (f(F.when(F.col("prose"), F.col("no"))).over(page) for f in (F.min, F.max))
    within = F.coalesce(F.col("no").between(first, last), F.lit(False))
    scored = containers.withColumn("inside", within).groupBy("key", "host", "path").agg(F.avg(F.col("inside").cast("double") - F.col("link").cast("double")).alias("score"))
    votes = scored.groupBy("host", "path").agg(F.count("*").alias("pages"), F.sum((F.col("score") >= 0.5).cast("int")).alias("votes"))
    votes = cut(votes)
    everywhere = votes.groupBy("path").agg(F.sum("pages").alias("pages"), F.sum("votes").alias("votes"))
    lost = F.col("votes") < keep * F.col("pages")
    return votes.where(F.col("pages") >= least).select("host", "path", lost.alias("out")), everywhere.where(lost).select("path")


def furniture(containers: DataFrame, least: int = LEAST_PAGES, keep: float = KEEP) -> DataFrame:
    """(key, no) of the containers on paths that were voted out."""
    own, everywhere = path_votes(containers, least, keep)
    rows = containers.select("key", "host", "no", "path").join(sized(cut(own)), ["host", "path"], "left")
    rows = rows.join(sized(cut(everywhere)).withColumn("gone", F.lit(True)), "path", "left")
    return rows.where(F.coalesce("out", "gone", F.lit(False))).select("key", "no")


def main_text(containers: DataFrame, **how) -> DataFrame:
    """(key, main): the text of the containers that were kept, one a line; null for pages of which nothing is kept."""
    lost = furniture(containers, **how).withColumn("lost", F.lit(True))
    rows = containers.select("key", "no", "text").join(lost.hint("merge"), ["key", "no"], "left")
    kept = F.array_sort(F.collect_list(F.when(F.col("lost").isNull(), F.struct("no", "text"))))
    text = F.transform(kept, lambda x: x["text"])
    return rows.groupBy("key").agg(F.when(F.size(kept) > 0, F.array_join(text, "\n")).alias("main"))
