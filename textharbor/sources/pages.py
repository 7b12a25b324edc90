"""Fetched pages as documents of the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textharbor.functions.analysis import normalize_text
from textharbor.functions.hashing import fnv1a_hex

MOST_ANCHORS, MOST_LINKS = 16, 64


def numeric_id(hex_: Column) -> Column:
    """The 64 bits of 16 hex digits as a signed number."""
    half = lambda at: F.conv(F.substring(hex_, at, 8), 16, 10).cast("bigint")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def documents_from_pages(pages: DataFrame, source: str = "crawl") -> DataFrame:
    """Document rows of ``pages(url, title, headings, body, links, image_alts, description[, image_srcs, crawl_source, timestamp])``.

    Alternative texts are appended to the body; anchors are the page's own link texts; the title falls back to the url. Images are counted by their
    sources where there is such a column, else by their alternative texts.
    """
    alts = F.coalesce("image_alts", F.array().cast("array<string>"))
    srcs = F.coalesce("image_srcs", F.array().cast("array<string>")) if "image_srcs" in pages.columns else alts
    headings = F.coalesce("headings", F.array().cast("array<string>"))
    body = F.concat(F.coalesce("body", F.lit("")), F.when(F.size(alts) > 0, F.concat(F.lit("\n\n"), F.array_join(alts, "\n"))).otherwise(""))
    links = F.coalesce("links", F.array().cast("array<struct<url:string,anchor:string>>"))
    anchors = F.slice(F.filter(F.transform(links, lambda x: F.trim(x["anchor"])), lambda x: x != ""), 1, MOST_ANCHORS)
    data = {
        "crawl_source": F.coalesce("crawl_source", F.lit(source)) if "crawl_source" in pages.columns else F.lit(source),
        "outlinks": F.array_join(F.slice(F.transform(links, lambda x: x["url"]), 1, MOST_LINKS), "\n"),
        "image_refs": F.array_join(srcs, ",") if "image_srcs" in pages.columns else F.lit(""),
        "image_count": F.when(F.size(srcs) > 0, F.size(srcs).cast("string")).otherwise(""),
        "description": F.coalesce("description", F.lit("")),
    }
    data = F.create_map(*[x for k, v in data.items() for x in (F.lit(k), v)])
    id_hex = fnv1a_hex(F.coalesce("url", F.lit("")))
    rows = pages.select(
        id_hex.alias("id_hex"),
        F.struct(F.lit("web").alias("kind"), F.col("url").alias("value")).alias("source"),
        "url",
        F.coalesce(F.nullif(F.trim("title"), F.lit("")), "url").alias("title"),
        headings.alias("headings"),
        body.alias("body"),
        anchors.alias("anchor_text"),
        F.map_filter(data, lambda k, v: v != "").alias("metadata"),
        (F.col("timestamp") if "timestamp" in pages.columns else F.lit(0)).cast("bigint").alias("timestamp"),
        F.lit("en").alias("language"),
        fnv1a_hex(normalize_text(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.array_join(headings, "\n"), body))).alias("content_hash"),
    )
    return rows.select(numeric_id(F.col("id_hex")).alias("doc_id"), "*")
