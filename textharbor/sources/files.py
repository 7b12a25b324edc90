"""Documents from text, Markdown and HTML files; queries and judgments from TSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textharbor.functions.hashing import fnv1a_hex
from textharbor.sources.html import extract_html

KINDS = ("txt", "md", "html", "htm")


def scan(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(files of known kinds: path, kind, stem, text, timestamp), (skipped: n). All folders below root are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    known = files.withColumn("kind", kind).where(F.col("kind").isin(*KINDS))
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    found = known.select("path", "kind", stem.alias("stem"), F.decode("content", "UTF-8").alias("text"), F.unix_timestamp("modificationTime").alias("timestamp"))
    skipped = files.select(kind.alias("kind")).where(~F.col("kind").isin(*KINDS)).agg(F.count("*").alias("n"))
    return found, skipped


def markdown_title(text: Column) -> Column:
    """First heading that says something; null where there is none."""
    heads = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: x.startswith("#") & (F.trim(F.regexp_replace(x, "^#+", "")) != ""))
    return F.trim(F.regexp_replace(F.get(heads, F.lit(0)), "^#+", ""))


def markdown_body(text: Column) -> Column:
    """Lines, trimmed, without fences; heading lines without their marks, others without emphasis and list marks."""
    lines = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: ~x.startswith("```"))
    heading = lambda x: F.trim(F.regexp_replace(x, "^#+", ""))
    other = lambda x: F.regexp_replace(F.regexp_replace(x, r"\*\*|__|`", ""), r"^[*\-> ]+", "")
    return F.array_join(F.transform(lines, lambda x: F.when(x.startswith("#"), heading(x)).otherwise(other(x))), "\n")


def documents_from(files: DataFrame) -> DataFrame:
    """Rows of the document schema: id and hash by FNV-1a, title by kind, html through the extractor."""
    html = F.col("kind").isin("html", "htm")
    page = F.when(html, extract_html(F.col("path"), F.col("text")))
    rows = files.withColumn("page", page)
    title = F.when(F.col("kind") == "md", markdown_title(F.col("text"))).when(html, F.nullif(F.col("page.title"), F.lit("")))
    alts = F.coalesce(F.col("page.image_alts"), F.array().cast("array<string>"))
    alt_text = F.when(F.size(alts) > 0, F.concat(F.lit("\n\n"), F.array_join(alts, "\n"))).otherwise("")
    body = F.when(F.col("kind") == "md", markdown_body(F.col("text"))).when(html, F.concat(F.col("page.body"), alt_text)).otherwise(F.col("text"))
    links = F.slice(F.transform(F.coalesce(F.col("page.links"), F.array().cast("array<struct<url:string,anchor:string>>")), lambda x: F.regexp_replace(x["url"], "^file://", "")), 1, 64)
    rows = rows.withColumn("title", F.coalesce(title, F.col("stem"))).withColumn("body", F.coalesce(body, F.lit("")))
    return rows.select(
        fnv1a_hex(F.col("path")).alias("id_hex"),
        F.struct(F.lit("file").alias("kind"), F.col("path").alias("value")).alias("source"),
        F.col("path").alias("url"),
        "title",
        F.coalesce(F.col("page.headings"), F.array().cast("array<string>")).alias("headings"),
        "body",
        F.array().cast("array<string>").alias("anchor_text"),
        F.map_filter(F.create_map(F.lit("path"), F.col("path"), F.lit("outlinks"), F.array_join(links, "\n")), lambda k, v: v != "").alias("metadata"),
        "timestamp",
        F.lit("en").alias("language"),
        fnv1a_hex(F.concat_ws("\n", "title", "body")).alias("content_hash"),
    )


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated rows; ``#`` starts a comment, blank lines are left out, malformed rows are errors."""
    return spark.read.option("sep", "\t").option("comment", "#").option("mode", "FAILFAST").schema(schema).csv(path)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, "query_id string, text string")


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    """Judged documents; grades other than 0 to 3 and empty ids or documents are errors. Of a document judged twice, the last grade stands."""
    rows = read_tsv(spark, path, "query_id string, grade int, doc string").select(F.trim("query_id").alias("query_id"), "grade", F.trim("doc").alias("doc"), F.monotonically_increasing_id().alias("at"))
    good = F.coalesce(F.col("grade").between(0, 3) & (F.col("query_id") != "") & (F.col("doc") != ""), F.lit(False))
    told = F.concat(F.lit("judgments: bad grade, id or document: "), F.to_json(F.struct("query_id", "grade", "doc")))
    checked = rows.withColumn("grade", F.when(good, F.col("grade")).otherwise(F.raise_error(told).cast("int")))
    return checked.groupBy("query_id", "doc").agg(F.max_by("grade", "at").alias("grade")).select("query_id", "grade", "doc")


def query_ids(judged: DataFrame) -> DataFrame:
    """The judged queries, in order."""
    return judged.select("query_id").distinct().orderBy("query_id")


def text_document(doc_id: int, address: str, title: str, body: str) -> dict:
    """A document of text alone. The address is its source; its url stays empty."""
    return {"doc_id": doc_id, "source": {"kind": "file", "value": address}, "url": "", "title": title, "headings": [], "body": body, "anchor_text": [], "metadata": {}, "timestamp": 0, "language": "en", "content_hash": ""}
