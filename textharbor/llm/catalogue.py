"""Queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textharbor.llm import boilerplate, distinctive, encoding, history, language, leakage, lookalike, mixing, paths, sitelines, spam
from textharbor.llm.common import cut, shared_dir, sized, table


def _spam(spark: SparkSession, d: str, tab: str, key: str) -> DataFrame:
    """Records of one table that problem 6 lists. Hosts are counted over both tables, as there."""
    found = spam.spam_pages(table(spark, d, "docs"), table(spark, d, "extracted"), table(spark, d, "lang_samples"))
    return cut(found.where(F.col("tab") == tab).select(F.col("rec_id").alias(key)))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return sitelines.found_lines(table(spark, d, "docs")).select("doc_id", "line_no")


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every row of docs with its body without the lines that its site repeats."""
    return sitelines.without_repeated_lines(table(spark, d, "docs")).select("doc_id", "clean_body", "removed")


def p1_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Per host: lines, different lines, and those that the exact count confirmed."""
    return sitelines.host_summary(table(spark, d, "docs")).select("host", "lines", "distinct_lines", "repeated")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = lookalike.same_looking(table(spark, d, "docs"), "doc_id", "title")
    return pairs.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p2_titles(spark: SparkSession, d: str) -> DataFrame:
    """One consistent form and a skeleton of every distinct title."""
    return lookalike.consistent_forms(table(spark, d, "docs").select(F.col("title").alias("s")))


def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    """The same of every distinct term, which analysis lower-cased."""
    return lookalike.consistent_forms(table(spark, d, "tokens").select(F.col("term").alias("s")), lowered=True)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    docs, samples = table(spark, d, "docs"), table(spark, d, "lang_samples")
    found = language.wrong_labels(docs, "doc_id", "body", "language", language.model_of(samples, docs))
    return found.join(sized(_spam(spark, d, "docs", "doc_id")), "doc_id", "left_anti").select("doc_id", "line_no", "language")


def p3_languages(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of every document and of every foreign line."""
    docs, samples = table(spark, d, "docs"), table(spark, d, "lang_samples")
    return language.identify(docs, "doc_id", "body", "language", language.model_of(samples, docs))


def p4_method(spark: SparkSession, d: str) -> DataFrame:
    """Furniture lines by consensus host paths alone, paths being those of the lines' shape: (page_id, line_no)."""
    lines = paths.containers_of_lines(table(spark, d, "extracted").select("page_id", "url", "title", "body", "links"), "page_id")
    return paths.furniture(cut(lines.drop("text"))).select(F.col("key").alias("page_id"), F.col("no").alias("line_no"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "extracted")
    found = boilerplate.furniture_lines(pages.select("page_id", "url", "title", "body", "links"), "page_id")
    return found.join(sized(_spam(spark, d, "extracted", "page_id")), "page_id", "left_anti")


def p4_main(spark: SparkSession, d: str) -> DataFrame:
    """Every page with its main body and headings."""
    return boilerplate.main_content(table(spark, d, "extracted"), "page_id").select("page_id", "main_body", "main_headings")


def p4_main_docs(spark: SparkSession, d: str) -> DataFrame:
    """Every row of docs with its main body."""
    docs = table(spark, d, "docs").select("doc_id", "url", "title", "headings", "body")
    return boilerplate.main_content(docs, "doc_id").select("doc_id", "main_body", "main_headings")


def p5_method(spark: SparkSession, d: str) -> DataFrame:
    """The graph-of-words weight of every term of every record."""
    return distinctive.term_weights(table(spark, d, "docs"), "doc_id", "body", digits=6)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = distinctive.term_weights(table(spark, d, "docs"), "doc_id", "body", min_tf=3, max_df=4)
    return found.where(F.col("term").rlike(r"\p{L}")).select("doc_id", "term")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_pages(table(spark, d, "docs"), table(spark, d, "extracted"), table(spark, d, "lang_samples")).select("tab", "rec_id")


def p6_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Flagged records with their phrases, list lines and link lines."""
    docs, extracted = table(spark, d, "docs"), table(spark, d, "extracted")
    return spam.evidence(spam.spam_pages(docs, extracted, table(spark, d, "lang_samples")), docs, extracted)


def p7_method(spark: SparkSession, d: str) -> DataFrame:
    """Repeats of originals of earlier batches, as p7_found asks for them, by the pivot-distance table, with their word distance."""
    found = history.repeats(table(spark, d, "docs"), "doc_id", "body", "seg", without=_spam(spark, d, "docs", "doc_id"), pivots=True)
    return found.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"), "distance")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = history.repeats(table(spark, d, "docs"), "doc_id", "body", "seg", without=_spam(spark, d, "docs", "doc_id"))
    return found.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def _kept(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"


def _newest(spark: SparkSession, d: str, pivots: bool) -> DataFrame:
    """(a, b, distance): repeats in the newest batch, found from that batch and the stored signatures of earlier originals."""
    docs = table(spark, d, "docs")
    last = docs.agg(F.max("seg").alias("s")).first().s
    left_out, before = _spam(spark, d, "docs", "doc_id"), docs.where(F.col("seg") < last)
    earlier = history.repeats(before, "doc_id", "body", "seg", without=left_out, pivots=pivots).select(F.col("b").alias("key")).distinct()
    signs = history.signatures(before, "doc_id", "body", "seg", pivots=pivots).join(sized(left_out.select(F.col("doc_id").alias("key"))), "key", "left_anti")
    path = _kept(spark)
    history.append(signs.dropDuplicates(["key"]).join(sized(cut(earlier)), "key", "left_anti"), path)
    return history.repeats_of_history(docs.where(F.col("seg") == last), path, docs, "doc_id", "body", "seg", without=left_out, pivots=pivots)[0]


def p7_batch(spark: SparkSession, d: str) -> DataFrame:
    """The rows of p7_found whose later document is of the newest batch, found from that batch and the stored signatures of earlier originals."""
    return _newest(spark, d, False).select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p7_pivots(spark: SparkSession, d: str) -> DataFrame:
    """The rows of p7_method whose later document is of the newest batch, found from that batch and the stored pivot distances of earlier originals."""
    return _newest(spark, d, True).select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"), "distance")


def p7_exact(spark: SparkSession, d: str) -> DataFrame:
    """Documents of later batches whose text hash a signature accepted before them holds: (doc_id, first accepted doc_id)."""
    return history.known_hashes(table(spark, d, "docs"), table(spark, d, "dedup_state"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.leaked_items(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "prompt")
    return found.select("doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Every leaked item with the number of its documents."""
    found = leakage.leaked_items(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "prompt")
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.max("words").alias("most_places"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), "doc_id", "text", "source", table(spark, d, "mix_targets"))[0]


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), "doc_id", "text", "source", table(spark, d, "mix_targets"))[1]


def _garbled(spark: SparkSession, d: str, repair: bool) -> DataFrame:
    documents = table(spark, d, "documents")
    tables = encoding.train(documents, "text")
    found = encoding.survey(documents, "doc_id", "text", tables)
    return encoding.garbled(documents, "doc_id", "text", tables, **encoding.validated_margins(found), repair=repair, found=found)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d, False).select("doc_id").distinct()


def p10_repaired(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d, True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


_HOST = r"regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:@]+)', 1)"
_FORM = r"trim(regexp_replace(regexp_replace(lower(x), '[\s\p{Z}]+', ' ', 'g'), '[0-9]+', '0', 'g'))"
_ONE = "one AS (SELECT * FROM docs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY seg) = 1)"
_LINES = f"""{_ONE}, l AS (SELECT doc_id, {_HOST} AS host, unnest(string_split(body, chr(10))) AS x, unnest(range(len(string_split(body, chr(10)))))::INT AS line_no FROM one WHERE url IS NOT NULL AND body IS NOT NULL),
f AS (SELECT doc_id, host, line_no, {_FORM} AS form FROM l WHERE host <> ''), g AS (SELECT host, form FROM f WHERE form <> '' GROUP BY host, form HAVING count(DISTINCT doc_id) >= 10)"""
_WORDS = r"""w AS (SELECT doc_id, regexp_extract_all(lower(body), '[\p{L}\p{N}]+') AS ws FROM one WHERE body IS NOT NULL), t AS (SELECT doc_id, unnest(ws) AS term, unnest(range(len(ws))) AS i FROM w),
c AS (SELECT doc_id, term, count(*)::INT AS tf FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM c GROUP BY term), total AS (SELECT count(*) AS n FROM one)"""
_PASSAGES = r"""t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM (SELECT DISTINCT doc_id, text FROM documents)), p AS (SELECT item_id, regexp_extract_all(lower(prompt), '[\p{L}\p{N}]+') AS w FROM eval_items),
tr AS (SELECT doc_id, i, array_to_string(w[i:i + 11], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM t WHERE len(w) >= 12)), pr AS (SELECT item_id, array_to_string(w[i:i + 11], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM p WHERE len(w) >= 12))"""
SQL = {
    "p1_found": f"WITH {_LINES} SELECT doc_id, line_no FROM f JOIN g USING (host, form)",
    "p1_clean": f"""WITH {_LINES}, lost AS (SELECT doc_id, list(DISTINCT line_no) AS lost FROM f JOIN g USING (host, form) GROUP BY doc_id)
SELECT doc_id, CASE WHEN lost IS NULL THEN body ELSE array_to_string(list_filter(string_split(body, chr(10)), lambda x, i: NOT list_contains(lost, i - 1)), chr(10)) END AS clean_body, coalesce(len(lost), 0)::INT AS removed FROM docs LEFT JOIN lost USING (doc_id)""",
    "p1_hosts": f"WITH {_LINES} SELECT host, count(*) AS lines, count(DISTINCT form) AS distinct_lines, count(DISTINCT CASE WHEN g.form IS NOT NULL THEN f.form END) AS repeated FROM f LEFT JOIN g USING (host, form) WHERE f.form <> '' GROUP BY host",
    "p5_method": f"""WITH {_ONE}, {_WORDS}, n AS (SELECT a.doc_id, a.term, count(DISTINCT b.term) AS degree FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i - 3 AND a.i + 3 AND a.term <> b.term GROUP BY ALL),
x AS (SELECT doc_id, term, tf, coalesce(degree, 0)::INT AS degree, df, round(ln(1 + (total.n - df + 0.5) / (df + 0.5)), 6) AS idf FROM c JOIN df USING (term) LEFT JOIN n USING (doc_id, term), total) SELECT doc_id, term, tf, degree, df, idf, degree * idf AS weight FROM x""",
    "p5_found": f"WITH {_ONE}, {_WORDS}" + r" SELECT doc_id, term FROM c JOIN df USING (term) WHERE tf >= 3 AND df <= 4 AND regexp_matches(term, '\p{L}')",
    "p7_exact": "WITH s AS (SELECT lower(exact) AS h, min(doc_id) AS accepted FROM dedup_state WHERE exact IS NOT NULL GROUP BY 1) SELECT doc_id, min(accepted) AS accepted FROM docs JOIN s ON lower(content_hash) = h WHERE accepted < doc_id GROUP BY doc_id",
    "p8_found": f"WITH {_PASSAGES} SELECT DISTINCT doc_id, item_id FROM tr JOIN pr USING (run)",
    "p8_items": f"WITH {_PASSAGES}, x AS (SELECT doc_id, item_id, count(DISTINCT i) AS n FROM tr JOIN pr USING (run) GROUP BY ALL) SELECT item_id, count(*) AS documents, max(n) AS most_places FROM x GROUP BY item_id",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
