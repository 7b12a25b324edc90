"""Queries of the search engine, each over its whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textharbor.config import UNSTEMMED, Analysis, FieldAnalysis, Ranking
from textharbor.functions.analysis import STOP_WORDS, analyzed, normalize_text
from textharbor.functions.hashing import crc32, decode_deltas, encode_deltas, fnv1a_hex, hamming, shard_of, shingles, simhash, splitmix, varint_len
from textharbor.functions.text import escape_html, snippet
from textharbor.functions.urls import addresses_allowed, canonical_url, host_of, resolve_url
from textharbor.operators import authority, cluster, crawl, dedup, evaluate, rank, robots, spell
from textharbor.operators.index import IndexView, live, newest
from textharbor.operators.lineage import new_path, remove_at_end, shared_dir
from textharbor.plans import search
from textharbor.plans.query import MatchAll, parse
from textharbor.sources import segments
from textharbor.sources.files import query_ids
from textharbor.sources.html import extract_html
from textharbor.sources.pages import documents_from_pages
from textharbor.sources.store import stamp
from textharbor.streaming.ingest import append_generations, arrivals

DEFAULT = Analysis()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return newest(_table(spark, d, "docs"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """documents as rows of the document schema: body, and the first line as title."""
    t = _table(spark, d, "documents")
    none = F.array().cast("array<string>")
    return t.select("doc_id", F.split("text", "\n")[0].alias("title"), none.alias("headings"), F.col("text").alias("body"), none.alias("anchor_text"), "url")


def _view(spark: SparkSession, d: str, analysis: Analysis = UNSTEMMED) -> IndexView:
    """An index that is made of the documents as it is used."""
    return IndexView.of(_docs(spark, d), analysis)


_WRITTEN: dict[tuple, str] = {}


def _index_path(spark: SparkSession, d: str, analysis: Analysis = UNSTEMMED) -> str:
    """Folder of the written index of the live documents, written by the first query of a session that needs it, and again if the table changed or the folder was cleared."""
    key = spark.sparkContext.applicationId, repr(analysis), stamp(_table(spark, d, "docs").inputFiles())
    if key not in _WRITTEN or not segments.is_complete(_WRITTEN[key]):
        path = new_path(spark, "index")
        segments.write_index(_view(spark, d, analysis), path)
        remove_at_end(spark, path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def _stored(spark: SparkSession, d: str, analysis: Analysis = UNSTEMMED) -> IndexView:
    """The written index, as searches read it."""
    return segments.read_index(spark, _index_path(spark, d, analysis), analysis=analysis)


# --- the skeleton that the SQL shares: live documents, their fields' tokens, postings, lengths, statistics
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_LIVE = "d AS (SELECT * FROM docs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY seg DESC) = 1)"
_TOKENS = f"""{_LIVE},
f AS (SELECT doc_id, 0 AS field, coalesce(title, '') AS t FROM d UNION ALL SELECT doc_id, 1, coalesce(array_to_string(headings, chr(10)), '') FROM d
      UNION ALL SELECT doc_id, 2, coalesce(body, '') FROM d UNION ALL SELECT doc_id, 3, coalesce(array_to_string(anchor_text, chr(10)), '') FROM d),
w AS (SELECT doc_id, field, regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]+') AS ws FROM f),
raw AS (SELECT doc_id, field, lower(x) AS term, i - 1 AS position FROM (SELECT doc_id, field, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w)),
tok AS (SELECT * FROM raw WHERE term NOT IN ({_STOP})),
post AS (SELECT field, term, doc_id, count(*) AS tf, list(position ORDER BY position) AS positions FROM tok GROUP BY field, term, doc_id),
dl AS (SELECT w.doc_id, w.field, coalesce(c.n, 0) AS len FROM w LEFT JOIN (SELECT doc_id, field, count(*) AS n FROM tok GROUP BY ALL) c USING (doc_id, field)),
st AS (SELECT field, sum(len) AS total, count(*) AS n, sum(len)::DOUBLE / count(*) AS av FROM dl GROUP BY field)"""
_WEIGHT = "CASE field WHEN 0 THEN 4.0 WHEN 1 THEN 2.0 WHEN 2 THEN 1.0 ELSE 1.5 END"
_IDF = "ln(1 + (n - df + 0.5) / (df + 0.5))"
_BM25 = f"{_WEIGHT} * {_IDF} * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / greatest(av, 1e-9)))"
_TFIDF = f"{_WEIGHT} * {_IDF} * (1 + ln(tf))"


def _scored(terms: str, contrib: str = _BM25) -> str:
    """CTEs up to c: the contributions of the postings that a condition picks."""
    return f"""WITH {_TOKENS},
df AS (SELECT field, term, count(*) AS df FROM post WHERE {terms} GROUP BY ALL),
c AS (SELECT doc_id, field, term, tf, df, len, n, av, {contrib} AS contrib FROM post JOIN df USING (field, term) JOIN dl USING (doc_id, field) JOIN st USING (field))"""


def _matching(condition: str) -> str:
    """CTE m: documents whose postings fulfil a condition over bool_or."""
    return f"m AS (SELECT doc_id FROM post GROUP BY doc_id HAVING {condition})"


def _any(term: str, field: int | None = None) -> str:
    return f"coalesce(bool_or(term = '{term}'{'' if field is None else f' AND field = {field}'}), false)"


# --- analysis and index
@_query(
    f"SELECT doc_id, i - 1 AS position, regexp_replace(lower(x), '(.)σ$', '\\1ς') AS term FROM (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+') AS ws FROM documents WHERE text IS NOT NULL))"
)
def tokenize_positions(spark: SparkSession, d: str) -> DataFrame:
    terms = analyzed(F.col("body"), FieldAnalysis(stop_words=False, stemmer="none"))
    return _texts(spark, d).select("doc_id", F.explode(terms).alias("x")).select("doc_id", "x.position", "x.term")


@_query(f"WITH {_TOKENS} SELECT doc_id, position, term FROM tok WHERE field = 0")
def stopword_gaps(spark: SparkSession, d: str) -> DataFrame:
    terms = analyzed(F.col("title"), FieldAnalysis(stop_words=True, stemmer="none"))
    return _docs(spark, d).select("doc_id", F.explode(terms).alias("x")).select("doc_id", "x.position", "x.term")


@_query(f"WITH {_TOKENS} SELECT term, count(*) AS n FROM tok WHERE field = 2 AND length(term) >= 6 GROUP BY term")
def min_token_len(spark: SparkSession, d: str) -> DataFrame:
    terms = analyzed(F.col("body"), FieldAnalysis(stop_words=True, stemmer="none", min_token_len=6))
    return _docs(spark, d).select(F.explode(terms).alias("x")).groupBy(F.col("x.term").alias("term")).agg(F.count("*").alias("n"))


@_query(f"WITH {_TOKENS} SELECT field, term, doc_id, tf, positions[1] AS first_position, positions[-1] AS last_position FROM post")
def build_postings(spark: SparkSession, d: str) -> DataFrame:
    p = _view(spark, d).postings
    return p.select("field", "term", "doc_id", "tf", F.get("positions", F.lit(0)).alias("first_position"), F.element_at("positions", -1).alias("last_position"))


@_query("SELECT field, lower(term) AS term, doc_id, count(*) AS tf FROM (SELECT DISTINCT * FROM tokens WHERE term IS NOT NULL) GROUP BY field, lower(term), doc_id")
def postings_of_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d, "tokens").where("term IS NOT NULL").distinct()
    return t.groupBy("field", F.lower("term").alias("term"), "doc_id").agg(F.count("*").alias("tf"))


@_query(f"WITH {_TOKENS} SELECT field, term, count(*) AS df, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM post GROUP BY field, term")
def term_df(spark: SparkSession, d: str) -> DataFrame:
    return _view(spark, d).termstats()


@_query(f"WITH {_TOKENS} SELECT doc_id, field, len FROM dl")
def field_lengths(spark: SparkSession, d: str) -> DataFrame:
    return _view(spark, d).doclen


@_query(f"WITH {_TOKENS} SELECT field, total AS total_tokens, n AS n_docs, round(av, 6) AS avg_len FROM st")
def collection_stats(spark: SparkSession, d: str) -> DataFrame:
    return _view(spark, d).stats().withColumn("avg_len", F.round("avg_len", 6))


@_query(f"WITH {_TOKENS} SELECT count(*) AS postings, count(DISTINCT (field, term)) AS terms FROM post")
def vocab_size(spark: SparkSession, d: str) -> DataFrame:
    p = _view(spark, d).postings
    return p.groupBy("field", "term").agg(F.count("*").alias("n")).agg(F.sum("n").alias("postings"), F.count("*").alias("terms"))


@_query(f"WITH {_TOKENS} SELECT DISTINCT term FROM post WHERE field = 1")
def field_terms(spark: SparkSession, d: str) -> DataFrame:
    return _view(spark, d).vocabulary(1)


@_query("SELECT seg, field, count(*) AS entries, sum(doc_freq) AS postings, count(DISTINCT term) AS terms FROM (SELECT DISTINCT * FROM dict_entries) GROUP BY seg, field")
def segment_stats(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "dict_entries").distinct()
    return e.groupBy("seg", "field").agg(F.count("*").alias("entries"), F.sum("doc_freq").alias("postings"), F.countDistinct("term").alias("terms"))


@_query("SELECT term, sum(doc_freq) AS df, min(first_doc) AS first_doc, max(last_doc) AS last_doc FROM (SELECT DISTINCT * FROM dict_entries) WHERE term LIKE 'co%' GROUP BY term")
def dictionary_prefix(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "dict_entries").where(F.col("term").startswith("co")).distinct()
    return e.groupBy("term").agg(F.sum("doc_freq").alias("df"), F.min("first_doc").alias("first_doc"), F.max("last_doc").alias("last_doc"))


@_query(
    f"WITH {_TOKENS}, r AS (SELECT *, row_number() OVER (PARTITION BY field, term ORDER BY doc_id) - 1 AS i FROM post) SELECT field, term, i // 64 AS block, count(*) AS n, max(tf) AS max_tf, min(doc_id) AS first_doc FROM r GROUP BY ALL"
)
def posting_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _view(spark, d).blocks().groupBy("field", "term", "block").agg(F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("doc_id").alias("first_doc"))


@_query(
    f"WITH {_TOKENS} SELECT field, term, doc_id, list_transform(positions, lambda x, i: CASE WHEN i = 1 THEN x ELSE x - positions[i - 1] END)::VARCHAR AS deltas FROM post"
)
def position_deltas(spark: SparkSession, d: str) -> DataFrame:
    p = _view(spark, d).postings
    deltas = F.concat(F.lit("["), F.array_join(F.transform(encode_deltas(F.col("positions")), lambda x: x.cast("string")), ", "), F.lit("]"))
    return p.select("field", "term", "doc_id", deltas.alias("deltas"))


@_query("SELECT doc_id, ceil(length(CASE WHEN timestamp = 0 THEN '0' ELSE ltrim(bin(timestamp), '0') END) / 7.0)::INT AS bytes FROM (SELECT DISTINCT doc_id, timestamp FROM docs WHERE timestamp >= 0)")
def varint_lengths(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("timestamp >= 0").select("doc_id", varint_len(F.col("timestamp")).alias("bytes"))


# --- Boolean retrieval
def _bool(text: str, spark: SparkSession, d: str) -> DataFrame:
    return search.boolean(_stored(spark, d), parse(text, UNSTEMMED))


def _bool_sql(condition: str) -> str:
    return f"WITH {_TOKENS}, {_matching(condition)} SELECT doc_id FROM m"


_NOT = f"WITH {_TOKENS}, {_matching(_any('compiler'))} SELECT doc_id FROM d WHERE doc_id NOT IN (SELECT doc_id FROM m)"
for _name, _text, _sql in (
    ("bool_and", "compiler AND latency", _bool_sql(f"{_any('compiler')} AND {_any('latency')}")),
    ("bool_or", "compiler OR quorum", _bool_sql(f"{_any('compiler')} OR {_any('quorum')}")),
    ("bool_not", "NOT compiler", _NOT),
    ("bool_and_not", "compiler NOT latency", _bool_sql(f"{_any('compiler')} AND NOT {_any('latency')}")),
    ("bool_nested", "(compiler OR quorum) AND NOT (latency OR title:index) shard", _bool_sql(f"({_any('compiler')} OR {_any('quorum')}) AND NOT ({_any('latency')} OR {_any('index', 0)}) AND {_any('shard')}")),
    ("bool_stop_word", "the compiler", f"WITH {_LIVE} SELECT doc_id FROM d WHERE false"),
    ("field_scoped", "title:compiler heading:index", _bool_sql(f"{_any('compiler', 0)} AND {_any('index', 1)}")),
    ("anchor_scoped", "anchor:home OR anchor:here", _bool_sql(f"{_any('home', 3)} OR {_any('here', 3)}")),
    ("prefix_match", "body:comp*", _bool_sql("coalesce(bool_or(field = 2 AND starts_with(term, 'comp')), false)")),
    ("fuzzy_match", "heading:compilor~1 OR title:indax~2", _bool_sql("coalesce(bool_or((field = 1 AND levenshtein(regexp_replace(term, '[^\\x00-\\x7F]', '~', 'g'), 'compilor') <= 1) OR (field = 0 AND levenshtein(regexp_replace(term, '[^\\x00-\\x7F]', '~', 'g'), 'indax') <= 2)), false)")),
    ("site_filter", "site:invalid compiler", f"WITH {_TOKENS}, {_matching(_any('compiler'))} SELECT doc_id FROM d JOIN m USING (doc_id) WHERE contains(lower(url), 'invalid')"),
    ("site_only", "site:.test", f"WITH {_LIVE} SELECT doc_id FROM d WHERE contains(lower(url), '.test')"),
    ("or_not", "title:compiler OR NOT body:compiler", f"WITH {_TOKENS}, {_matching(_any('compiler', 0))}, b AS (SELECT DISTINCT doc_id FROM post WHERE term = 'compiler' AND field = 2) SELECT doc_id FROM d WHERE doc_id IN (SELECT doc_id FROM m) OR doc_id NOT IN (SELECT doc_id FROM b)"),
):
    QUERIES[_name] = lambda spark, d, text=_text: _bool(text, spark, d)
    SQL[_name] = _sql


@_query(f"WITH {_LIVE} SELECT doc_id FROM d")
def match_all(spark: SparkSession, d: str) -> DataFrame:
    return search.boolean(_stored(spark, d), MatchAll())


def _phrase_sql(words: list[str], field: int) -> str:
    joins = " ".join(f"JOIN tok t{i} ON t{i}.doc_id = t0.doc_id AND t{i}.field = t0.field AND t{i}.position = t0.position + {i} AND t{i}.term = '{w}'" for i, w in enumerate(words) if i)
    return f"WITH {_TOKENS} SELECT DISTINCT t0.doc_id FROM tok t0 {joins} WHERE t0.field = {field} AND t0.term = '{words[0]}'"


@_query(_phrase_sql(["nightly", "merge"], 2))
def phrase_match(spark: SparkSession, d: str) -> DataFrame:
    return _bool('"nightly merge"', spark, d)


@_query(_phrase_sql(["eastern", "shore"], 0))
def phrase_scoped(spark: SparkSession, d: str) -> DataFrame:
    return _bool('title:"eastern shore"', spark, d)


@_query(f"WITH {_LIVE} SELECT doc_id FROM d WHERE false")
def phrase_with_stop_word(spark: SparkSession, d: str) -> DataFrame:
    """A stop word inside leaves a gap, so the words around it are not adjacent."""
    return _bool('"end of week"', spark, d)


# --- ranking
_Q = "(quorum OR latency) NOT bytecode"
_Q_TERMS = "term IN ('quorum', 'latency', 'bytecode')"
_Q_MATCH = f"({_any('quorum')} OR {_any('latency')}) AND NOT {_any('bytecode')}"
_TOP = "ORDER BY score DESC, doc_id LIMIT 20"


def _top_sql(terms: str, match: str, contrib: str = _BM25, positive: str = "true") -> str:
    return f"{_scored(terms, contrib)}, {_matching(match)} SELECT doc_id, round(sum(contrib) FILTER ({positive}), 4) AS score FROM c JOIN m USING (doc_id) GROUP BY doc_id {_TOP}"


@_query(_top_sql(_Q_TERMS, _Q_MATCH, positive="term <> 'bytecode'"))
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return rank.top_k(_stored(spark, d), parse(_Q, UNSTEMMED), 20)


@_query(_top_sql(_Q_TERMS, _Q_MATCH, _TFIDF, "term <> 'bytecode'"))
def tfidf_topk(spark: SparkSession, d: str) -> DataFrame:
    return rank.top_k(_stored(spark, d), parse(_Q, UNSTEMMED), 20, Ranking(scoring="tfidf"))


@_query(_top_sql("(field = 0 AND term = 'index') OR (field = 2 AND term = 'index') OR (field = 3 AND term = 'home')", f"{_any('index', 0)} OR {_any('index', 2)} OR {_any('home', 3)}"))
def multi_field_bm25(spark: SparkSession, d: str) -> DataFrame:
    return rank.top_k(_stored(spark, d), parse("title:index OR body:index OR anchor:home", UNSTEMMED), 20)


@_query(_top_sql("field = 2 AND starts_with(term, 'comp')", "coalesce(bool_or(field = 2 AND starts_with(term, 'comp')), false)"))
def prefix_topk(spark: SparkSession, d: str) -> DataFrame:
    return rank.top_k(_stored(spark, d), parse("body:comp*", UNSTEMMED), 20)


@_query(
    f"{_scored(_Q_TERMS)}, {_matching(_Q_MATCH)}, b AS (SELECT doc_id, round(sum(contrib) FILTER (term <> 'bytecode'), 4) AS score FROM c JOIN m USING (doc_id) GROUP BY doc_id {_TOP}) SELECT doc_id, score, field, term, tf, df, round({_IDF}, 4) AS idf, len, round(av, 4) AS avg_len, round(contrib, 4) AS contrib FROM c JOIN b USING (doc_id) WHERE term <> 'bytecode'"
)
def explain_terms(spark: SparkSession, d: str) -> DataFrame:
    rows = rank.explained(_stored(spark, d), parse(_Q, UNSTEMMED), 20)
    return rows.withColumns({c: F.round(c, 4) for c in ("idf", "avg_len", "contrib")})


@_query(_top_sql(_Q_TERMS, _Q_MATCH, positive="term <> 'bytecode'"))
def block_max_topk(spark: SparkSession, d: str) -> DataFrame:
    return rank.pruned_top_k(_stored(spark, d), parse(_Q, UNSTEMMED), 20)[0]


_AUTHORITY = "CASE WHEN isfinite(coalesce(try_cast(metadata['authority'] AS FLOAT), 0)) AND coalesce(try_cast(metadata['authority'] AS FLOAT), 0) >= 0 THEN coalesce(try_cast(metadata['authority'] AS FLOAT), 0)::DOUBLE ELSE 0 END"
_FRESH = "CASE WHEN timestamp > 0 THEN pow(0.5, greatest((SELECT max(timestamp) FROM d) - timestamp, 0) / 86400.0 / 30) ELSE 0 END"


def _blend_sql(add: str) -> str:
    return f"{_scored(_Q_TERMS)}, {_matching(_Q_MATCH)}, b AS (SELECT doc_id, sum(contrib) FILTER (term <> 'bytecode') AS s FROM c JOIN m USING (doc_id) GROUP BY doc_id) SELECT doc_id, round(s + {add}, 4) AS score FROM b JOIN d USING (doc_id) {_TOP}"


@_query(_blend_sql(f"5 * ({_AUTHORITY})"))
def authority_blend(spark: SparkSession, d: str) -> DataFrame:
    return rank.top_k(_stored(spark, d), parse(_Q, UNSTEMMED), 20, Ranking(authority_weight=5))


@_query(_blend_sql(f"5 * ({_FRESH})"))
def freshness_topk(spark: SparkSession, d: str) -> DataFrame:
    return rank.top_k(_stored(spark, d), parse(_Q, UNSTEMMED), 20, Ranking(freshness_weight=5))


@_query(f"WITH {_TOKENS}, {_matching(_any('compiler'))} SELECT doc_id, 0.0 AS score FROM d WHERE doc_id NOT IN (SELECT doc_id FROM m) ORDER BY doc_id LIMIT 20")
def no_scoring_terms(spark: SparkSession, d: str) -> DataFrame:
    return rank.top_k(_stored(spark, d), parse("NOT compiler", UNSTEMMED), 20)


_BATCH = {"q1": ["compiler", "index"], "q2": ["quorum", "latency", "shard"], "q3": ["oven", "bread", "dough"], "q4": ["harbour"]}
_ASKED = " UNION ALL ".join(f"SELECT '{q}' AS query_id, '{t}' AS term" for q, ts in _BATCH.items() for t in ts)


@_query(
    f"{_scored('field = 2 AND term IN (' + ', '.join(repr(t) for ts in _BATCH.values() for t in ts) + ')')}, q AS ({_ASKED}), r AS (SELECT query_id, doc_id, round(sum(contrib), 4) AS score FROM c JOIN q USING (term) GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r QUALIFY rank <= 10"
)
def batch_topk(spark: SparkSession, d: str) -> DataFrame:
    return rank.many_top_k(_stored(spark, d), _BATCH, 10)


@_query()
def porter_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return rank.top_k(_stored(spark, d, DEFAULT), parse("indexes compilers OR latency", DEFAULT), 20)


@_query()
def porter_terms(spark: SparkSession, d: str) -> DataFrame:
    terms = analyzed(F.col("body"), FieldAnalysis())
    return _docs(spark, d).select(F.explode(terms).alias("x")).groupBy(F.col("x.term").alias("term")).agg(F.count("*").alias("n"))


@_query()
def snippets(spark: SparkSession, d: str) -> DataFrame:
    view = _stored(spark, d, DEFAULT)
    best = F.broadcast(rank.top_k(view, parse("compilers latency", DEFAULT), 20))  # 20 rows
    return view.docs.join(best, "doc_id").select("doc_id", "score", snippet(F.col("body"), F.col("title"), ["compil", "latenc"]).alias("snippet"))


@_query("SELECT doc_id, replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS title FROM (SELECT DISTINCT doc_id, title FROM docs)")
def escaped_titles(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", escape_html(F.col("title")).alias("title"))


# --- link authority
def _pagerank_sql(rounds: int, tables: str, select: str = "node, round(r / (SELECT max(r) FROM {last}), 6) AS authority FROM {last}") -> str:
    """tables: CTEs nodes(node) and e(src, dst)."""
    out = f"""WITH {tables}, deg AS MATERIALIZED (SELECT src, count(*) AS k FROM e GROUP BY src), n AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM nodes), r0 AS MATERIALIZED (SELECT node, 1.0 / n AS r FROM nodes, n)"""
    for i in range(1, rounds + 1):
        out += f""", l{i} AS MATERIALIZED (SELECT coalesce(sum(r), 0) AS s FROM r{i - 1} LEFT JOIN deg ON node = src WHERE src IS NULL),
g{i} AS MATERIALIZED (SELECT dst AS node, sum(r / k) AS g FROM e JOIN deg USING (src) JOIN r{i - 1} ON node = src GROUP BY dst),
r{i} AS MATERIALIZED (SELECT node, 0.15 / n + 0.85 * s / n + 0.85 * coalesce(g, 0) AS r FROM r{i - 1} LEFT JOIN g{i} USING (node), n, l{i})"""
    return f"{out} SELECT {select.format(last=f'r{rounds}')}"


_PARTS = """nodes AS MATERIALIZED (SELECT DISTINCT node FROM (SELECT 'p' || l_partkey AS node FROM lineitem UNION ALL SELECT 's' || l_suppkey FROM lineitem)),
e AS MATERIALIZED (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem)"""
_LINKED = "nodes AS MATERIALIZED (SELECT doc_id AS node FROM d), o AS (SELECT doc_id AS src, unnest(string_split(metadata['outlinks'], chr(10))) AS url FROM d WHERE metadata['outlinks'] IS NOT NULL), e AS MATERIALIZED (SELECT DISTINCT src, doc_id AS dst FROM o JOIN d USING (url) WHERE url <> '' AND src <> doc_id)"


@_query(_pagerank_sql(20, _PARTS))
def authority_pagerank(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d, "lineitem")
    e = t.select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).distinct()
    ranks = authority.pagerank(e.select(F.col("src").alias("node")).union(e.select("dst")), e)
    return ranks.withColumn("authority", F.round("authority", 6))


@_query(
    f"WITH {_LIVE}, o AS (SELECT doc_id AS src, unnest(string_split(metadata['outlinks'], chr(10))) AS url FROM d WHERE metadata['outlinks'] IS NOT NULL) SELECT DISTINCT src, doc_id AS dst FROM o JOIN d USING (url) WHERE url <> '' AND src <> doc_id"
)
def link_graph(spark: SparkSession, d: str) -> DataFrame:
    return authority.link_graph(_docs(spark, d))


@_query(_pagerank_sql(20, f"{_LIVE}, {_LINKED}", "node AS doc_id, printf('%.6f', r / (SELECT max(r) FROM {last})) AS authority FROM {last}"))
def docs_authority(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    ranks = authority.pagerank(docs.select(F.col("doc_id").alias("node")), authority.link_graph(docs))
    published = authority.with_authority(docs, ranks)
    return published.select("doc_id", F.col("metadata")["authority"].alias("authority"))


# --- completion and spelling
_PART = "v AS (SELECT w AS term, count(*) AS df FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part) WHERE w <> '' GROUP BY w)"


def _part_words(spark: SparkSession, d: str) -> DataFrame:
    words = _table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("term")).where("term <> ''")
    return words.groupBy("term").agg(F.count("*").alias("df"))


@_query(f"WITH {_PART} SELECT term, df FROM v WHERE starts_with(term, 's') ORDER BY df DESC, term LIMIT 8")
def complete_prefix(spark: SparkSession, d: str) -> DataFrame:
    return spell.complete(_part_words(spark, d), "s")


@_query(f"WITH {_TOKENS}, v AS (SELECT term, count(*) AS df FROM post WHERE field = 2 GROUP BY term) SELECT term, df, levenshtein(regexp_replace(term, '[^\\x00-\\x7F]', '~', 'g'), 'compilar') AS dist FROM v WHERE dist BETWEEN 1 AND 2 ORDER BY dist, df DESC, term LIMIT 5")
def suggest_spelling(spark: SparkSession, d: str) -> DataFrame:
    v = _stored(spark, d).termstats().where("field = 2").select("term", "df")
    return spell.suggest(v, "compilar")


# --- generations
@_query(f"WITH {_LIVE} SELECT seg, count(*) AS docs, max(doc_id) AS last_doc FROM d GROUP BY seg")
def shadow_newest(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).groupBy("seg").agg(F.count("*").alias("docs"), F.max("doc_id").alias("last_doc"))


@_query(
    "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"
)
def newest_event(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "events").withColumnRenamed("user_id", "doc_id")
    return newest(e, "event_id").select(F.col("doc_id").alias("user_id"), "event_id", "event_type")


@_query(f"WITH {_LIVE} SELECT doc_id FROM d WHERE doc_id NOT IN (SELECT doc_id FROM dedup_state WHERE simhash IS NULL)")
def tombstone_filter(spark: SparkSession, d: str) -> DataFrame:
    gone = _table(spark, d, "dedup_state").where("simhash IS NULL")
    return live(_table(spark, d, "docs"), gone).select("doc_id")


@_query(
    f"WITH {_LIVE} SELECT count(*) AS docs, sum(len(regexp_extract_all(coalesce(body, ''), '[\\p{{L}}\\p{{N}}]+'))) AS tokens FROM d WHERE doc_id NOT IN (SELECT doc_id FROM dedup_state WHERE simhash IS NULL)"
)
def merge_live(spark: SparkSession, d: str) -> DataFrame:
    gone = _table(spark, d, "dedup_state").where("simhash IS NULL")
    docs = live(_table(spark, d, "docs"), gone)
    view = IndexView.of(docs, Analysis(FieldAnalysis(stop_words=False, stemmer="none")))
    return view.doclen.where("field = 2").agg(F.count("*").alias("docs"), F.sum("len").alias("tokens"))


@_query("SELECT date_trunc('day', arrived_at) AS window_start, seg, count(*) AS docs FROM docs WHERE arrived_at IS NOT NULL GROUP BY ALL")
def stream_arrivals(spark: SparkSession, d: str) -> DataFrame:
    """The stream of deliveries, counted by day and batch, read to its end."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{d}/docs.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/docs.parque[t]")  # a pattern takes a file as well as a folder
    counted = arrivals(stream.where("arrived_at IS NOT NULL"), late="36500 days")
    query = counted.writeStream.format("memory").queryName(f"s{uuid.uuid4().hex}").outputMode("complete").option("checkpointLocation", base).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(query.name)


_MOD = "18446744073709551616::UHUGEINT"


def _bytes_sql(x: str) -> str:
    return f"list_transform(range(octet_length(encode({x}))::BIGINT), lambda i: ('0x' || substr(hex(encode({x})), 2 * i + 1, 2))::UHUGEINT)"


def _fnv_sql(x: str) -> str:
    """FNV-1a 64 of a text as 16 hex digits."""
    return f"lower(lpad(hex(list_reduce(list_prepend(14695981039346656037::UHUGEINT, {_bytes_sql(x)}), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT), 16, '0'))"


def _normal_sql(x: str) -> str:
    return rf"trim(regexp_replace(lower(coalesce({x}, '')), '\s+', ' ', 'g'))"


# --- web documents and duplicates
def _simhash_sql() -> str:
    """CTEs up to sims(doc_id, sim): SimHash-64 of the texts of t(doc_id, w), w being their words."""
    return f"""runs AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS s FROM t WHERE w <> ['']),
m0 AS (SELECT doc_id, (list_reduce(list_prepend(14695981039346656037::UHUGEINT, {_bytes_sql('s')}), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % {_MOD}) + 11400714819323198485::UHUGEINT) % {_MOD} AS z FROM runs),
m1 AS (SELECT doc_id, (xor(z, z >> 30) * 13787848793156543929::UHUGEINT) % {_MOD} AS z FROM m0), m2 AS (SELECT doc_id, (xor(z, z >> 27) * 10723151780598845931::UHUGEINT) % {_MOD} AS z FROM m1),
m3 AS (SELECT doc_id, xor(z, z >> 31)::UBIGINT AS z FROM m2), bits AS (SELECT doc_id, b, sum(CASE WHEN (z >> b) & 1 = 1 THEN 1 ELSE -1 END) > 0 AS up FROM m3, range(64) r(b) GROUP BY ALL),
sims AS (SELECT doc_id, sum(CASE WHEN up THEN CASE WHEN b = 63 THEN -9223372036854775808::HUGEINT ELSE (1::HUGEINT << b::INT) END ELSE 0 END)::BIGINT AS sim FROM bits GROUP BY doc_id)"""


_SIMHASH = f"{_LIVE}, t AS (SELECT doc_id, string_split({_normal_sql('body')}, ' ') AS w FROM d), {_simhash_sql()}"


@_query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL) GROUP BY t")
def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(normalize_text(F.col("text"))).alias("hash"))
    return t.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("hash")


@_query(
    f"""WITH RECURSIVE x AS (SELECT doc_id, {_normal_sql('text')} AS n FROM documents), k AS (SELECT n, min(doc_id) AS first FROM x GROUP BY n), t AS (SELECT first AS doc_id, string_split(n, ' ') AS w FROM k), {_simhash_sql()},
s AS MATERIALIZED (SELECT doc_id, sim FROM sims JOIN t USING (doc_id) WHERE len(w) >= 25), p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.doc_id < b.doc_id WHERE bit_count(xor(a.sim, b.sim)) <= 7),
n AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS i, coalesce(list_distinct(e), []) AS e FROM (SELECT a AS id FROM p UNION SELECT b FROM p) LEFT JOIN (SELECT b AS id, list(a) AS e FROM p GROUP BY b) USING (id)),
r AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL SELECT n.i, CASE WHEN list_has_any(kept, n.e) THEN kept ELSE list_append(kept, id) END FROM r JOIN n ON n.i = r.i + 1), f AS (SELECT kept FROM r ORDER BY i DESC LIMIT 1)
SELECT x.doc_id, CASE WHEN x.doc_id <> first THEN 'exact_duplicate' WHEN x.doc_id IN (SELECT id FROM n) AND NOT list_contains(kept, x.doc_id) THEN 'near_duplicate' ELSE 'unique' END AS outcome FROM x JOIN k USING (n), f"""
)
def near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.near(_texts(spark, d))


@_query(
    f"WITH {_SIMHASH}, s AS (SELECT doc_id, sim FROM sims JOIN t USING (doc_id) WHERE len(w) >= 25), g AS (SELECT sim, min(doc_id) AS doc_id FROM s GROUP BY sim) SELECT x.doc_id AS a, y.doc_id AS b, bit_count(xor(x.sim, y.sim))::INT AS dist FROM g x JOIN g y ON x.doc_id < y.doc_id WHERE bit_count(xor(x.sim, y.sim)) <= 7 UNION ALL SELECT g.doc_id, s.doc_id, 0 FROM s JOIN g USING (sim) WHERE s.doc_id <> g.doc_id"
)
def simhash_near_dups(spark: SparkSession, d: str) -> DataFrame:
    return dedup.near_pairs(dedup.fingerprints(_docs(spark, d)))


@_query(f"WITH {_LIVE}, t AS (SELECT doc_id, content_hash, {_normal_sql('body')} AS t FROM d), h AS (SELECT doc_id, content_hash, {_fnv_sql('t')} AS hash FROM t) SELECT doc_id, hash, hash = lower(content_hash) AS current FROM h")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Whether each document's hash is that of its body."""
    docs = _docs(spark, d)
    own = fnv1a_hex(normalize_text(F.coalesce("body", F.lit(""))))
    return docs.select("doc_id", own.alias("hash"), (own == F.lower("content_hash")).alias("current"))


@_query(f"WITH {_SIMHASH}, s AS (SELECT DISTINCT doc_id, simhash FROM dedup_state WHERE simhash IS NOT NULL) SELECT doc_id, bit_count(xor(simhash, coalesce(sim, 0)))::INT AS dist FROM s JOIN d USING (doc_id) LEFT JOIN sims USING (doc_id)")
def accepted_simhashes(spark: SparkSession, d: str) -> DataFrame:
    """Distance of each accepted signature from the one computed of the text."""
    docs = _docs(spark, d).select("doc_id", simhash(normalize_text(F.coalesce("body", F.lit("")))).alias("own"))
    state = _table(spark, d, "dedup_state").where("simhash IS NOT NULL").dropDuplicates(["doc_id"])
    return state.join(docs, "doc_id").select("doc_id", hamming(F.col("simhash"), F.col("own")).alias("dist"))


_STATE_PAIRS = """s AS (SELECT DISTINCT doc_id, simhash FROM dedup_state WHERE simhash IS NOT NULL), g AS (SELECT simhash, min(doc_id) AS doc_id FROM s GROUP BY simhash),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, bit_count(xor(x.simhash, y.simhash))::INT AS dist FROM g x JOIN g y ON x.doc_id < y.doc_id WHERE bit_count(xor(x.simhash, y.simhash)) <= 7)"""


def _state(spark: SparkSession, d: str) -> DataFrame:
    s = _table(spark, d, "dedup_state").where("simhash IS NOT NULL").select("doc_id", "simhash").distinct()
    return s.select("doc_id", F.col("simhash").alias("sim"), F.lit(dedup.MIN_WORDS).alias("words"))


@_query(f"WITH {_STATE_PAIRS} SELECT a, b, dist FROM p UNION ALL SELECT g.doc_id, s.doc_id, 0 FROM s JOIN g USING (simhash) WHERE s.doc_id <> g.doc_id")
def state_near_dups(spark: SparkSession, d: str) -> DataFrame:
    """Near pairs of the accepted signatures."""
    return dedup.near_pairs(_state(spark, d))


@_query(f"WITH {_STATE_PAIRS}, l AS (SELECT x AS doc_id, count(*) AS links FROM (SELECT a AS x FROM p UNION ALL SELECT b FROM p) GROUP BY x) SELECT s.doc_id, g.doc_id AS representative, coalesce(links, 0) AS links FROM s JOIN g USING (simhash) LEFT JOIN l ON l.doc_id = g.doc_id")
def state_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every accepted signature's class and its number of links."""
    return dedup.classes(_state(spark, d))


@_query("SELECT doc_id, bit_count(xor(simhash, 0)) AS bits FROM (SELECT DISTINCT doc_id, simhash FROM dedup_state WHERE simhash IS NOT NULL)")
def simhash_bits(spark: SparkSession, d: str) -> DataFrame:
    s = _table(spark, d, "dedup_state").where("simhash IS NOT NULL").select("doc_id", "simhash").distinct()
    return s.select("doc_id", hamming(F.col("simhash"), F.lit(0).cast("bigint")).alias("bits"))


@_query("SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host, count(*) AS n FROM docs WHERE regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)') GROUP BY 1")
def url_host(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "docs").select(host_of(F.col("url")).alias("host")).where("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("n"))


def _canonical_sql(x: str) -> str:
    """Canonical form in SQL of addresses without user and dot segments."""
    url = rf"regexp_extract(trim({x}), '^([A-Za-z]+)://([^/?#]+)([^?#]*)(\?[^#]*)?', ['scheme', 'host', 'path', 'query'])"
    host = rf"regexp_replace(lower(({url}).host), CASE lower(({url}).scheme) WHEN 'http' THEN ':80$' WHEN 'https' THEN ':443$' ELSE '^$' END, '')"
    return f"CASE WHEN lower(({url}).scheme) IN ('http', 'https') AND ({url}).host <> '' THEN lower(({url}).scheme) || '://' || {host} || CASE WHEN ({url}).path = '' THEN '/' ELSE ({url}).path END || ({url}).query END"


@_query(f"SELECT {_canonical_sql('url')} AS url, count(*) AS n FROM docs GROUP BY 1")
def url_canonicalize(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "docs").select(canonical_url("url").alias("url")).groupBy("url").agg(F.count("*").alias("n"))


_PAGE_BODY = "coalesce(body, '') || CASE WHEN len(coalesce(image_alts, [])) > 0 THEN chr(10) || chr(10) || array_to_string(image_alts, chr(10)) ELSE '' END"


@_query(
    f"WITH p AS (SELECT page_id, any_value(url) AS url, any_value(title) AS title, any_value(headings) AS headings, any_value(body) AS body, any_value(links) AS links, any_value(image_alts) AS image_alts FROM extracted GROUP BY page_id), x AS (SELECT *, {_normal_sql(f'concat(title, chr(10), array_to_string(headings, chr(10)), chr(10), {_PAGE_BODY})')} AS t, coalesce(url, '') AS u FROM p) SELECT {_fnv_sql('u')} AS id_hex, url, coalesce(nullif(trim(title), ''), url) AS title, least(len(list_filter(coalesce(links, []), lambda x: trim(x.anchor) <> '')), 16)::INT AS anchors, {_fnv_sql('t')} AS content_hash FROM x"
)
def pages_to_docs(spark: SparkSession, d: str) -> DataFrame:
    pages = _table(spark, d, "extracted").dropDuplicates(["page_id"])
    docs = documents_from_pages(pages)
    return docs.select("id_hex", "url", "title", F.size("anchor_text").alias("anchors"), "content_hash")


def _web(spark: SparkSession, d: str) -> DataFrame:
    p = _table(spark, d, "extracted").where("url IS NOT NULL")
    return p.select("url", "content_type", F.transform(F.coalesce("links", F.array().cast("array<struct<url:string,anchor:string>>")), lambda x: x["url"]).alias("links"))


_WEB = f"w AS (SELECT {_canonical_sql('url')} AS url, any_value(content_type) AS content_type, any_value(links) AS links FROM extracted GROUP BY 1 HAVING url IS NOT NULL)"
_URL_HOST = "lower(regexp_extract(url, '^[^:]+://([^/:]+)', 1))"


@_query(
    f"""WITH {_WEB}, f AS (SELECT * FROM w WHERE starts_with(lower(coalesce(content_type, '')), 'text/html')), l AS (SELECT DISTINCT {_canonical_sql('x.url')} AS url FROM (SELECT unnest(links) AS x FROM f)),
o AS (SELECT 'fetched' AS outcome, url FROM f UNION ALL SELECT CASE WHEN content_type IS NULL THEN 'missing' ELSE 'not_html' END, url FROM w WHERE url NOT IN (SELECT url FROM f)
UNION ALL SELECT 'missing', url FROM l WHERE url IS NOT NULL AND url NOT IN (SELECT url FROM w) AND {_URL_HOST} IN (SELECT {_URL_HOST} FROM w)) SELECT outcome, count(*) AS n FROM o GROUP BY outcome"""
)
def crawl_rounds(spark: SparkSession, d: str) -> DataFrame:
    web = _web(spark, d)
    return crawl.crawl(web.select("url"), web)[1]


@_query(f"WITH {_WEB} SELECT url, {_URL_HOST} AS host, row_number() OVER (PARTITION BY {_URL_HOST} ORDER BY url)::INT AS turn FROM w")
def frontier_order(spark: SparkSession, d: str) -> DataFrame:
    return crawl.pop_order(crawl.seeds(_web(spark, d).select("url"))).select("url", "host", "turn")


# --- more of the index: dictionary, bounds, pruning, checks
_BLOCKS = """ids AS (SELECT CASE WHEN x <= 0 THEN 0 ELSE floor(log2(x))::INT + 1 END AS shift FROM (SELECT (max(doc_id) - min(doc_id) + 1) * 64 // count(*) - 1 AS x FROM d)),
b AS (SELECT field, term, doc_id >> shift AS block, count(*) AS n, max(tf) AS max_tf, min(len) AS min_len FROM post JOIN dl USING (doc_id, field), ids GROUP BY ALL)"""


@_query(
    f"WITH {_TOKENS}, {_BLOCKS}, t AS (SELECT 'postings' AS name, count(*) AS rows FROM post UNION ALL SELECT 'dictionary', count(DISTINCT (field, term)) FROM post UNION ALL SELECT 'blocks', count(*) FROM b UNION ALL SELECT 'doclen', count(*) FROM dl) SELECT name AS part, rows, rows AS expected, true AS sound FROM t"
)
def index_verify(spark: SparkSession, d: str) -> DataFrame:
    """The written index, read as a whole and compared with the row counts and check sums that were kept."""
    return segments.verify_index(spark, _index_path(spark, d)).withColumnRenamed("table", "part")


@_query(f"WITH {_TOKENS}, {_BLOCKS}, df AS (SELECT field, term, count(*) AS df FROM post GROUP BY ALL) SELECT field, term, block, n, max_tf, min_len, df FROM b JOIN df USING (field, term)")
def block_bounds(spark: SparkSession, d: str) -> DataFrame:
    return _stored(spark, d).bounds()


@_query(f"WITH {_TOKENS} SELECT field, term, count(*) AS df, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM post WHERE term IN ('quorum', 'latency', 'harbour', 'nosuchterm') GROUP BY field, term")
def dictionary_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Entries of exact terms: a pruned scan of the written dictionary."""
    return _stored(spark, d).termstats().where(F.col("term").isin("quorum", "latency", "harbour", "nosuchterm"))


_TOP_BOUND = f"{_WEIGHT} * ln(1 + (st.n - df + 0.5) / (df + 0.5)) * max_tf * 2.2 / (max_tf + 1.2 * (0.25 + 0.75 * min_len / greatest(av, 1e-9)))"
_BOUNDS = f"""{_BLOCKS}, df2 AS (SELECT field, term, count(*) AS df FROM post WHERE term IN ('quorum', 'latency') GROUP BY ALL),
x AS (SELECT field, term, block, b.n AS postings, {_TOP_BOUND} AS top FROM b JOIN df2 USING (field, term) JOIN st USING (field))"""


@_query(f"WITH {_TOKENS}, {_BOUNDS} SELECT field, term, count(*) AS blocks, sum(postings)::BIGINT AS postings, round(max(top), 4) AS top FROM x GROUP BY field, term")
def term_maxima(spark: SparkSession, d: str) -> DataFrame:
    return rank.term_maxima(_stored(spark, d), parse("quorum OR latency", UNSTEMMED)).withColumn("top", F.round("top", 4))


def _work_sql(k: int) -> str:
    return f"""{_scored(_Q_TERMS)}, {_matching(_Q_MATCH)}, {_BOUNDS}, bl AS (SELECT block, sum(top) AS bound, sum(postings)::BIGINT AS postings FROM x GROUP BY block),
fb AS (SELECT block FROM bl ORDER BY bound DESC, block LIMIT {k}), sc AS (SELECT doc_id, sum(contrib) FILTER (term <> 'bytecode') AS score FROM c JOIN m USING (doc_id) GROUP BY doc_id),
th AS (SELECT CASE WHEN count(*) < {k} THEN -1e300 ELSE min(score) END AS low FROM (SELECT score FROM sc, ids WHERE doc_id >> shift IN (SELECT block FROM fb) ORDER BY score DESC LIMIT {k}))
SELECT count(*) AS blocks, count(*) FILTER (bound + 1e-6 >= low) AS blocks_scored, count(*) FILTER (bound + 1e-6 < low) AS blocks_skipped, sum(postings)::BIGINT AS postings, coalesce(sum(postings) FILTER (bound + 1e-6 >= low), 0)::BIGINT AS postings_scored FROM bl, th"""


@_query(_work_sql(3))
def pruning_work(spark: SparkSession, d: str) -> DataFrame:
    """Blocks and postings that the three best documents take, and those that are never read."""
    return rank.pruned_top_k(_stored(spark, d), parse(_Q, UNSTEMMED), 3)[1]


@_query(_blend_sql(f"5 * ({_AUTHORITY})"))
def pruned_authority_topk(spark: SparkSession, d: str) -> DataFrame:
    return rank.pruned_top_k(_stored(spark, d), parse(_Q, UNSTEMMED), 20, Ranking(authority_weight=5))[0]


@_query(_top_sql("term IN ('compiler', 'latency')", f"{_any('compiler')} AND {_any('latency')}"))
def pruned_and_topk(spark: SparkSession, d: str) -> DataFrame:
    return rank.pruned_top_k(_stored(spark, d), parse("compiler AND latency", UNSTEMMED), 20)[0]


@_query(
    f"{_scored(_Q_TERMS)}, {_matching(_Q_MATCH)}, p AS (SELECT doc_id, field, sum(contrib) AS s FROM c JOIN m USING (doc_id) WHERE term <> 'bytecode' GROUP BY ALL), a AS (SELECT doc_id, 5 * ({_AUTHORITY}) AS authority, 5 * ({_FRESH}) AS fresh FROM d), b AS (SELECT doc_id, round(sum(s) + any_value(authority) + any_value(fresh), 4) AS score FROM p JOIN a USING (doc_id) GROUP BY doc_id {_TOP}) SELECT doc_id, score, field, round(s, 4) AS field_score, round(authority, 4) AS authority, round(fresh, 4) AS freshness FROM b JOIN p USING (doc_id) JOIN a USING (doc_id)"
)
def explain_fields(spark: SparkSession, d: str) -> DataFrame:
    """What each field and each blend adds to the best documents' scores."""
    rows = rank.field_scores(_stored(spark, d), parse(_Q, UNSTEMMED), 20, Ranking(authority_weight=5, freshness_weight=5))
    return rows.withColumns({c: F.round(c, 4) for c in ("field_score", "authority", "freshness")})


@_query(f"WITH {_TOKENS} SELECT field, term, doc_id, positions::VARCHAR AS positions FROM post")
def position_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Positions after coding as differences and decoding."""
    back = decode_deltas(encode_deltas(F.transform("positions", lambda x: x.cast("bigint"))))
    text = F.concat(F.lit("["), F.array_join(back.cast("array<string>"), ", "), F.lit("]"))
    return _stored(spark, d).postings.select("field", "term", "doc_id", text.alias("positions"))


# --- hashes
_CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t"


@_query(
    f"WITH tab AS ({_CRC_TABLE}), w AS (SELECT DISTINCT term FROM dict_entries WHERE term IS NOT NULL), b AS (SELECT term, list_transform(range(octet_length(encode(term))::BIGINT), lambda i: ('0x' || substr(hex(encode(term)), 2 * i + 1, 2))::BIGINT) AS b FROM w) SELECT term, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS crc FROM b, tab"
)
def crc32_terms(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "dict_entries").where("term IS NOT NULL").select("term").distinct().select("term", crc32(F.col("term")).alias("crc"))


@_query(
    f"WITH a AS (SELECT DISTINCT doc_id, (doc_id::UHUGEINT + 11400714819323198485::UHUGEINT) % {_MOD} AS z FROM docs), b AS (SELECT doc_id, (xor(z, z >> 30) * 13787848793156543929::UHUGEINT) % {_MOD} AS z FROM a), c AS (SELECT doc_id, (xor(z, z >> 27) * 10723151780598845931::UHUGEINT) % {_MOD} AS z FROM b) SELECT doc_id, lpad(hex(xor(z, z >> 31)::UBIGINT), 16, '0') AS mixed FROM c"
)
def mixed_ids(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "docs").select("doc_id").distinct().select("doc_id", F.lpad(F.hex(splitmix("doc_id")), 16, "0").alias("mixed"))


@_query(
    f"WITH {_LIVE}, t AS (SELECT doc_id, string_split({_normal_sql('body')}, ' ') AS w FROM d), r AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM t WHERE len(w) >= 5) SELECT doc_id, count(DISTINCT s) AS shingles FROM r GROUP BY doc_id"
)
def shingle_counts(spark: SparkSession, d: str) -> DataFrame:
    """Different runs of five words of every body."""
    runs = F.array_distinct(shingles(F.split(normalize_text(F.coalesce("body", F.lit(""))), " ")))
    return _docs(spark, d).select("doc_id", F.size(runs).cast("bigint").alias("shingles")).where("shingles > 0")


# --- web: extraction, robots, addresses
_BLANKS = r"[\s\x{85}\x{a0}\x{2000}-\x{200a}\x{3000}]+"


@_query(
    f"SELECT DISTINCT page_id, trim(regexp_replace(coalesce(title, ''), '{_BLANKS}', ' ', 'g')) AS title, len(list_filter(coalesce(headings, []), lambda h: trim(h) <> ''))::INT AS headings, len(coalesce(links, []))::INT AS links, nullif(trim(coalesce(description, '')), '') AS description FROM extracted"
)
def html_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields read from pages that are put together from the extracted ones: what the extractor took must come out again."""
    p = _table(spark, d, "extracted").dropDuplicates(["page_id"])
    none = F.array().cast("array<struct<url:string,anchor:string>>")
    heads = F.array_join(F.transform(F.coalesce("headings", F.array().cast("array<string>")), lambda h: F.concat(F.lit("<h2>"), escape_html(h), F.lit("</h2>"))), "")
    links = F.array_join(F.transform(F.coalesce("links", none), lambda x: F.concat(F.lit('<a href="'), escape_html(x["url"]), F.lit('">'), escape_html(F.coalesce(x["anchor"], F.lit(""))), F.lit("</a>"))), "")
    page = F.concat(
        F.lit("<html><head><title>"), escape_html(F.coalesce("title", F.lit(""))), F.lit('</title><meta property="og:description" content="'), escape_html(F.coalesce("description", F.lit(""))),
        F.lit('"></head><body><nav>Menu</nav>'), heads, F.lit("<p>"), escape_html(F.coalesce("body", F.lit(""))), F.lit("</p>"), links, F.lit("</body></html>"),
    )
    got = p.select("page_id", extract_html(F.lit("http://page.test/"), page).alias("x"))
    return got.select("page_id", "x.title", F.size("x.headings").alias("headings"), F.size("x.links").alias("links"), "x.description")


_ROBOTS = "User-agent: *\nDisallow: /guide\nAllow: /guide/t\nDisallow: /*-1$\nCrawl-delay: 2\n"


@_query(
    f"WITH {_WEB}, p AS (SELECT url, {_URL_HOST} AS host, regexp_extract(url, '^[^:]+://[^/]+(/.*)$', 1) AS path FROM w) SELECT url, CASE WHEN starts_with(path, '/guide/t') THEN true WHEN starts_with(path, '/guide') OR regexp_matches(path, '^/.*-1$') THEN false ELSE true END AS allowed, 2000.0::DOUBLE AS delay_ms FROM p"
)
def robots_rules(spark: SparkSession, d: str) -> DataFrame:
    """Which pages one set of rules lets a crawler fetch: the longest rule decides."""
    asked = _web(spark, d).select(canonical_url("url").alias("url")).where("url IS NOT NULL").distinct()
    asked = asked.select("url", host_of(F.col("url")).alias("host"), F.regexp_extract("url", r"^[^:]+://[^/]+(/.*)$", 1).alias("path"))
    rules = asked.select("host").distinct().withColumn("body", F.lit(_ROBOTS))
    return robots.allowed(asked, rules, "textharbor").select("url", "allowed", "delay_ms")


@_query(
    "WITH a AS (SELECT event_id, event_id % 224 AS a, (event_id // 7) % 256 AS b, (event_id // 3) % 256 AS c, event_id % 251 AS d FROM events) SELECT event_id, NOT (a IN (0, 10, 127) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 192 AND b = 0 AND c IN (0, 2) AND NOT (c = 0 AND d IN (9, 10))) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113)) AS allowed FROM a"
)
def address_filter(spark: SparkSession, d: str) -> DataFrame:
    """Which addresses a fetcher may reach; addresses are made of event numbers."""
    e = F.col("event_id")
    address = F.concat_ws(".", e % 224, F.floor(e / 7) % 256, F.floor(e / 3) % 256, e % 251)
    return _table(spark, d, "events").select("event_id", addresses_allowed(address).alias("allowed"))


@_query(f"WITH {_WEB}, l AS (SELECT DISTINCT {_canonical_sql('x.url')} AS url FROM (SELECT unnest(links) AS x FROM w)) SELECT url, {_URL_HOST} AS host, 40 AS priority, 1 AS depth FROM l WHERE url IS NOT NULL AND {_URL_HOST} IN (SELECT {_URL_HOST} FROM w)")
def queued_links(spark: SparkSession, d: str) -> DataFrame:
    """Frontier rows of all pages' links: canonical, within the seeds' hosts."""
    web = _web(spark, d)
    hosts = crawl.seeds(web.select("url")).select("host").distinct()
    return crawl.queue_links(web.select("url", "links", F.lit(0).alias("depth")), hosts).select("url", "host", "priority", "depth")


@_query(f"WITH {_WEB}, p AS (SELECT url, {_URL_HOST} AS host FROM w), t AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY url) - 1 AS t FROM p) SELECT url, (t * CASE WHEN length(host) % 2 = 0 THEN 1500 ELSE 1000 END)::BIGINT AS start_ms FROM t")
def polite_starts(spark: SparkSession, d: str) -> DataFrame:
    """When each page is fetched if hosts ask for 1.5 or half a second between fetches and the settings for one."""
    rows = crawl.seeds(_web(spark, d).select("url"))
    delays = rows.select("host").distinct().withColumn("delay_ms", F.when(F.length("host") % 2 == 0, 1500.0).otherwise(500.0))
    return crawl.polite(rows, delays).select("url", "start_ms")


@_query(f"WITH {_WEB} SELECT url, (100 + 2000 * pow(2, length(url) % 5))::BIGINT AS next_eligible_ms, (length(url) % 5 + 1)::INT AS retries FROM w WHERE length(url) % 5 < 3")
def retry_times(spark: SparkSession, d: str) -> DataFrame:
    """Failed rows put back: waits double with every retry, and rows out of retries are gone."""
    failed = crawl.seeds(_web(spark, d).select("url")).withColumn("retries", (F.length("url") % 5).cast("int"))
    return crawl.retry_later(failed, 100).select("url", "next_eligible_ms", "retries")


# --- settings, limits, streams
@_query(
    f"WITH {_LIVE}, f AS (SELECT doc_id, 0 AS field, coalesce(title, '') AS t FROM d UNION ALL SELECT doc_id, 2, coalesce(body, '') FROM d), r AS (SELECT doc_id, field, lower(unnest(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]+'))) AS term FROM f), k AS (SELECT * FROM r WHERE (field = 0 AND length(term) >= 4) OR (field = 2 AND term NOT IN ({_STOP}))) SELECT field, count(DISTINCT term) AS terms, count(*) AS tokens FROM k GROUP BY field"
)
def per_field_analysis(spark: SparkSession, d: str) -> DataFrame:
    """Titles keep stop words but no words under four letters, bodies the reverse."""
    analysis = Analysis(UNSTEMMED.base, {0: {"stop_words": False, "min_token_len": 4}})
    p = IndexView.of(_docs(spark, d), analysis).postings.where("field IN (0, 2)")
    return p.groupBy("field").agg(F.countDistinct("term").alias("terms"), F.sum("tf").alias("tokens"))


@_query("SELECT * FROM (VALUES ('Term', 'compiler', false), ('Phrase', 'nightly merge', false), ('Prefix', 'comp', true), ('Fuzzy', 'index', true), ('Site', '.test', false)) t(kind, words, negated)")
def query_leaves(spark: SparkSession, d: str) -> DataFrame:
    """The leaves of a query's tree and whether a NOT stands above them."""
    query = parse('body:compiler OR body:"nightly merge" NOT (body:comp* body:index~1) site:.test', UNSTEMMED)
    word = lambda q: " ".join(getattr(q, "terms", ())) or next(getattr(q, n) for n in ("term", "prefix", "needle") if hasattr(q, n))
    return spark.createDataFrame([(type(q).__name__, word(q), negated) for q, negated in query.leaves()], "kind string, words string, negated boolean").distinct()


@_query("SELECT i::INT AS asked, least(greatest(i, 1), 100)::INT AS hits, least(greatest(i, 1), 50)::INT AS completions FROM range(-5, 300) r(i)")
def limit_clamps(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(i, spell.clamp(i, 100), spell.clamp(i, 50)) for i in range(-5, 300)], "asked int, hits int, completions int")


@_query("SELECT doc_id, title FROM docs WHERE arrived_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY arrived_at DESC) = 1")
def stream_generations(spark: SparkSession, d: str) -> DataFrame:
    """The stream of deliveries as generations of an index, read to its end; what is live then."""
    base = new_path(spark, "generations")
    stream = spark.readStream.schema(_table(spark, d, "docs").schema).parquet(f"{d}/docs.parque[t]")
    append_generations(stream.where("arrived_at IS NOT NULL"), f"{base}/index", f"{base}/checkpoint").awaitTermination()
    remove_at_end(spark, base)
    return segments.read_live(spark, f"{base}/index").select("doc_id", "title")


@_query(f"WITH {_LIVE}, t AS (SELECT doc_id, {_normal_sql('body')} AS t FROM d), h AS (SELECT doc_id, {_fnv_sql('t')} AS hash FROM t) SELECT min(doc_id) AS doc_id, hash FROM h WHERE hash NOT IN (SELECT lower(exact) FROM dedup_state WHERE exact IS NOT NULL) GROUP BY hash")
def fresh_documents(spark: SparkSession, d: str) -> DataFrame:
    """The first document of each text that was not accepted before."""
    known = _table(spark, d, "dedup_state").where("exact IS NOT NULL").select(F.lower("exact").alias("hash")).distinct()
    return dedup.exact(dedup.fingerprints(_docs(spark, d)), known).select("doc_id", "hash")


@_query(
    f"WITH {_WEB}, b AS (SELECT url, regexp_replace(url, '[?].*$', '') AS page FROM w), r AS (SELECT url, '/about' AS href, regexp_extract(page, '^([a-z]+://[^/]+)', 1) || '/about' AS target FROM b UNION ALL SELECT url, 'next?p=2', regexp_replace(page, '[^/]*$', '') || 'next?p=2' FROM b UNION ALL SELECT url, '#top', NULL FROM b UNION ALL SELECT url, 'HTTP://Far.TEST:80#x', 'http://far.test/' FROM b) SELECT * FROM r"
)
def resolved_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of several forms on every page, resolved."""
    pages = _web(spark, d).select(canonical_url("url").alias("url")).where("url IS NOT NULL").distinct()
    each = pages.select("url", F.explode(F.array(*[F.lit(h) for h in ("/about", "next?p=2", "#top", "HTTP://Far.TEST:80#x")])).alias("href"))
    return each.select("url", "href", resolve_url("url", "href").alias("target"))


# --- shards
def _shard_sql(shards: int) -> str:
    h = "14695981039346656037::UHUGEINT"
    for i in range(8):
        h = f"((xor(({h}), ((doc_id >> {8 * i}) & 255)::UHUGEINT) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"
    return f"WITH {_LIVE}, s AS (SELECT doc_id, ({h} % {shards})::INT AS shard FROM d) SELECT shard, count(*) AS docs FROM s GROUP BY shard"


@_query(_shard_sql(4))
def shard_balance(spark: SparkSession, d: str) -> DataFrame:
    return cluster.status(_docs(spark, d), 4)


@_query(_top_sql(_Q_TERMS, _Q_MATCH, positive="term <> 'bytecode'").replace("SELECT doc_id, round(", "SELECT doc_id, false AS partial, round("))
def sharded_topk(spark: SparkSession, d: str) -> DataFrame:
    return cluster.sharded_top_k(_stored(spark, d), parse(_Q, UNSTEMMED), 20, 4, cluster.layout(spark, 4, 2))


_SHARD = _shard_sql(4).removeprefix("WITH ").partition(" SELECT shard, count")[0]


@_query("SELECT s::INT AS shard, c::INT AS copy, 'node-' || (s + c) % 3 AS node FROM range(6) a(s), range(3) b(c)")
def shard_layout(spark: SparkSession, d: str) -> DataFrame:
    return cluster.layout(spark, 6, 3).select("shard", "copy", "node")


@_query("SELECT s::INT AS shard, CASE s % 3 WHEN 0 THEN 'node-0' ELSE 'node-2' END AS node FROM range(6) a(s)")
def shard_failover(spark: SparkSession, d: str) -> DataFrame:
    """The copies that answer when one node's copies do not open."""
    copies = cluster.layout(spark, 6, 3)
    return cluster.failover(copies, copies.where("node = 'node-1'").select("shard", "node"))[0]


@_query("SELECT s::INT AS shard, 2::BIGINT AS copies, CASE WHEN s % 2 = 1 THEN 1 ELSE 2 END::BIGINT AS servable, 0::BIGINT AS oldest, CASE WHEN s = 0 THEN 7 ELSE 0 END::BIGINT AS newest FROM range(4) a(s)")
def cluster_report(spark: SparkSession, d: str) -> DataFrame:
    """Copies by shard after one reported a new generation and those of odd shards on one node fell silent."""
    copies = cluster.layout(spark, 4, 2)
    for shard in range(4):
        for node in ("node-0", "node-1"):
            at = 10_000 if shard % 2 == 0 or node == "node-0" else 1000
            copies = cluster.heartbeat(copies, shard, node, 7 if (shard, node) == (0, "node-1") else 0, True, at)
    return cluster.report(cluster.silent(copies, 11_000, 5000))


@_query("SELECT node, count(*) AS copies, max(generation)::BIGINT AS newest FROM (SELECT CASE WHEN s = 2 AND (s + c) % 2 = 0 THEN 'node-9' ELSE 'node-' || (s + c) % 2 END AS node, CASE WHEN s = 2 AND (s + c) % 2 = 0 THEN 1 ELSE 0 END AS generation FROM range(4) a(s), range(2) b(c)) GROUP BY node")
def shard_move(spark: SparkSession, d: str) -> DataFrame:
    """Copies by node after one copy moved to a new node."""
    return cluster.report(cluster.move(cluster.layout(spark, 4, 2), 2, "node-0", "node-9"), "node").select("node", "copies", "newest")


@_query(
    f"{_scored(_Q_TERMS)}, {_matching(_Q_MATCH)}, {_SHARD.replace(_LIVE + ', ', '')} SELECT doc_id, true AS partial, round(sum(contrib) FILTER (term <> 'bytecode'), 4) AS score FROM c JOIN m USING (doc_id) JOIN s USING (doc_id) WHERE shard <> 1 GROUP BY doc_id {_TOP}"
)
def sharded_partial_topk(spark: SparkSession, d: str) -> DataFrame:
    """The answer while one shard has no copy in service."""
    copies = cluster.layout(spark, 4, 1).withColumn("health", F.when(F.col("shard") == 1, "offline").otherwise("healthy"))
    return cluster.sharded_top_k(_stored(spark, d), parse(_Q, UNSTEMMED), 20, 4, copies)


@_query(f"WITH {_SHARD} SELECT shard, count(*) AS docs, min(doc_id) AS first_doc FROM s WHERE doc_id NOT IN (1, 2, 3) GROUP BY shard")
def sharded_table(spark: SparkSession, d: str) -> DataFrame:
    """Documents written by shard, three of them deleted from their shards, and shards merged."""
    path = new_path(spark, "sharded")
    cluster.write_sharded(_table(spark, d, "docs"), path, 4)
    remove_at_end(spark, path)
    for doc_id in (1, 2, 3):
        cluster.delete_sharded(spark, path, doc_id, 4)
    cluster.merge_sharded(spark, path, 4)
    return spark.read.parquet(path).groupBy("shard").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))


@_query(f"WITH {_LIVE} SELECT doc_id, title FROM d WHERE doc_id <> 4")
def copied_segments(spark: SparkSession, d: str) -> DataFrame:
    """Two generations with a deletion, copied to another place with check sums compared, and read there."""
    path, docs = new_path(spark, "segments"), _docs(spark, d)
    segments.write_segment(docs.where("doc_id % 2 = 0"), f"{path}/a")
    segments.write_segment(docs.where("doc_id % 2 = 1"), f"{path}/a")
    remove_at_end(spark, path)
    segments.delete(f"{path}/a", 4)
    segments.copy_segments(spark, f"{path}/a", f"{path}/b")
    return segments.read_live(spark, f"{path}/b").select("doc_id", "title")


@_query(f"WITH {_LIVE} SELECT doc_id, title FROM d WHERE doc_id NOT IN (5, 6)")
def merge_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every batch written as a segment, two documents deleted, all merged into one segment and read again."""
    path = new_path(spark, "segments")
    docs = _table(spark, d, "docs")
    for r in docs.select("seg").distinct().orderBy("seg").collect():
        segments.write_segment(docs.where(F.col("seg") == r.seg).dropDuplicates(["doc_id"]), path)
    remove_at_end(spark, path)
    for doc_id in (5, 6):
        segments.delete(path, doc_id)
    segments.merge(spark, path)
    return segments.read_live(spark, path).select("doc_id", "title")


# --- evaluation: the logged explanations as a run, the highest frequency of a term, at most 3, as grade
def _run_sql(score: str, x: str) -> str:
    """CTEs of a report, all names ending in x."""
    return f"""run{x} AS (SELECT query_id, doc_id, round(sum({score}), 6) AS score FROM (SELECT DISTINCT * FROM term_scores) GROUP BY ALL),
j{x} AS (SELECT query_id, doc_id, least(max(tf), 3) AS grade FROM term_scores GROUP BY ALL),
r{x} AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM run{x}),
h{x} AS (SELECT r{x}.*, grade, (grade >= 1)::INT AS rel, sum((grade >= 1)::INT) OVER (PARTITION BY query_id ORDER BY rank) AS so_far FROM r{x} JOIN j{x} USING (query_id, doc_id)),
i{x} AS (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS i FROM j{x}),
ideal{x} AS (SELECT query_id, sum(CASE WHEN i <= 10 THEN (pow(2, grade) - 1) / log2(i + 1) ELSE 0 END) AS ideal, sum((grade >= 1)::INT) AS relevant FROM i{x} GROUP BY query_id),
m{x} AS (SELECT query_id, sum(CASE WHEN rank <= 10 THEN (pow(2, grade) - 1) / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN rank <= 10 THEN rel ELSE 0 END) AS found, sum(CASE WHEN rel = 1 THEN so_far / rank ELSE 0 END) AS precisions, min(CASE WHEN rel = 1 THEN rank END) AS first FROM h{x} GROUP BY query_id),
e{x} AS (SELECT query_id, CASE WHEN ideal > 0 THEN dcg / ideal ELSE 1 END AS ndcg, found / 10 AS precision, CASE WHEN relevant > 0 THEN found / relevant ELSE 1 END AS recall, CASE WHEN relevant > 0 THEN precisions / relevant ELSE 1 END AS ap, coalesce(1 / first, 0) AS rr FROM m{x} JOIN ideal{x} USING (query_id))"""


def _report(spark: SparkSession, d: str, score: str = "contrib") -> DataFrame:
    t = _table(spark, d, "term_scores").distinct()
    run = evaluate.ranked(t.groupBy("query_id", "doc_id").agg(F.round(F.sum(score), 6).alias("score")))
    judged = t.groupBy("query_id", "doc_id").agg(F.least(F.max("tf"), F.lit(3)).alias("grade"))
    return evaluate.evaluate(run, run, judged)


_METRICS = ("ndcg", "precision", "recall", "ap", "rr")


@_query("SELECT DISTINCT query_id FROM term_scores")
def judged_queries(spark: SparkSession, d: str) -> DataFrame:
    return query_ids(_table(spark, d, "term_scores").select("query_id"))


@_query(f"WITH {_run_sql('contrib', '')} SELECT query_id, {', '.join(f'round({c}, 6) AS {c}' for c in _METRICS)} FROM e")
def eval_queries(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d).select("query_id", *[F.round(c, 6).alias(c) for c in _METRICS])


@_query(f"WITH {_run_sql('contrib', '')} SELECT {', '.join(f'round(avg({c}), 6) AS {c}' for c in _METRICS)} FROM e")
def eval_means(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.means(_report(spark, d)).select(*[F.round(c, 6).alias(c) for c in _METRICS])


@_query(
    f"WITH {_run_sql('contrib', '')}, {_run_sql('tf', '2')} SELECT query_id, round(e2.ndcg - e.ndcg, 6) AS delta, CASE WHEN e2.ndcg - e.ndcg < -1e-9 THEN 'worse' WHEN e2.ndcg - e.ndcg > 1e-9 THEN 'better' ELSE 'same' END AS change FROM e JOIN e2 USING (query_id)"
)
def eval_regression(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.compare(_report(spark, d), _report(spark, d, "tf")).withColumn("delta", F.round("delta", 6))


@_query("SELECT round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.latency(_table(spark, d, "events"), "value").withColumn("mean", F.round("mean", 6))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
