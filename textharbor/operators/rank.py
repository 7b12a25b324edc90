"""Ranked retrieval: BM25 and TF-IDF over fields, authority and freshness, explanations, exact top-k with and without pruning."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textharbor.config import Ranking
from textharbor.operators.index import IndexView, block_of
from textharbor.operators.lineage import cut
from textharbor.plans.query import Query
from textharbor.plans.search import contribution, flagged, holds_without_flags, leaf_condition, matches, scoring_condition

EPSILON = 1e-6


def scored_postings(view: IndexView, query: Query, ranking: Ranking) -> DataFrame:
    """The postings that the query looks at, with df, avg_len, n_docs, scoring (whether they add to the score) and contrib.

    A written index has df in its postings and the fields' statistics as constants: one pruned scan gives all. Otherwise df is
    counted in the same rows, and joined with the field averages, a handful of rows.
    """
    wanted = F.lit(False)
    for leaf in dict.fromkeys(q for q, _ in query.leaves()):
        wanted = wanted | leaf_condition(leaf)
    rows = view.postings.where(wanted)
    if "df" not in rows.columns:
        rows = rows.join(rows.groupBy("field", "term").agg(F.count("*").alias("df")), ["field", "term"])
    rows = _with_field_stats(view, rows).withColumn("scoring", scoring_condition(query))
    return rows.withColumn("contrib", F.when(F.col("scoring"), contribution(ranking, F.col("n_docs"))).otherwise(0.0))


def _with_field_stats(view: IndexView, rows: DataFrame) -> DataFrame:
    """Rows with n_docs and avg_len of their field."""
    if view.fields is None:
        return rows.join(F.broadcast(view.stats().select("field", "n_docs", "avg_len")), "field")  # one row per field
    kept = [view.fields.get(f, (0, 0, 0.0)) for f in range(max(view.fields, default=0) + 1)]
    of = lambda i, kind: F.element_at(F.array(*[F.lit(x[i]).cast(kind) for x in kept]), F.col("field") + 1)
    return rows.withColumn("n_docs", of(1, "bigint")).withColumn("avg_len", of(2, "double"))


def authority(docs: DataFrame) -> Column:
    """metadata['authority'] as a number; anything but a finite number of 0 or more is 0."""
    value = F.try_element_at(F.col("metadata"), F.lit("authority")).try_cast("float")
    good = value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value < float("inf"))
    return F.when(good, value.cast("double")).otherwise(0.0)


def recency(timestamp: Column, newest: Column | int, halflife_days: float) -> Column:
    """Halves with every halflife of age; 0 where either time is unknown."""
    newest = F.lit(newest) if not isinstance(newest, Column) else newest
    age = F.greatest(newest - timestamp, F.lit(0)) / 86400.0
    known = (F.coalesce(timestamp, F.lit(0)) > 0) & (newest > 0)
    return F.when(known, F.pow(F.lit(0.5), age / max(1.0, halflife_days))).otherwise(0.0)


def _blended(found: DataFrame, view: IndexView, ranking: Ranking) -> DataFrame:
    """Scores with authority and freshness added, where they have weight."""
    parts = F.coalesce("score", F.lit(0.0))
    if ranking.authority_weight or ranking.freshness_weight:
        docs = view.docs.select("doc_id", authority(view.docs).alias("authority"), F.col("timestamp").alias("__ts"))
        latest = (view.docs.agg(F.max("timestamp").alias("t")).first().t or 0) if ranking.freshness_weight else 0
        found = found.join(docs, "doc_id").withColumn("freshness", recency(F.col("__ts"), latest, ranking.freshness_halflife_days))
        parts = parts + ranking.authority_weight * F.col("authority") + ranking.freshness_weight * F.col("freshness")
    return found.withColumn("score", parts)


def scores(view: IndexView, query: Query, ranking: Ranking = Ranking()) -> DataFrame:
    """(doc_id, score) of every matching document; documents that match without a scoring term have their blends only."""
    rows = scored_postings(view, query, ranking)
    found, flag = flagged(view, query, [F.sum("contrib").alias("score")], rows)
    return _blended(found.where(matches(query, flag)), view, ranking).select("doc_id", "score")


def top_k(view: IndexView, query: Query, k: int, ranking: Ranking = Ranking(), digits: int = 4) -> DataFrame:
    """The k best documents, best first, ties by doc_id."""
    found = scores(view, query, ranking).withColumn("score", F.round("score", digits))
    return found.orderBy(F.desc("score"), "doc_id").limit(k)


def explained(view: IndexView, query: Query, k: int, ranking: Ranking = Ranking()) -> DataFrame:
    """(doc_id, score, field, term, tf, df, idf, len, avg_len, contrib): how the k best documents came to their scores."""
    best = F.broadcast(top_k(view, query, k, ranking))  # at most k rows
    rows = scored_postings(view, query, ranking).where("scoring")
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return rows.join(best, "doc_id").select("doc_id", "score", "field", "term", "tf", "df", idf.alias("idf"), "len", "avg_len", "contrib")


#: So many ranges of blocks at most are pushed into a scan; more are joined.
MOST_RANGES = 500
#: So many blocks at most are taken to the driver.
MOST_BLOCKS = 50_000


def _ranges(blocks: list[int]) -> list[tuple[int, int]]:
    """Runs of neighbouring numbers."""
    found: list[tuple[int, int]] = []
    for b in sorted(blocks):
        if found and found[-1][1] == b - 1:
            found[-1] = found[-1][0], b
        else:
            found.append((b, b))
    return found


def _any_of(conditions: list[Column]) -> Column:
    """OR of conditions as a tree of little depth: Spark follows an expression by recursion, and its stack ends at some hundred levels."""
    if len(conditions) < 2:
        return conditions[0] if conditions else F.lit(False)
    half = len(conditions) // 2
    return _any_of(conditions[:half]) | _any_of(conditions[half:])


def pruned_top_k(view: IndexView, query: Query, k: int, ranking: Ranking = Ranking(), digits: int = 4) -> tuple[DataFrame, DataFrame]:
    """The same documents as ``top_k``, and (blocks, blocks_scored, blocks_skipped, postings, postings_scored).

    What a block of ids can score at most is known from the dictionary's block bounds, without a posting read. The k blocks with the highest
    bounds are scored first; their k-th score is a threshold. Blocks that cannot reach it are never read. Documents that match
    without any scoring posting have a score of their blends only, and are looked at only if the threshold does not exceed that.
    """
    leaves = list(dict.fromkeys(q for q, negated in query.leaves() if not negated))
    wanted = F.lit(False)
    for leaf in leaves:
        wanted = wanted | leaf_condition(leaf)
    tops = _with_field_stats(view, view.bounds().where(wanted)).withColumnsRenamed({"max_tf": "tf", "min_len": "len"})
    by_block = tops.groupBy("block").agg(F.sum(contribution(ranking, F.col("n_docs"))).alias("bound"), F.sum("n").alias("postings"))
    shift = view.id_shift()
    rows = view.postings if "block" in view.postings.columns else view.postings.withColumn("block", block_of(F.col("doc_id"), shift))
    if "df" not in rows.columns:  # counted over all blocks, before some are left out
        rows = rows.join(view.termstats().select("field", "term", "df"), ["field", "term"])
    extra = ranking.freshness_weight
    if ranking.authority_weight:
        extra += ranking.authority_weight * (view.docs.agg(F.max(authority(view.docs)).alias("a")).first().a or 0.0)
    outside = holds_without_flags(query)

    def scored(blocks: _Blocks) -> DataFrame:
        """Scores of the documents of some blocks."""
        found = scores(replace(view, postings=blocks.of(rows)), query, ranking)
        return blocks.of(found.withColumn("block", block_of(F.col("doc_id"), shift))).drop("block") if outside else found

    blocks = _Blocks.of_bounds(by_block)
    best = [r.score for r in scored(blocks.highest(k)).orderBy(F.desc("score")).limit(k).collect()]
    low = best[-1] if len(best) == k else float("-inf")
    everything = outside and extra + EPSILON >= low  # documents outside of all blocks may be among the best
    least = float("-inf") if everything else low - extra - EPSILON
    found = scores(replace(view, postings=rows), query, ranking) if everything else scored(blocks.reaching(least))
    work = view.docs.sparkSession.createDataFrame([blocks.work(least)], "blocks long, blocks_scored long, blocks_skipped long, postings long, postings_scored long")
    return found.withColumn("score", F.round("score", digits)).orderBy(F.desc("score"), "doc_id").limit(k), work


@dataclass
class _Blocks:
    """Blocks with their bounds: on the driver where they are few, in a table of the shared folder where they are many."""

    few: list[tuple[int, float, int]] | None
    many: DataFrame | None

    @staticmethod
    def of_bounds(by_block: DataFrame) -> _Blocks:
        """by_block(block, bound, postings)."""
        rows = by_block.select("block", "bound", "postings").limit(MOST_BLOCKS + 1).collect()
        return _Blocks([tuple(r) for r in rows], None) if len(rows) <= MOST_BLOCKS else _Blocks(None, cut(by_block))

    def highest(self, k: int) -> _Blocks:
        """The k blocks with the highest bounds."""
        if self.few is not None:
            return _Blocks(sorted(self.few, key=lambda x: (-x[1], x[0]))[:k], None)
        return _Blocks([tuple(r) for r in self.many.orderBy(F.desc("bound"), "block").limit(k).select("block", "bound", "postings").collect()], None)

    def reaching(self, least: float) -> _Blocks:
        if self.few is not None:
            return _Blocks([x for x in self.few if x[1] >= least], None)
        return _Blocks(None, self.many.where(F.col("bound") >= least))

    def of(self, rows: DataFrame) -> DataFrame:
        """Rows of these blocks: by ranges that reach the scan, or by a join where there are too many ranges."""
        if self.few is None:
            return rows.join(self.many.select("block").hint("merge"), "block", "left_semi")
        ranges = _ranges([x[0] for x in self.few])
        if len(ranges) > MOST_RANGES:
            kept = rows.sparkSession.createDataFrame([(x[0],) for x in self.few], "block long")
            return rows.join(F.broadcast(kept), "block", "left_semi")  # at most MOST_BLOCKS numbers
        return rows.where(_any_of([F.col("block").between(*r) for r in ranges]))

    def work(self, least: float) -> tuple[int, int, int, int, int]:
        """(blocks, blocks_scored, blocks_skipped, postings, postings_scored) where blocks under a bound are skipped."""
        if self.few is not None:
            kept = [x for x in self.few if x[1] >= least]
            return len(self.few), len(kept), len(self.few) - len(kept), sum(x[2] for x in self.few), sum(x[2] for x in kept)
        reach = F.col("bound") >= least
        r = self.many.agg(F.count("*"), F.sum(reach.cast("int")), F.sum("postings"), F.sum(F.when(reach, F.col("postings")).otherwise(0))).first()
        return r[0], r[1], r[0] - r[1], r[2], r[3]


def term_maxima(view: IndexView, query: Query, ranking: Ranking = Ranking()) -> DataFrame:
    """(field, term, blocks, postings, top): what each scoring term can add at most, over all its blocks."""
    wanted = scoring_condition(query)
    tops = _with_field_stats(view, view.bounds().where(wanted)).withColumnsRenamed({"max_tf": "tf", "min_len": "len"})
    return tops.groupBy("field", "term").agg(F.count("*").alias("blocks"), F.sum("n").alias("postings"), F.max(contribution(ranking, F.col("n_docs"))).alias("top"))


def field_scores(view: IndexView, query: Query, k: int, ranking: Ranking = Ranking()) -> DataFrame:
    """(doc_id, score, field, field_score, authority, freshness) of the k best documents: what each field and each blend added."""
    best = F.broadcast(top_k(view, query, k, ranking))  # at most k rows
    parts = scored_postings(view, query, ranking).where("scoring").join(best, "doc_id").groupBy("doc_id", "score", "field").agg(F.sum("contrib").alias("field_score"))
    latest = view.docs.agg(F.max("timestamp").alias("t")).first().t or 0
    blends = view.docs.select("doc_id", (authority(view.docs) * ranking.authority_weight).alias("authority"), (recency(F.col("timestamp"), latest, ranking.freshness_halflife_days) * ranking.freshness_weight).alias("freshness"))
    return parts.join(blends, "doc_id")


def many_top_k(view: IndexView, queries: dict[str, list[str]], k: int, field: int = 2, ranking: Ranking = Ranking(), digits: int = 4) -> DataFrame:
    """(query_id, doc_id, score, rank) of many OR queries in one job: the batch form, with the query as an extra key."""
    spark = view.docs.sparkSession
    asked = spark.createDataFrame([(q, t) for q, ts in queries.items() for t in dict.fromkeys(ts)], "query_id string, term string")
    rows = view.postings.where((F.col("field") == field) & F.col("term").isin(sorted({t for ts in queries.values() for t in ts})))
    if "df" not in rows.columns:
        rows = rows.join(rows.groupBy("field", "term").agg(F.count("*").alias("df")), ["field", "term"])
    rows = _with_field_stats(view, rows).withColumn("contrib", contribution(ranking, F.col("n_docs"))).join(F.broadcast(asked), "term")  # as many rows as the queries have terms
    found = rows.groupBy("query_id", "doc_id").agg(F.round(F.sum("contrib"), digits).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
