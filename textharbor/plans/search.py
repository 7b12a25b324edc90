"""From a query tree to one DataFrame plan.

The leaves of the tree become conditions on posting rows. One aggregation by document gathers each leaf's flag and the
score of the scoring terms; the tree over the flags is the filter. Documents that match without any posting (NOT, site, match-all)
are joined in only where the tree can hold without flags.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textharbor.config import Ranking
from textharbor.operators.index import IndexView
from textharbor.plans.query import And, Fuzzy, MatchAll, MatchNothing, Not, Or, Phrase, Prefix, Query, Site, Term


def leaf_condition(leaf: Query) -> Column:
    """Which posting rows a leaf looks at."""
    term = F.col("term")
    if isinstance(leaf, Term):
        found = term == leaf.term
    elif isinstance(leaf, Phrase):
        found = term.isin(list(leaf.terms))
    elif isinstance(leaf, Prefix):
        found = term.startswith(leaf.prefix)
    elif isinstance(leaf, Fuzzy):
        near = F.length(term).between(len(leaf.term) - leaf.distance, len(leaf.term) + leaf.distance)
        found = near & (F.levenshtein(term, F.lit(leaf.term), leaf.distance) >= 0)
    else:
        return F.lit(False)
    return found if leaf.field is None else (F.col("field") == leaf.field) & found


def matches(query: Query, flag: dict[Query, Column]) -> Column:
    """The tree over its leaves' flags. An empty AND or OR matches nothing."""
    if isinstance(query, MatchAll):
        return F.lit(True)
    if isinstance(query, MatchNothing) or (isinstance(query, (And, Or)) and not query.arms):
        return F.lit(False)
    if isinstance(query, And):
        return reduce(lambda a, b: a & b, [matches(q, flag) for q in query.arms])
    if isinstance(query, Or):
        return reduce(lambda a, b: a | b, [matches(q, flag) for q in query.arms])
    if isinstance(query, Not):
        return ~matches(query.arm, flag)
    return flag[query]


def holds_without_flags(query: Query) -> bool:
    """Whether a document without any leaf's posting may match."""
    if isinstance(query, (MatchAll, Site)):
        return True
    if isinstance(query, And):
        return bool(query.arms) and all(holds_without_flags(q) for q in query.arms)
    if isinstance(query, Or):
        return any(holds_without_flags(q) for q in query.arms)
    if isinstance(query, Not):
        return True
    return False


def has_site(query: Query) -> bool:
    return any(isinstance(q, Site) for q, _ in query.leaves())


def _phrase_flag(leaf: Phrase, places: dict[str, str]) -> Column:
    """Whether consecutive positions hold the phrase's terms. places: the columns of the positions gathered per term."""
    places = [F.col(places[t]) for t in leaf.terms]
    first, rest = places[0], list(enumerate(places))[1:]
    after = lambda p: reduce(lambda a, b: a & b, [F.array_contains(x, p + i) for i, x in rest])
    return F.coalesce(F.exists(first, after), F.lit(False))


def flagged(view: IndexView, query: Query, extra: list[Column] | None = None, postings: DataFrame | None = None) -> tuple[DataFrame, dict[Query, Column]]:
    """(doc_id, flags and extra aggregates) of all documents that may match, and the column of every leaf's flag."""
    leaves = list(dict.fromkeys(q for q, _ in query.leaves() if not isinstance(q, (MatchAll, MatchNothing))))
    looked = [q for q in leaves if not isinstance(q, Site)]
    rows = view.postings if postings is None else postings
    wanted = reduce(lambda a, b: a | b, [leaf_condition(q) for q in looked], F.lit(False))
    aggregates, flag = list(extra or []), {}
    for i, leaf in enumerate(looked):
        if isinstance(leaf, Phrase):
            places = {t: f"__p{i}_{j}" for j, t in enumerate(dict.fromkeys(leaf.terms))}
            for t, name in places.items():
                here = (F.col("field") == leaf.field) & (F.col("term") == t)
                aggregates.append(F.first(F.when(here, F.col("positions")), ignorenulls=True).alias(name))
            flag[leaf] = _phrase_flag(leaf, places)
        else:
            aggregates.append(F.max(leaf_condition(leaf)).alias(f"__f{i}"))
            flag[leaf] = F.coalesce(F.col(f"__f{i}"), F.lit(False))
    found = rows.where(wanted).groupBy("doc_id").agg(*(aggregates or [F.lit(True).alias("__any")]))
    columns = ["doc_id", "url"] if has_site(query) else ["doc_id"]
    if holds_without_flags(query):
        found = view.docs.select(*columns).join(found, "doc_id", "left")
    elif has_site(query):
        found = view.docs.select(*columns).join(found, "doc_id")
    for leaf in leaves:
        if isinstance(leaf, Site):
            flag[leaf] = F.coalesce(F.lower("url").contains(leaf.needle), F.lit(False))
    return found, flag


def boolean(view: IndexView, query: Query) -> DataFrame:
    """(doc_id) of every matching document."""
    found, flag = flagged(view, query)
    return found.where(matches(query, flag)).select("doc_id")


def scoring_condition(query: Query) -> Column:
    """Posting rows that add to the score: those of leaves without a NOT above them."""
    positive = list(dict.fromkeys(q for q, negated in query.leaves() if not negated and not isinstance(q, (Site, MatchAll, MatchNothing))))
    return reduce(lambda a, b: a | b, [leaf_condition(q) for q in positive], F.lit(False))


def contribution(ranking: Ranking, n: int | Column) -> Column:
    """Score of one posting row with df and avg_len: field weight x idf x saturated or logarithmic frequency."""
    n = F.lit(n) if not isinstance(n, Column) else n
    idf = F.when((F.col("df") > 0) & (n > 0), F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))).otherwise(0.0)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in ranking.weights]), F.col("field") + 1)
    if ranking.scoring == "tfidf":
        return weight * idf * (1 + F.log("tf"))
    k1, b = ranking.bm25_k1, ranking.bm25_b
    norm = F.col("tf") + k1 * (1 - b + b * F.col("len") / F.greatest(F.col("avg_len"), F.lit(1e-9)))
    return weight * idf * F.col("tf") * (k1 + 1) / F.greatest(norm, F.lit(1e-12))
