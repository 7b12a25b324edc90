"""Spelling corrections and completions over the live vocabulary."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textharbor.config import Analysis
from textharbor.functions.analysis import analyze


def within(vocabulary: DataFrame, term: str, distance: int) -> DataFrame:
    """Terms within an edit distance, with ``dist``. Lengths rule most of them out before any distance is computed."""
    near = vocabulary.where(F.length("term").between(len(term) - distance, len(term) + distance))
    return near.withColumn("dist", F.levenshtein("term", F.lit(term), distance)).where("dist >= 0")


def suggest(vocabulary: DataFrame, term: str, distance: int = 2, limit: int = 5) -> DataFrame:
    """Corrections of a term from (term, df): nearest first, then most frequent, then by name."""
    return within(vocabulary, term, distance).where("dist > 0").orderBy("dist", F.desc("df"), "term").limit(limit)


def complete(vocabulary: DataFrame, prefix: str, limit: int = 8) -> DataFrame:
    """Terms that begin with a prefix, most frequent first; of a vocabulary by field, each field's terms."""
    by = [F.desc("df"), F.col("term"), *([F.col("field")] if "field" in vocabulary.columns else [])]
    return vocabulary.where(F.col("term").startswith(prefix)).orderBy(*by).limit(limit)


def clamp(limit: int, most: int) -> int:
    """Limits of searches (most 100) and completions (most 50) that users ask for."""
    return max(1, min(limit, most))


def naive_within(terms: list[str], term: str, distance: int) -> list[tuple[str, int]]:
    """(term, distance) by comparing with every term: the plain way that ``within`` is tested against."""

    def edits(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    return sorted((t, d) for t in set(terms) if (d := edits(t, term)) <= distance)


def all_fields(termstats: DataFrame) -> DataFrame:
    """(term, df) over the fields together."""
    return termstats.groupBy("term").agg(F.sum("df").alias("df"))


def did_you_mean(vocabulary: DataFrame, text: str, analysis: Analysis, field: int = 2) -> str | None:
    """The query with its unknown words corrected; None for query syntax and where nothing can be corrected. AND, OR and NOT stay."""
    if re.search(r'["():]', text):
        return None
    words, changed = text.split(), False
    terms = {w: [t for t, _ in analyze(w, analysis.of(field))] for w in words if w.upper() not in ("AND", "OR", "NOT")}
    asked = sorted({t for ts in terms.values() for t in ts})
    known = {r.term for r in vocabulary.where(F.col("term").isin(asked)).select("term").collect()} if asked else set()
    fixes = {t: best[0].term for t in asked if t not in known and (best := suggest(vocabulary, t, 2, 1).collect())}
    for i, w in enumerate(words):
        fix = next((fixes[t] for t in terms.get(w, ()) if t in fixes), None)
        if fix is not None and fix != w:
            words[i], changed = fix, True
    return " ".join(words) if changed else None
