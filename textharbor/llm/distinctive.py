"""How distinctive a term is per record (problem 5): graph-of-words weighting.

Each record's words (maximal runs of letters and digits, lower case) are nodes; an edge joins two words that stand within
``window`` positions. A term's weight is the number of its distinct neighbours times its rarity,
``ln(1 + (N - df + 0.5) / (df + 0.5))`` over all N records.

One pass over the texts yields each record's terms with frequency and degree, and partial document frequencies, which are
combined by partition before anything is shuffled.

Defined results: null and empty bodies have no terms but count in N; repeated rows of one key count once; a term that
stands alone in its record has degree 0; null keys are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textharbor.llm.common import WORD, cut, map_batches, one_per_key, sized

WINDOW = 4
#: Records whose edges a worker holds at once.
ROWS = 1000


def _batch(keys: np.ndarray, texts: list[str], window: int, min_tf: int) -> tuple[dict, list[str], np.ndarray]:
    """Terms of every text with frequency and degree, and each term's number of texts."""
    lists = [WORD.findall(t.lower()) for t in texts]
    code: dict[str, int] = {}
    flat = np.fromiter((code.setdefault(w, len(code)) for x in lists for w in x), dtype=np.int64)
    words = list(code)
    of = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    n = max(1, len(words))
    term, at, tf = np.unique(of * n + flat, return_inverse=True, return_counts=True)
    df = np.bincount(term % n, minlength=len(words))
    wanted = tf >= min_tf
    # undirected edges between places of ``term``, each once; only those at a wanted term
    found = []
    for k in range(1, window):
        a, b = at[:-k], at[k:]
        use = (of[k:] == of[:-k]) & (a != b)
        if min_tf > 1:
            use &= wanted[a] | wanted[b]
        a, b = a[use], b[use]
        found.append(np.minimum(a, b) * len(term) + np.maximum(a, b))
    edges = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
    edges = edges[np.concatenate([[True], edges[1:] != edges[:-1]])] if len(edges) else edges
    degree = np.bincount(edges // max(1, len(term)), minlength=len(term)) + np.bincount(edges % max(1, len(term)), minlength=len(term))
    term, tf, degree = term[wanted], tf[wanted], degree[wanted]
    return {"key": keys[term // n], "term": pa.array(words, pa.string()).take(pa.array(term % n)), "tf": tf, "degree": degree}, words, df


def term_weights(records: DataFrame, key: str, text: str, window: int = WINDOW, min_tf: int = 1, max_df: int | None = None, digits: int | None = None) -> DataFrame:
    """(key, term, tf, degree, df, idf, weight) of the terms that occur min_tf times or more in their record.

    max_df keeps terms of at most so many records. df and N are those of all records in any case. digits: idf is rounded to so many.
    """
    total = records.agg(F.countDistinct(key).alias("n")).first().n
    rows = one_per_key(records.select(key, text), key).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where("key IS NOT NULL AND text <> ''")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        partial: dict[str, int] = {}
        for b in (b.slice(low, ROWS) for b in batches for low in range(0, b.num_rows, ROWS)):
            out, words, df = _batch(b.column("key").to_numpy(), b.column("text").to_pylist(), window, min_tf)
            for w, n in zip(words, df.tolist()):
                partial[w] = partial.get(w, 0) + n
            yield out | {"df": pa.nulls(len(out["key"]), pa.int64())}
            if len(partial) > 500_000:
                yield {"key": [None] * len(partial), "term": list(partial), "tf": [0] * len(partial), "degree": [0] * len(partial), "df": list(partial.values())}
                partial = {}
        yield {"key": [None] * len(partial), "term": list(partial), "tf": [0] * len(partial), "degree": [0] * len(partial), "df": list(partial.values())}

    both = cut(map_batches(rows, work, "key long, term string, tf int, degree int, df long"))
    df = both.where("df IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df"))
    if max_df is not None:
        df = df.where(F.col("df") <= max_df)
    terms = both.where("key IS NOT NULL").select("key", "term", "tf", "degree")
    idf = F.log(1 + (F.lit(total) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    df = df.withColumn("idf", idf if digits is None else F.round(idf, digits))
    return terms.join(sized(cut(df)), "term").select(F.col("key").alias(key), "term", "tf", "degree", "df", "idf", (F.col("degree") * F.col("idf")).alias("weight"))


def rarity(n: int, df: int) -> float:
    """The rarity factor of a term (for tests)."""
    return math.log(1 + (n - df + 0.5) / (df + 0.5))
