"""Evaluation passages in training text (problem 8): size-partitioned MinHash containment search.

The searched units are *passages*: every ``passage`` consecutive words of an item. Texts are cut into overlapping blocks of
word shingles such that each passage lies whole within one block. Blocks and passages are MinHashed; a passage that a
block contains shares each hash function's minimum with probability |passage| / |block|. Blocks are partitioned by
size, and each partition uses as many hash functions as it takes to miss a contained passage with probability ``miss``.
Blocks that share a minimum with a passage are candidates; exact containment of the passage's words decides.

Items are broadcast; where they hold more than ``MOST_PASSAGES`` passages, they are split by a hash of their id into groups of about so many, each
of which goes over the texts by itself. Texts are never shuffled. Words are runs of letters and digits in lower case, so
punctuation and blanks do not matter.

Defined results: items shorter than a passage, null or empty texts and prompts match nothing; repeated rows count once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textharbor.llm.common import WORD, Hashes, cut, hash_words, map_batches, slices

PASSAGE = 12
SHINGLE = 5
BLOCK = 24
MISS = 1e-7
MOST_PASSAGES = 2_000_000
_B = 0x9E3779B97F4A7C15


def _rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - n + 1, np.uint64)
        for j in range(n):
            out = out * np.uint64(_B) + h[j : len(h) - n + 1 + j]
        return out ^ (out >> np.uint64(31))


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        y = (x ^ np.uint64((k + 1) * 0xD1B54A32D192ED03 & (2**64 - 1))) * np.uint64((2 * k + 1) * 0xBF58476D1CE4E5B9 & (2**64 - 1))
        return y ^ (y >> np.uint64(32))


def size_classes(block: int = BLOCK, passage: int = PASSAGE, shingle: int = SHINGLE, miss: float = MISS) -> list[tuple[int, int]]:
    """(largest block size, hash functions) of each partition, sizes in shingles."""
    own = passage - shingle + 1
    sizes = sorted({min(block, max(own, math.ceil(block * f))) for f in (0.34, 0.5, 0.75, 1)})
    return [(s, 1 if s <= own else math.ceil(math.log(miss) / math.log(1 - own / s))) for s in sizes]


def leaked_items(documents: DataFrame, key: str, text: str, items: DataFrame, item: str, prompt: str, passage: int = PASSAGE) -> DataFrame:
    """(key, item, words): documents that contain a passage of an item, with how many word positions start one."""
    asked = items.select(F.col(item).alias("i"), F.col(prompt).alias("p")).where("i IS NOT NULL AND p IS NOT NULL").distinct()
    n = F.size(F.regexp_extract_all("p", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))) - (passage - 1)
    asked = cut(asked.withColumn("n", n).where("n > 0").drop("n"))
    passages = asked.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n")).first().n
    groups = 1 + passages // MOST_PASSAGES
    parts = [_search(documents, key, text, asked.where(F.pmod(F.xxhash64("i"), F.lit(groups)) == g), passage) for g in range(groups)]
    found = reduce(DataFrame.unionByName, parts)
    return found.groupBy("k", "i").agg(F.max("words").alias("words")).select(F.col("k").alias(key), F.col("i").alias(item), "words")


def _search(documents: DataFrame, key: str, text: str, asked: DataFrame, passage: int) -> DataFrame:
    """(k, i, words) of one group of items asked(i, p), which is taken to the driver and broadcast."""
    spark = documents.sparkSession
    own = passage - SHINGLE + 1
    rows = asked.collect()
    seen = Hashes()
    exact, ids, shingles = [], [], []
    for r in rows:
        h = hash_words(WORD.findall(r.p.lower()), seen)
        run = _rolling(h, passage)
        exact.append(run)
        ids += [r.i] * len(run)
        s = _rolling(h, SHINGLE)
        shingles += [s[j : j + own] for j in range(len(run))]
    runs = np.concatenate(exact) if exact else np.zeros(0, np.uint64)
    order = np.argsort(runs, kind="stable")
    runs, owner = runs[order], np.array(ids, dtype=np.int64)[order]
    classes = size_classes(passage=passage)
    functions = max(n for _, n in classes)
    sets = np.stack(shingles) if shingles else np.zeros((0, own), np.uint64)
    minima = [np.unique(_mixed(sets, k).min(1)) if len(sets) else np.zeros(0, np.uint64) for k in range(functions)]
    shared = spark.sparkContext.broadcast((runs, owner, minima))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen = Hashes()
        runs, owner, minima = shared.value
        for b in slices(batches, 250):
            keys = b.column("k").to_numpy()
            lists = [WORD.findall(t.lower()) for t in b.column("t").to_pylist()]
            h = hash_words([w for x in lists for w in x], seen)
            count = np.array([len(x) for x in lists], dtype=np.int64)
            start = np.cumsum(count) - count
            use = count >= passage
            if not use.any() or not len(runs):
                continue
            s, run = _rolling(h, SHINGLE), _rolling(h, passage)
            # blocks of every text: they overlap by all but one of a passage's shingles
            size = count[use] - SHINGLE + 1
            step = BLOCK - own + 1
            n = np.maximum(1, -(-(size - own + 1) // step))
            of = np.repeat(np.flatnonzero(use), n)
            first = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            at = start[of] + first * step
            end = np.minimum(at + BLOCK, start[of] + count[of] - SHINGLE + 1)
            hit = np.zeros(len(at), bool)
            length, low = end - at, 0
            for top, functions in classes:
                which = np.flatnonzero((length > low) & (length <= top))
                low = top
                if not len(which):
                    continue
                spot = at[which, None] + np.arange(top)
                inside = np.minimum(spot, end[which, None] - 1)
                block = s[inside]
                for k in range(functions):
                    least = _mixed(block, k).min(1)
                    m = minima[k]
                    i = np.minimum(np.searchsorted(m, least), len(m) - 1)
                    hit[which] |= m[i] == least
            if not hit.any():
                continue
            spot = (at[hit, None] + np.arange(step)).ravel()
            doc = np.repeat(of[hit], step)
            ok = spot <= start[doc] + count[doc] - passage
            spot, doc = spot[ok], doc[ok]
            low, high = np.searchsorted(runs, run[spot], "left"), np.searchsorted(runs, run[spot], "right")
            times = high - low
            doc, spot = np.repeat(doc, times), np.repeat(spot, times)
            which = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            found = np.unique(np.stack([doc, owner[which], spot], 1), axis=0)
            pair, words = np.unique(found[:, :2], axis=0, return_counts=True)
            yield {"k": keys[pair[:, 0]], "i": pair[:, 1], "words": words}

    texts = documents.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where("k IS NOT NULL AND t <> ''")
    return map_batches(texts, search, "k long, i long, words long")
