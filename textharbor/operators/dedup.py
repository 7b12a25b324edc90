"""Exact and near duplicates of crawled documents: first come, first kept."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from textharbor.functions.analysis import normalize_text
from textharbor.functions.hashing import fnv1a_hex, hamming, simhash
from textharbor.operators.lineage import cut

DISTANCE = 7
MIN_WORDS = 25


def fingerprints(docs: DataFrame, text: str = "body") -> DataFrame:
    """(doc_id, hash, sim, words) of the normalized text."""
    rows = docs.select("doc_id", normalize_text(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    words = F.when(F.col("t") == "", 0).otherwise(F.size(F.split("t", " ")))
    return rows.select("doc_id", fnv1a_hex(F.col("t")).alias("hash"), simhash(F.col("t")).alias("sim"), words.alias("words"))


def exact(prints: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The first document of each hash; none whose hash is among ``known(hash)``."""
    first = prints.groupBy("hash").agg(F.min(F.struct("doc_id", "sim", "words")).alias("x")).select("x.doc_id", "hash", "x.sim", "x.words")
    return first if known is None else first.join(known.select("hash"), "hash", "left_anti")


def _ends(blocks: int) -> list[int]:
    return [64 * i // blocks for i in range(blocks + 1)]


def block_keys(sim: Column, blocks: int) -> Column:
    """The bits of each block of a hash, with the block's number: key, value."""
    ends = _ends(blocks)
    of = lambda low, high: F.shiftrightunsigned(sim, low).bitwiseAND(F.lit((1 << (high - low)) - 1).cast("bigint")).cast("int")
    return F.array(*[F.struct(F.lit(i).alias("key"), of(low, high).alias("value")) for i, (low, high) in enumerate(zip(ends, ends[1:]))])


#: From so many hashes on with a common block, two further blocks are looked up instead of one.
LARGE_BUCKET = 4096
#: So many comparisons at most are held at once.
CHUNK = 1 << 18


def _allowed(blocks: int, distance: int) -> list[int]:
    """By how many bits hashes may differ in their first 1, 2, ... blocks, starting from a suitable one and going on in a ring.

    If all blocks together differ by the distance at most, there is a block from which no run of blocks exceeds its share of it.
    """
    return [distance * n // blocks for n in range(1, blocks + 1)]


def _patterns(first: int, second: int, allowed: list[int]) -> list[int]:
    """The differences, as bits, that are allowed in the two blocks after the common one; the first of them has the high bits."""
    few = lambda width, most: [sum(1 << i for i in c) for n in range(most + 1) for c in combinations(range(width), n)]
    return [x << second | y for x in few(first, allowed[1]) for y in (few(second, allowed[2] - x.bit_count()) if second else [0])]


def bucket_pairs(sims: np.ndarray, key: int, blocks: int, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, dist) of the hashes with a common block whose pairs this block is the first to find: positions in ``sims`` and their distance."""
    ends, allowed, n = _ends(blocks), _allowed(blocks, distance), len(sims)
    cut_of = lambda v, i: v >> np.uint64(ends[i]) & np.uint64((1 << (ends[i + 1] - ends[i])) - 1)
    after = [(key + j) % blocks for j in (1, 2)]
    first, second = (ends[i + 1] - ends[i] for i in after)
    sub = cut_of(sims, after[0]).astype(np.int64)
    if n >= LARGE_BUCKET:
        sub = sub << second | cut_of(sims, after[1]).astype(np.int64)
    else:
        second = 0
    order = np.argsort(sub, kind="stable")
    sub, sims = sub[order], sims[order]
    start = np.searchsorted(sub, np.arange((1 << first + second) + 1))
    for pattern in _patterns(first, second, allowed):
        other = sub ^ pattern
        low, high = start[other], start[other + 1]
        low = np.maximum(low, np.arange(n) + 1)  # each pair once, from its first place
        size = np.maximum(high - low, 0)
        total = np.cumsum(size)
        at = 0
        while at < n:
            done = total[at - 1] if at else 0
            if total[-1] == done:
                break
            end = max(at + 1, int(np.searchsorted(total, done + CHUNK, side="right")))
            some = size[at:end]
            x = np.repeat(np.arange(at, end), some)
            y = np.arange(len(x)) - np.repeat(np.cumsum(some) - some, some) + np.repeat(low[at:end], some)
            at = end
            diff = sims[x] ^ sims[y]
            near = np.flatnonzero(np.bitwise_count(diff) <= distance)
            if not len(near):
                continue
            x, y, diff = x[near], y[near], diff[near]
            bits = np.stack([np.bitwise_count(cut_of(diff, i)) for i in range(blocks)])
            ring = np.concatenate([bits, bits])
            # a pair is met in all blocks that it has in common, and taken from the first one that the rule of _allowed must find
            good = np.stack([(np.cumsum(ring[i : i + blocks], axis=0, dtype=np.uint8) <= np.array(allowed, dtype=np.uint8)[:, None]).all(axis=0) for i in range(blocks)])
            mine = good.argmax(axis=0) == key
            if mine.any():
                yield order[x[mine]], order[y[mine]], bits.sum(axis=0, dtype=np.int32)[mine]


def near_pairs(prints: DataFrame, distance: int = DISTANCE, min_words: int = MIN_WORDS, blocks: int | None = None) -> DataFrame:
    """(a, b, dist), a < b, of hashes within a distance. Documents of one hash are represented by the smallest id; the others are linked to it.

    Hashes meet by a block of bits, and within it by lookups of the blocks after it, so each hash is shuffled once for each of the blocks.
    blocks: more than the distance, and 8 at least.
    """
    blocks = max(distance + 1, 8) if blocks is None else blocks
    if not max(distance, 7) < blocks <= 64:
        raise ValueError(f"{blocks} blocks cannot find distances up to {distance}: between {max(distance + 1, 8)} and 64 can")
    rows = cut(prints.where((F.col("words") >= min_words) & F.col("sim").isNotNull()).select("doc_id", "sim"))
    group = cut(rows.groupBy("sim").agg(F.min("doc_id").alias("doc_id")))
    keyed = group.select("doc_id", "sim", F.explode(block_keys(F.col("sim"), blocks)).alias("k")).select("doc_id", "sim", "k.key", "k.value")
    schema = StructType([StructField("x", group.schema["doc_id"].dataType), StructField("y", group.schema["doc_id"].dataType), StructField("dist", IntegerType())])
    arrow = to_arrow_schema(schema)

    def meet(bucket: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(bucket)
        ids, sims = table["doc_id"].combine_chunks(), table["sim"].to_numpy().view(np.uint64)
        for x, y, dist in bucket_pairs(sims, table["key"][0].as_py(), blocks, distance):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(x)), ids.take(pa.array(y)), pa.array(dist)], schema=arrow)

    met = keyed.groupBy("key", "value").applyInArrow(meet, schema)
    different = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "dist")
    # a sort-merge join: both sides grow with the table, and the size of a file says little about its rows
    equal = rows.join(group.withColumnRenamed("doc_id", "a").hint("merge"), "sim").where("doc_id <> a").select("a", F.col("doc_id").alias("b"), F.lit(0).alias("dist"))
    return different.unionByName(equal)


def classes(prints: DataFrame, distance: int = DISTANCE, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, representative, links): each document with the smallest id of those with its hash, and how many other hashes lie within the distance."""
    rows = prints.where((F.col("words") >= min_words) & F.col("sim").isNotNull()).select("doc_id", "sim")
    own = rows.groupBy("sim").agg(F.min("doc_id").alias("representative"))
    pairs = cut(near_pairs(prints, distance, min_words).where("dist > 0"))
    links = pairs.select(F.col("a").alias("representative")).union(pairs.select("b")).groupBy("representative").agg(F.count("*").alias("links"))
    # sort-merge joins, as in near_pairs
    return rows.join(own.hint("merge"), "sim").join(links.hint("merge"), "representative", "left").select("doc_id", "representative", F.coalesce("links", F.lit(0)).alias("links"))


def counters(outcomes: DataFrame) -> DataFrame:
    """(outcome, n) of ``near``."""
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


def near(docs: DataFrame, text: str = "body", known: DataFrame | None = None, distance: int = DISTANCE, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, outcome): unique, exact_duplicate or near_duplicate, as if documents came in the order of their ids.

    A document is a near duplicate if an earlier one that is kept lies within the distance. Rounds decide all documents whose
    earlier neighbours are decided: the first independent set in the order of ids.
    """
    prints = cut(fingerprints(docs, text))
    kept = cut(exact(prints, known))
    found = cut(near_pairs(kept, distance, min_words))
    # of documents of one hash only the first can be kept: it is, or what it repeats, the others repeat too
    pairs = found.where("dist > 0").select("a", "b")
    open_ = cut(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "doc_id"))
    dropped = found.where("dist = 0").select(F.col("b").alias("doc_id"))
    # sort-merge joins, as in near_pairs
    while open_.limit(1).count():
        waiting = pairs.join(open_.withColumnRenamed("doc_id", "a").hint("merge"), "a", "left_semi").select(F.col("b").alias("doc_id")).distinct()
        free = cut(open_.join(waiting.hint("merge"), "doc_id", "left_anti"))
        gone = cut(pairs.join(free.withColumnRenamed("doc_id", "a").hint("merge"), "a", "left_semi").join(open_.withColumnRenamed("doc_id", "b").hint("merge"), "b", "left_semi").select(F.col("b").alias("doc_id")).distinct())
        dropped = dropped.unionByName(gone)
        open_ = cut(open_.join(free.unionByName(gone).distinct().hint("merge"), "doc_id", "left_anti"))
    near_ids = dropped.distinct().withColumn("near", F.lit(True))
    first = kept.select("doc_id", F.lit(True).alias("kept"))
    rows = prints.select("doc_id").distinct().join(first.hint("merge"), "doc_id", "left").join(near_ids.hint("merge"), "doc_id", "left")
    outcome = F.when(F.col("kept").isNull(), "exact_duplicate").when(F.col("near"), "near_duplicate").otherwise("unique")
    return rows.select("doc_id", outcome.alias("outcome"))
