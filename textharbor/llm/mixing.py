"""Mixing sources to target weights (problem 9): capped water-filling.

Sizes are tokens of a public tokenizer. Weights are scaled to add up to 1 over the usable sources (weight above 0 and at least one
token). A source that would need more than its ``max_repeat`` epochs for its share is clamped there, and what it leaves
is divided among the others in proportion to their weights, until no source exceeds its cap. Each record is then repeated
as often as its source's epochs have whole numbers, and once more if it is among the first records, in the order of a seeded hash
of the key, that fill the fraction: each source comes within half a record of its allotment.

Defined results: sources without a target, with null, zero or negative weight, or without tokens take no part; null caps mean no cap, and negative caps 0; a source listed
twice has the sum of its weights and the smaller cap; null texts have no tokens; null sources take no part; if all sources
are clamped, the mixture is smaller than asked for and the shares are those of the caps.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textharbor.llm.common import cut, map_batches

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the tokenizer splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MOST_TARGETS = 100_000


def token_counts(documents: DataFrame, key: str, text: str, source: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, source, tokens) of every record with a key and a source."""
    with open(tokenizer, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            texts = b.column("t").to_pylist()
            yield {"key": b.column("k"), "source": b.column("s"), "tokens": [len(encoding.encode_ordinary(t)) if t else 0 for t in texts]}

    rows = documents.select(F.col(key).cast("long").alias("k"), F.col(source).alias("s"), F.col(text).alias("t")).where("k IS NOT NULL AND s IS NOT NULL")
    return map_batches(rows, work, "key long, source string, tokens long")


def water_fill(weights: np.ndarray, sizes: np.ndarray, caps: np.ndarray, total: float) -> np.ndarray:
    """Tokens of each source; caps in epochs, inf for none."""
    top = np.where(np.isfinite(caps), caps * sizes, np.inf)
    out, free, left = np.zeros(len(weights)), np.ones(len(weights), bool), float(total)
    while free.any() and left > 0:
        want = left * weights / weights[free].sum()
        over = free & (want > top)
        if not over.any():
            out[free] = want[free]
            break
        out[over] = top[over]
        left -= top[over].sum()
        free &= ~over
    return out


def plan(counts: DataFrame, targets: DataFrame, total: float | None = None) -> list[tuple]:
    """(source, weight, tokens, allotted, epochs) of the usable sources. total: tokens of the mixture, else all tokens of those sources."""
    listed = targets.where("source IS NOT NULL AND weight > 0").groupBy("source").agg(F.sum("weight").alias("w"), F.min("max_repeat").alias("cap"))
    sizes = counts.groupBy("source").agg(F.sum("tokens").alias("n"))
    rows = listed.join(sizes, "source").where("n > 0").orderBy("source").limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} target sources")
    weight = np.array([r.w for r in rows], dtype=float)
    size = np.array([r.n for r in rows], dtype=float)
    cap = np.array([np.inf if r.cap is None else max(0, r.cap) for r in rows], dtype=float)
    got = water_fill(weight, size, cap, size.sum() if total is None else total)
    scale = weight.sum() or 1.0
    return [(r.source, float(w / scale), int(s), float(g), float(g / s)) for r, w, s, g in zip(rows, weight, size, got)]


def mixture(documents: DataFrame, key: str, text: str, source: str, targets: DataFrame, total: float | None = None, seed: int = 42, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The mixture (key, source, tokens, repeats) of repeats >= 1, and the report (source, target_share, available, allotted, epochs, tokens, actual_share)."""
    spark = documents.sparkSession
    counts = cut(token_counts(documents, key, text, source, tokenizer).groupBy("key").agg(F.min(F.struct("source", "tokens")).alias("x")).select("key", "x.*"))
    rows = plan(counts, targets, total)
    planned = spark.createDataFrame(rows, "source string, target_share double, available long, allotted double, epochs double")
    u = F.pmod(F.xxhash64(F.col("key"), F.lit(seed)), F.lit(1 << 40))
    part = counts.join(F.broadcast(planned.select("source", "available", "epochs")), "source")
    part = part.withColumn("u", u).withColumn("slot", F.shiftright("u", 28).cast("int")).withColumn("extra", (F.col("epochs") - F.floor("epochs")) * F.col("available"))
    # the fraction is filled in the order of u: whole slots first, then record by record within the slot where it ends
    slots = part.groupBy("source", "slot").agg(F.sum("tokens").alias("slot_tokens"))
    slots = slots.withColumn("before", F.sum("slot_tokens").over(Window.partitionBy("source").orderBy("slot")) - F.col("slot_tokens"))
    part = part.join(slots, ["source", "slot"])
    split = (F.col("before") < F.col("extra")) & (F.col("before") + F.col("slot_tokens") > F.col("extra"))
    running = F.sum("tokens").over(Window.partitionBy("source").orderBy("u", "key")) - F.col("tokens") / 2
    columns = ["key", "source", "tokens", "epochs"]
    whole = part.where(~split).select(*columns, (F.col("before") + F.col("slot_tokens") <= F.col("extra")).alias("more"))
    ending = part.where(split).select(*columns, (F.col("before") + running <= F.col("extra")).alias("more"))
    repeats = (F.floor("epochs") + F.col("more").cast("int")).cast("int")
    mixed = whole.unionByName(ending).select(F.col("key").alias(key), "source", "tokens", repeats.alias("repeats")).where("repeats > 0")
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"))
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    report = planned.join(got, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0))).withColumn("actual_share", F.col("tokens") / whole)
    return mixed, report
