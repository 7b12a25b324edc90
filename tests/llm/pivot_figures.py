"""What pivots leave of all pairs of texts, for the radius of ``history.repeats`` and for small ones: the figures of the README.

python tests/llm/pivot_figures.py DOCS.parquet [TEXTS]
"""

import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from textharbor.llm import history  # noqa: E402
from textharbor.llm.common import Hashes, hash_words  # noqa: E402


def left(n: np.ndarray, table: np.ndarray, radius) -> tuple[float, float]:
    """Shares of the pairs that lengths, and lengths and pivots, leave. radius: words, as a function of the longer text's length."""
    pairs = by_length = by_pivots = 0
    for i in range(len(n) - 1):
        r = radius(np.maximum(n[i], n[i + 1 :]))
        near = np.abs(n[i] - n[i + 1 :]) <= r
        pairs += len(near)
        by_length += near.sum()
        by_pivots += (near & (np.abs(table[i] - table[i + 1 :]).max(1) <= r)).sum()
    return by_length / pairs, by_pivots / pairs


def main(path: str, texts: int = 3000, pivots: int = history.PIVOTS) -> None:
    bodies = {b for b in pq.read_table(path, columns=["body"])["body"].to_pylist() if b and len(b.split()) >= history.MIN_WORDS}
    rng = random.Random(1)
    lists = [b.lower().split() for b in rng.sample(sorted(bodies), min(texts, len(bodies)))]
    n = np.array([len(x) for x in lists])
    seen = Hashes()
    hashes = [hash_words(x, seen) for x in lists]
    # halves of the vocabulary: their distance moves by up to 2 for a word, so half of it is compared
    halves = np.stack([[((h >> np.uint64(k + 3)) & np.uint64(1)).astype(int).sum() * 2 - len(h) for k in range(pivots)] for h in hashes]) / 2
    chosen = rng.sample(range(len(lists)), pivots)
    records = np.array([[max(len(x), len(lists[p])) - history.lcs(x, lists[p]) for p in chosen] for x in lists])
    bags = [Counter(x) for x in lists]
    of_bags = np.array([[max(len(x), len(lists[p])) - sum((bags[i] & bags[p]).values()) for p in chosen] for i, x in enumerate(lists)])
    print(f"{len(lists)} texts, {len(lists) * (len(lists) - 1) // 2} pairs, {pivots} pivots")
    for name, radius in (("a fifth of the longer text", lambda m: m * (1 - history.SHARE)), ("2 words", lambda m: np.full(len(m), 2))):
        for kind, table in (("halves of the vocabulary", halves), ("records, word distance", records), ("records, word bags", of_bags)):
            a, b = left(n, table, radius)
            print(f"{name}: lengths leave {a:.4f}, {kind} {b:.6f} of all pairs")


if __name__ == "__main__":
    main(sys.argv[1], *map(int, sys.argv[2:3]))
