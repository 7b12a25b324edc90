"""Shares of pairs that ``history.repeats`` never compares, by length and similarity: the table of the README.

Texts of random words, five ninths of them long; copies with scattered changed words. A pair is missed if no minimum is common: however many texts share a
minimum, all of its pairs are compared.

python tests/llm/missed_pairs.py [PAIRS]
"""

import random
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from textharbor.llm import history  # noqa: E402

SIZES, KEEPS = (40, 60, 100, 200, 400), (0.8, 0.85, 0.9)


def pair(rng: random.Random, size: int, keep: float) -> tuple[str, str]:
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.choice((2, 3, 3, 3, 4, 5, 6, 7, 8))))
    a = [word() for _ in range(size)]
    b = list(a)
    for at in rng.sample(range(size), int(size * (1 - keep) + 1e-9)):
        b[at] = word()
    return " ".join(a), " ".join(b)


def main(pairs: int = 2000) -> None:
    spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "16").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for size in SIZES:
        rng, rows = random.Random(size), []
        for k, keep in enumerate(KEEPS):
            for i in range(pairs):
                a, b = pair(rng, size, keep)
                rows += [(2 * (k * pairs + i), a, 0), (2 * (k * pairs + i) + 1, b, 1)]
        docs = spark.createDataFrame(rows, "doc_id long, body string, seg int").repartition(16)
        signs = history.signatures(docs, "doc_id", "body", "seg").select(F.floor(F.col("key") / 2).alias("pair"), "batch", F.explode("signs").alias("v"))
        met = signs.groupBy("pair", "v").agg(F.countDistinct("batch").alias("n")).where("n = 2").select("pair").distinct()
        found = {r.k: r.n for r in met.groupBy(F.floor(F.col("pair") / pairs).alias("k")).agg(F.count("*").alias("n")).collect()}
        print(f"| {size} | " + " | ".join(f"{1 - found.get(k, 0) / pairs:.4f}" for k in range(len(KEEPS))) + " |", flush=True)


if __name__ == "__main__":
    main(*map(int, sys.argv[1:2]))
