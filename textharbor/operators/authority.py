"""Link authority: the graph of documents and its PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from textharbor.operators.lineage import cut


def link_graph(docs: DataFrame) -> DataFrame:
    """(src, dst): distinct links between documents, from metadata['outlinks'], none to itself."""
    out = docs.select(F.col("doc_id").alias("src"), F.explode(F.split(F.col("metadata")["outlinks"], "\n")).alias("url")).where("url <> ''")
    known = docs.where("url <> ''").select(F.col("doc_id").alias("dst"), "url")
    return out.join(known, "url").where("src <> dst").select("src", "dst").distinct()


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 20) -> DataFrame:
    """(node, authority): PageRank with a fixed number of rounds, scaled so that the highest is 1.

    Nodes without links spread their rank evenly; their sum is observed as a round is written, so each round is one job. Links are partitioned by source
    once; a round shuffles one row per node and target. ``nodes(node)`` bounds the graph: links from or to elsewhere are left out.
    """
    if not 0 <= damping < 1:
        raise ValueError("damping must be at least 0 and under 1")
    iterations = max(1, min(1000, iterations))
    nodes = cut(nodes.select("node").distinct())
    inside = edges.where("src <> dst").join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi").distinct()
    inside = cut(inside)
    degree = inside.groupBy("src").agg(F.count("*").alias("degree"))
    n = nodes.count()
    if n == 0:
        return nodes.withColumn("authority", F.lit(0.0))
    links = inside.join(degree, "src").select("src", "dst", "degree").repartition("src").persist()
    seen = Observation()
    loose_sum = F.sum(F.when(F.col("degree").isNull(), F.col("rank")))
    ranks = cut(nodes.join(degree.withColumnRenamed("src", "node"), "node", "left").withColumn("rank", F.lit(1.0 / n)), seen, loose=loose_sum)
    for _ in range(iterations):
        base = (1 - damping) / n + damping * (seen.get["loose"] or 0.0) / n  # known since the last round was written
        given = links.join(ranks.select(F.col("node").alias("src"), "rank"), "src").groupBy("dst").agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))
        ranks = ranks.select("node", "degree").join(given.withColumnRenamed("dst", "node"), "node", "left")
        ranks = ranks.select("node", "degree", (base + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        seen = Observation()
        ranks = cut(ranks, seen, loose=loose_sum)  # one row per node
    links.unpersist()
    top = ranks.agg(F.max("rank").alias("top")).first().top
    return ranks.select("node", F.when(F.lit(top) > 0, F.col("rank") / F.lit(top)).otherwise(0.0).alias("authority"))


def with_authority(docs: DataFrame, ranks: DataFrame) -> DataFrame:
    """Documents with metadata['authority'] set, six digits: the rows of a new generation."""
    value = F.format_string("%.6f", F.coalesce("authority", F.lit(0.0)))
    joined = docs.join(ranks.withColumnRenamed("node", "doc_id"), "doc_id")
    others = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: k != "authority")
    return joined.withColumn("metadata", F.map_concat(others, F.create_map(F.lit("authority"), value))).drop("authority")
