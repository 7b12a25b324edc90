"""Sharding: assignment, layout of copies, routing, partial answers, moves. The answers do not depend on the shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textharbor.config import Ranking
from textharbor.functions.hashing import shard_of
from textharbor.operators.index import IndexView, newest
from textharbor.operators.lineage import cut
from textharbor.operators.rank import scores
from textharbor.plans.query import Query

SERVABLE = ("healthy", "degraded")


def layout(spark: SparkSession, shards: int, replicas: int) -> DataFrame:
    """(shard, copy, node, generation, health): copy j of shard s lies on node (s + j) mod replicas."""
    grid = spark.range(shards).select(F.col("id").cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))).alias("copy"))
    node = F.concat(F.lit("node-"), ((F.col("shard") + F.col("copy")) % replicas).cast("string"))
    return grid.select("shard", "copy", node.alias("node"), F.lit(0).cast("bigint").alias("generation"), F.lit("healthy").alias("health"))


def served(copies: DataFrame) -> DataFrame:
    """(shard, node): the copy that answers for each shard that has one in service; least loaded first where ``outstanding`` is known."""
    load = F.col("outstanding") if "outstanding" in copies.columns else F.lit(0)
    rank = F.row_number().over(Window.partitionBy("shard").orderBy(load, "copy"))
    return copies.where(F.col("health").isin(*SERVABLE)).withColumn("r", rank).where("r = 1").select("shard", "node")


def unavailable(copies: DataFrame) -> DataFrame:
    return copies.groupBy("shard").agg(F.max(F.col("health").isin(*SERVABLE)).alias("up")).where(~F.col("up")).select("shard")


def heartbeat(copies: DataFrame, shard: int, node: str, generation: int, healthy: bool, at_ms: int) -> DataFrame:
    """The layout after a copy reported: its generation, its health and when it was heard of."""
    here = (F.col("shard") == shard) & (F.col("node") == node)
    if "last_heartbeat_ms" not in copies.columns:
        copies = copies.withColumn("last_heartbeat_ms", F.lit(0).cast("bigint"))
    new = {"generation": F.lit(generation).cast("bigint"), "health": F.lit("healthy" if healthy else "offline"), "last_heartbeat_ms": F.lit(at_ms).cast("bigint")}
    return copies.withColumns({c: F.when(here, v).otherwise(F.col(c)) for c, v in new.items()})


def silent(copies: DataFrame, now_ms: int, after_ms: int) -> DataFrame:
    """The layout with copies that were not heard of for so long set offline."""
    return copies.withColumn("health", F.when(F.col("last_heartbeat_ms") < now_ms - after_ms, "offline").otherwise(F.col("health")))


def failover(copies: DataFrame, broken: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(shard, node) of the first copy of each shard that opens, and (shard, node, note) of what was passed over. broken(shard, node): copies that do not open."""
    up = copies.where(F.col("health").isin(*SERVABLE))
    tried = up.withColumn("opens", F.lit(True)) if broken is None else up.join(broken.select("shard", "node", F.lit(False).alias("opens")), ["shard", "node"], "left").withColumn("opens", F.coalesce("opens", F.lit(True)))
    first = tried.where("opens").groupBy("shard").agg(F.min(F.struct("copy", "node")).alias("x")).select("shard", "x.copy", "x.node")
    chosen = first.select("shard", F.col("copy").alias("chosen"))
    passed = tried.where("NOT opens").join(chosen, "shard", "left").where("chosen IS NULL OR copy < chosen").select("shard", "node", F.lit("failed, next copy tried").alias("note"))
    lost = copies.select("shard").distinct().join(chosen, "shard", "left_anti").join(up.groupBy("shard").agg(F.count("*").alias("n")), "shard", "left")
    lost = lost.select("shard", F.lit(None).cast("string").alias("node"), F.when(F.col("n") > 0, "all copies failed").otherwise("no healthy copy").alias("note"))
    return first.select("shard", "node"), passed.unionByName(lost)


def report(copies: DataFrame, by: str = "shard") -> DataFrame:
    """(shard or node, copies, servable, lowest and highest generation)."""
    return copies.groupBy(by).agg(F.count("*").alias("copies"), F.sum(F.col("health").isin(*SERVABLE).cast("int")).alias("servable"), F.min("generation").alias("oldest"), F.max("generation").alias("newest"))


def write_sharded(docs: DataFrame, path: str, shards: int) -> None:
    """Documents as a table with one partition per shard; delivered again, a shard's partition is replaced."""
    rows = docs.withColumn("shard", shard_of(F.col("doc_id"), shards)).repartition(shards, "shard")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)


def delete_sharded(spark: SparkSession, path: str, doc_id: int, shards: int) -> int:
    """Take a document out: only its own shard's partition is read and written anew. Returns the shard."""
    shard = spark.range(1).select(shard_of(F.lit(doc_id), shards).alias("s")).first().s
    kept = cut(spark.read.parquet(path).where((F.col("shard") == shard) & (F.col("doc_id") != doc_id)))
    if kept.limit(1).count():
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    else:
        kept.drop("shard").write.mode("overwrite").parquet(f"{path}/shard={shard}")
    return shard


def merge_sharded(spark: SparkSession, path: str, shards: int) -> None:
    """Each shard's newest versions only, in one file."""
    rows = cut(newest(spark.read.parquet(path)).repartition(shards, "shard"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)


def set_health(copies: DataFrame, node: str, health: str) -> DataFrame:
    return copies.withColumn("health", F.when(F.col("node") == node, health).otherwise(F.col("health")))


def move(copies: DataFrame, shard: int, source: str, target: str) -> DataFrame:
    """The layout after a copy went to another node; its generation rises."""
    moved = (F.col("shard") == shard) & (F.col("node") == source)
    return copies.withColumns({"node": F.when(moved, target).otherwise(F.col("node")), "generation": F.col("generation") + moved.cast("bigint")})


def sharded_top_k(view: IndexView, query: Query, k: int, shards: int, copies: DataFrame | None = None, ranking: Ranking = Ranking(), digits: int = 4) -> DataFrame:
    """(doc_id, score, partial): top k of every shard by global statistics, merged. partial: a shard has no copy in service."""
    found = scores(view, query, ranking).withColumn("score", F.round("score", digits)).withColumn("shard", shard_of(F.col("doc_id"), shards))
    partial = F.lit(False)
    if copies is not None:
        up = F.broadcast(served(copies).select("shard"))  # as many rows as shards
        found = found.join(up, "shard", "left_semi")
        partial = F.lit(up.count() < shards)
    rank = F.row_number().over(Window.partitionBy("shard").orderBy(F.desc("score"), "doc_id"))
    local = found.withColumn("r", rank).where(F.col("r") <= k)
    return local.orderBy(F.desc("score"), "doc_id").limit(k).select("doc_id", "score", partial.alias("partial"))


def status(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, docs)."""
    return docs.groupBy(shard_of(F.col("doc_id"), shards).alias("shard")).agg(F.countDistinct("doc_id").alias("docs"))


class Router:
    """Round-robin or least-outstanding choice among copies in service, with the feedback of requests."""

    def __init__(self, least_outstanding: bool = False) -> None:
        self.least, self.turn, self.outstanding, self.failed, self.latency_ms = least_outstanding, {}, {}, set(), {}

    def pick(self, shard: int, nodes: list[str]) -> str | None:
        up = [n for n in nodes if (shard, n) not in self.failed]
        if not up:
            return None
        if self.least:
            node = min(up, key=lambda n: (self.outstanding.get(n, 0), n))
        else:
            self.turn[shard] = self.turn.get(shard, -1) + 1
            node = up[self.turn[shard] % len(up)]
        self.outstanding[node] = self.outstanding.get(node, 0) + 1
        return node

    def success(self, shard: int, node: str) -> None:
        self.outstanding[node] = max(0, self.outstanding.get(node, 0) - 1)
        self.failed.discard((shard, node))

    def failure(self, shard: int, node: str) -> None:
        self.outstanding[node] = max(0, self.outstanding.get(node, 0) - 1)
        self.failed.add((shard, node))

    def latency(self, shard: int, node: str, ms: float) -> None:
        """Keep how long the last answer took; routing does not look at it."""
        self.latency_ms[shard, node] = ms
