"""Relevance metrics over a run and graded judgments, and comparison of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = 1e-9


def gain(grade: Column) -> Column:
    """0, 1, 3, 7 for grades 0 to 3."""
    return F.pow(F.lit(2.0), grade) - 1


def ranked(run: DataFrame) -> DataFrame:
    """``run(query_id, doc_id, score)`` with rank by score, ties by doc_id."""
    return run.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))


def evaluate(queries: DataFrame, run: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg, precision, recall, ap, rr) of every query of ``queries(query_id)``.

    run(query_id, rank, doc_id), judged(query_id, doc_id, grade). Unjudged is 0, grade 1 or more is relevant. Precision divides by k even if
    fewer came; without relevant documents nDCG, recall and AP are 1.
    """
    by_grade = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id"))
    ideal = judged.withColumn("i", by_grade).groupBy("query_id").agg(
        F.sum(F.when(F.col("i") <= k, gain(F.col("grade")) / F.log2(F.col("i") + 1)).otherwise(0.0)).alias("ideal"), F.sum((F.col("grade") >= 1).cast("int")).alias("relevant")
    )
    hits = run.join(judged, ["query_id", "doc_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0))).withColumn("rel", (F.col("grade") >= 1).cast("int"))
    so_far = F.sum("rel").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hits = hits.withColumn("so_far", so_far)
    top = F.col("rank") <= k
    got = hits.groupBy("query_id").agg(
        F.sum(F.when(top, gain(F.col("grade")) / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(top, F.col("rel")).otherwise(0)).alias("found"),
        F.sum(F.when(F.col("rel") == 1, F.col("so_far") / F.col("rank")).otherwise(0.0)).alias("precisions"),
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"),
    )
    rows = queries.select("query_id").distinct().join(ideal, "query_id", "left").join(got, "query_id", "left").fillna(0, ["ideal", "relevant", "dcg", "found", "precisions"])
    one_if_none = lambda base, value: F.when(F.col(base) > 0, value).otherwise(1.0)
    return rows.select(
        "query_id",
        one_if_none("ideal", F.col("dcg") / F.col("ideal")).alias("ndcg"),
        (F.col("found") / k).alias("precision"),
        one_if_none("relevant", F.col("found") / F.col("relevant")).alias("recall"),
        one_if_none("relevant", F.col("precisions") / F.col("relevant")).alias("ap"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"),
    )


def means(report: DataFrame) -> DataFrame:
    return report.agg(*[F.avg(c).alias(c) for c in ("ndcg", "precision", "recall", "ap", "rr")])


def compare(old: DataFrame, new: DataFrame, metric: str = "ndcg") -> DataFrame:
    """(query_id, delta, change) of two reports, worst first."""
    both = old.select("query_id", F.col(metric).alias("a")).join(new.select("query_id", F.col(metric).alias("b")), "query_id", "full")
    delta = F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0))
    change = F.when(delta < -TOLERANCE, "worse").when(delta > TOLERANCE, "better").otherwise("same")
    return both.select("query_id", delta.alias("delta"), change.alias("change")).orderBy("delta", "query_id")


def latency(samples: DataFrame, column: str) -> DataFrame:
    """Mean, p50, p95 and p99 by nearest rank."""
    q = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})").alias(f"p{round(p * 100)}") for p in (0.5, 0.95, 0.99)]
    return samples.agg(F.avg(column).alias("mean"), *q)
