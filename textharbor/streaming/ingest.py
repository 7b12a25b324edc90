"""Streams of documents as index generations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textharbor.sources.segments import write_segment


def newest_in_batch(batch: DataFrame, order: str) -> DataFrame:
    """The last delivery of each document of a batch."""
    best = F.max_by(F.struct(*batch.columns), F.col(order)).alias("x")
    return batch.groupBy("doc_id").agg(best).select("x.*")


def append_generations(stream: DataFrame, index: str, checkpoint: str, order: str = "arrived_at") -> StreamingQuery:
    """Every micro-batch becomes a segment; later segments shadow earlier versions of their documents.

    The manifest remembers the batch, so one that is sent again after a failure is not written twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        if batch.limit(1).count():
            write_segment(newest_in_batch(batch, order), index, batch=f"{query}/{number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(stream: DataFrame, at: str = "arrived_at", window: str = "1 day", late: str = "7 days") -> DataFrame:
    """(window_start, seg, docs): documents per batch and arrival window; rows later than the watermark are left out."""
    counted = stream.withWatermark(at, late).groupBy(F.window(at, window), "seg").agg(F.count("*").alias("docs"))
    return counted.select(F.col("window.start").alias("window_start"), "seg", "docs")
