"""Crawling over a table of pages: rounds of frontier, admission, extraction, link expansion, politeness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textharbor.config import Crawler
from textharbor.functions.urls import canonical_url, host_of
from textharbor.operators.dedup import near
from textharbor.operators.lineage import cut
from textharbor.operators.robots import allowed

SEED_PRIORITY = 100


def priority(depth: int) -> int:
    """Priority of links found at a depth."""
    return max(0, 50 - 10 * depth)


def seeds(urls: DataFrame) -> DataFrame:
    """(url, host, priority, depth, retries, next_eligible_ms) of the addresses that can be fetched."""
    rows = urls.select(canonical_url("url").alias("url")).where("url IS NOT NULL").distinct()
    return rows.select("url", host_of(F.col("url")).alias("host"), F.lit(SEED_PRIORITY).alias("priority"), F.lit(0).alias("depth"), F.lit(0).alias("retries"), F.lit(0).cast("bigint").alias("next_eligible_ms"))


def pop_order(frontier: DataFrame, now_ms: int = 0) -> DataFrame:
    """Eligible rows in the order of fetching: hosts take turns, each by priority, time and url."""
    turn = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("priority"), "next_eligible_ms", "url"))
    return frontier.where(F.col("next_eligible_ms") <= now_ms).withColumn("turn", turn).orderBy("turn", F.desc("priority"), "next_eligible_ms", "url")


def retry_later(failed: DataFrame, now_ms: int, settings: Crawler = Crawler()) -> DataFrame:
    """Failed rows put back with doubled waits, those out of retries left out."""
    wait = F.lit(settings.backoff_ms) * F.pow(F.lit(2), F.least("retries", F.lit(4)))
    again = failed.where(F.col("retries") < settings.max_retries)
    return again.withColumn("next_eligible_ms", (now_ms + wait).cast("bigint")).withColumn("retries", F.col("retries") + 1)


def polite(fetches: DataFrame, delays: DataFrame, settings: Crawler = Crawler()) -> DataFrame:
    """When each fetch starts, in ms: a host's fetches are as far apart as its robots.txt or the settings ask, whichever is longer."""
    turn = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("priority"), "url")) - 1
    delay = F.greatest(F.coalesce("delay_ms", F.lit(0.0)), F.lit(float(settings.delay_ms)))
    return fetches.join(delays.select("host", "delay_ms"), "host", "left").withColumn("start_ms", (turn * delay).cast("bigint"))


def push(frontier: DataFrame, new: DataFrame, seen: DataFrame) -> DataFrame:
    """The frontier with the rows of ``new`` whose url was never seen; of rows of one url, that of the highest priority."""
    first = F.max_by(F.struct(*[c for c in frontier.columns if c != "url"]), F.col("priority")).alias("x")
    fresh = new.select(*frontier.columns).join(seen.select("url"), "url", "left_anti").groupBy("url").agg(first).select("url", "x.*")
    return frontier.unionByName(fresh.select(*frontier.columns))


def next_wakeup(frontier: DataFrame) -> int | None:
    """The earliest time at which a row may be fetched; None for an empty frontier."""
    return frontier.agg(F.min("next_eligible_ms").alias("t")).first().t


def save_frontier(frontier: DataFrame, seen: DataFrame, path: str) -> None:
    frontier.write.mode("overwrite").parquet(f"{path}/frontier")
    seen.select("url").write.mode("overwrite").parquet(f"{path}/seen")


def load_frontier(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(frontier, seen) as they were saved."""
    return spark.read.parquet(f"{path}/frontier"), spark.read.parquet(f"{path}/seen")


def sizes(frontier: DataFrame, seen: DataFrame) -> tuple[int, int]:
    """(rows pending, urls seen)."""
    return frontier.count(), seen.count()


def queue_links(fetched: DataFrame, hosts: DataFrame, settings: Crawler = Crawler()) -> DataFrame:
    """Frontier rows of the links of ``fetched(url, depth, links)``: within the seeds' hosts and the depth only."""
    links = fetched.where(F.col("depth") < settings.max_depth).select((F.col("depth") + 1).alias("depth"), F.explode("links").alias("link"))
    links = links.select(canonical_url("link").alias("url"), "depth").where("url IS NOT NULL").groupBy("url").agg(F.min("depth").alias("depth"))
    rows = links.withColumn("host", host_of(F.col("url"))).join(hosts, "host", "left_semi")
    by_depth = F.greatest(F.lit(0), 50 - 10 * F.col("depth")).cast("int")
    return rows.select("url", "host", by_depth.alias("priority"), F.col("depth").cast("int").alias("depth"), F.lit(0).alias("retries"), F.lit(0).cast("bigint").alias("next_eligible_ms"))


def crawl(start: DataFrame, pages: DataFrame, robots: DataFrame | None = None, settings: Crawler = Crawler(), agent: str = "textharbor") -> tuple[DataFrame, DataFrame]:
    """Documents fetched from ``pages(url, content_type, links[, body, failures])``, and (outcome, n).

    Each round takes all rows that are eligible at the time of the next wake-up, within the budget. Links lead on within the seeds' hosts only, up to
    the depth; every url is seen once. failures: so many fetches of the page fail before one succeeds; failed rows come back after
    doubled waits until they are out of retries. body: pages that repeat an earlier one exactly or nearly are no documents, and their links are not followed.

    Documents: (url, host, depth, at_ms), at_ms by the hosts' delays. outcome: fetched, exact_duplicate, near_duplicate, missing, not_html, disallowed, retried, failed, over_budget.
    """
    frontier = cut(seeds(start))
    hosts = cut(frontier.select("host").distinct())
    web = pages.withColumn("url", canonical_url("url")).where("url IS NOT NULL").dropDuplicates(["url"])
    web = web if "failures" in web.columns else web.withColumn("failures", F.lit(0))
    web = cut(web if "body" in web.columns else web.withColumn("body", F.lit(None).cast("string")))
    seen, log, done, accepted = cut(frontier.select("url")), None, 0, None
    while done < settings.max_pages and (now := next_wakeup(frontier)) is not None:
        due = cut(frontier.where(F.col("next_eligible_ms") <= now))
        later = frontier.where(F.col("next_eligible_ms") > now)
        asked = due.withColumn("path", F.coalesce(F.nullif(F.regexp_extract("url", r"^[^:]+://[^/]+(/.*)$", 1), F.lit("")), F.lit("/")))
        asked = allowed(asked, robots, agent) if robots is not None else asked.withColumn("allowed", F.lit(True)).withColumn("delay_ms", F.lit(None).cast("double"))
        got = asked.join(web, "url", "left")
        html = F.lower(F.coalesce("content_type", F.lit(""))).startswith("text/html")
        fails = F.coalesce("failures", F.lit(0)) > F.col("retries")
        outcome = (
            F.when(~F.col("allowed"), "disallowed").when(F.col("content_type").isNull(), "missing")
            .when(fails, F.when(F.col("retries") < settings.max_retries, "retried").otherwise("failed"))
            .when(~html, "not_html").otherwise("fetched")
        )
        got = cut(got.select("url", "host", "priority", "depth", "retries", "next_eligible_ms", "delay_ms", "links", "body", outcome.alias("outcome")))
        fetched = got.where("outcome = 'fetched'")
        unique = fetched
        if fetched.where("body IS NOT NULL").limit(1).count():
            # documents of earlier rounds come first, then this round's in the order of fetching
            ids = pop_order(fetched, now).select("url", "body", F.col("turn").alias("t"), F.lit(1).alias("round"))
            both = ids if accepted is None else accepted.select("url", "body", F.lit(0).alias("t"), F.lit(0).alias("round")).unionByName(ids)
            order = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("round", "t", "url"))  # a frontier's documents: within the page budget
            both = cut(both.withColumn("doc_id", order.cast("bigint")))
            outcomes = near(both).join(both.select("doc_id", "url", "round"), "doc_id").where("round = 1").select("url", F.col("outcome").alias("dup"))
            got = cut(got.join(outcomes, "url", "left").withColumn("outcome", F.when(F.col("dup").isNotNull() & (F.col("dup") != "unique"), F.col("dup")).otherwise(F.col("outcome"))).drop("dup"))
            unique = got.where("outcome = 'fetched'")
        room, n = settings.max_pages - done, unique.count()
        if n > room:
            keep = pop_order(unique, now).limit(room).select("url", F.lit(True).alias("kept"))
            got = cut(got.join(keep, "url", "left").withColumn("outcome", F.when((F.col("outcome") == "fetched") & F.col("kept").isNull(), "over_budget").otherwise(F.col("outcome"))).drop("kept"))
            unique = got.where("outcome = 'fetched'")
        done += min(n, room)
        at = polite(unique.select("url", "host", "priority"), got.groupBy("host").agg(F.max("delay_ms").alias("delay_ms")), settings).select("url", (F.col("start_ms") + now).alias("at_ms"))
        rows = cut(got.select("url", "host", "depth", "outcome").join(at, "url", "left"))
        log = rows if log is None else log.unionByName(rows)
        accepted = unique.select("url", "body") if accepted is None else accepted.unionByName(unique.select("url", "body"))
        again = retry_later(got.where("outcome = 'retried'").select(*frontier.columns), now, settings)
        grown = push(later.unionByName(again.select(*frontier.columns)), queue_links(unique, hosts, settings), seen)
        frontier = cut(grown)
        seen = cut(seen.unionByName(frontier.select("url")).distinct())
    return log.where("outcome = 'fetched'").select("url", "host", "depth", "at_ms"), log.groupBy("outcome").agg(F.count("*").alias("n"))
