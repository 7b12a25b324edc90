"""Command line: index, stats, verify, merge, delete, authority, search, complete, eval, crawl, cluster, shard, node, bench, serve."""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from textharbor.config import Config
from textharbor.functions.text import snippet
from textharbor.operators import authority, cluster, crawl, evaluate, rank, spell
from textharbor.operators.index import IndexView, newest
from textharbor.plans.query import InvalidQuery, parse, words_query
from textharbor.plans.search import boolean
from textharbor.sources import files, segments
from textharbor.sources.pages import documents_from_pages, numeric_id
from textharbor.sources.store import read_text, write_text


def _docs_from(spark: SparkSession, root: str):
    found, skipped = files.scan(spark, root)
    docs = files.documents_from(found)
    return docs.select(numeric_id(F.col("id_hex")).alias("doc_id"), "*").drop("id_hex"), skipped.first().n


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textharbor", description=__doc__)
    p.add_argument("--data", default="index", help="folder of the index")
    p.add_argument("--config", help="TOML file")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("index").add_argument("corpus")
    for name in ("stats", "verify", "merge"):
        sub.add_parser(name)
    a = sub.add_parser("authority")
    a.add_argument("--damping", type=float, default=0.85)
    a.add_argument("--iterations", type=int, default=50)
    sub.add_parser("delete").add_argument("doc_id", type=int)
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("-k", type=int, default=20)
    s.add_argument("--explain", action="store_true")
    s.add_argument("--all", action="store_true", help="every document with all words, unranked")
    c = sub.add_parser("complete")
    c.add_argument("prefix")
    c.add_argument("-n", type=int, default=8)
    e = sub.add_parser("eval")
    e.add_argument("queries")
    e.add_argument("judgments")
    e.add_argument("--save")
    e.add_argument("--baseline", help="a report saved before")
    w = sub.add_parser("crawl")
    w.add_argument("seeds", nargs="+")
    w.add_argument("--pages", required=True, help="Parquet table of pages: url, content_type and the extracted fields")
    g = sub.add_parser("cluster")
    g.add_argument("op", choices=("init", "index", "search", "status", "merge", "delete"))
    g.add_argument("what", nargs="?")
    g.add_argument("--shards", type=int, default=4)
    g.add_argument("--replicas", type=int, default=2)
    h = sub.add_parser("shard")
    h.add_argument("op", choices=("list", "move"))
    h.add_argument("rest", nargs="*", help="move: shard, node it leaves, node it goes to")
    sub.add_parser("node")
    b = sub.add_parser("bench")
    b.add_argument("--rounds", type=int, default=3)
    b.add_argument("queries", nargs="+")
    v = sub.add_parser("serve")
    v.add_argument("--port", type=int, default=8080)
    v.add_argument("--token")
    return p


def _layout(spark: SparkSession, data: str):
    """The cluster's layout and number of shards, None where there is none."""
    text = read_text(f"{data}/topology.json")
    if text is None:
        return None, 0
    kept = json.loads(text)
    return spark.createDataFrame([tuple(x) for x in kept["copies"]], "shard int, copy int, node string, generation long, health string"), kept["shards"]


def _keep_layout(copies, shards: int, data: str) -> None:
    rows = [list(r) for r in copies.select("shard", "copy", "node", "generation", "health").orderBy("shard", "copy").collect()]  # one row per copy
    write_text(f"{data}/topology.json", json.dumps({"shards": shards, "copies": rows}))


def _print_hits(best, docs) -> list:
    rows = best.join(docs.select("doc_id", "title", "url"), "doc_id").orderBy(F.desc("score"), "doc_id").collect()
    for r in rows:
        print(f"{r.score:.4f}  {r.doc_id}  {r.title}  {r.url}")
    return rows


def _cluster(args: argparse.Namespace, spark: SparkSession, config: Config) -> int:
    copies, shards = _layout(spark, args.data)
    if args.op == "init":
        copies = cluster.layout(spark, args.shards, args.replicas)
        _keep_layout(copies, args.shards, args.data)
        print(f"{args.shards} shards, {args.replicas} copies of each")
        return 0
    if copies is None:
        print("no cluster here; begin with cluster init", file=sys.stderr)
        return 1
    where = f"{args.data}/sharded"
    if args.op == "index":
        docs, skipped = _docs_from(spark, args.what)
        cluster.write_sharded(docs.withColumn("seg", F.lit(0)), where, shards)
        print(f"{shards} shards written, {skipped} files skipped")
    elif args.op == "merge":
        cluster.merge_sharded(spark, where, shards)
        print(f"{shards} shards merged")
    elif args.op == "delete":
        print(f"deleted from shard {cluster.delete_sharded(spark, where, int(args.what), shards)}")
    elif args.op == "status":
        docs = spark.read.parquet(where).groupBy("shard").agg(F.countDistinct("doc_id").alias("docs"))
        cluster.report(copies).join(docs, "shard", "left").orderBy("shard").show(1000, False)
        for r in cluster.failover(copies)[1].collect():
            print(f"shard {r.shard}: {r.note}")
    else:
        docs = newest(spark.read.parquet(where))
        view = IndexView.of(docs, config.analysis)
        best = cluster.sharded_top_k(view, parse(args.what, config.analysis), 20, shards, copies, config.ranking)
        if any(r.partial for r in best.select("partial").limit(1).collect()):
            print("partial: a shard has no copy in service")
        _print_hits(best, docs)
    return 0


def run(argv: list[str], spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("textharbor").getOrCreate()
    config = Config.from_toml(Path(args.config).read_text()) if args.config else Config()
    if args.command == "index":
        docs, skipped = _docs_from(spark, args.corpus)
        seg = segments.write_segment(docs, args.data)
        segments.current_index(spark, args.data, config.analysis)  # postings, dictionary and bounds, which searches read
        print(f"segment {seg} written, {skipped} files skipped")
        return 0
    if args.command == "delete":
        print("deleted" if segments.delete(args.data, args.doc_id) else "was deleted before")
        return 0
    if args.command == "merge":
        seg = segments.merge(spark, args.data)
        print("nothing to merge" if seg is None else f"merged as segment {seg}")
        return 0
    if args.command == "stats":
        segments.segment_report(segments.read_docs(spark, args.data)).show()
        return 0
    if args.command == "verify":
        found = segments.verify_segments(spark, args.data).collect()
        for r in found:
            print(f"segment {r.seg}: {r.rows} rows" if r.readable else f"segment {r.seg}: cannot be read")
        return 0 if all(r.readable for r in found) else 1
    if args.command == "cluster":
        return _cluster(args, spark, config)
    if args.command in ("shard", "node"):
        copies, shards = _layout(spark, args.data)
        if copies is None:
            print("no cluster here; begin with cluster init", file=sys.stderr)
            return 1
        if args.command == "shard" and args.op == "move":
            shard, source, target = args.rest
            _keep_layout(cluster.move(copies, int(shard), source, target), shards, args.data)
            copies, _ = _layout(spark, args.data)
        cluster.report(copies, args.command).orderBy(args.command).show(1000, False)
        return 0
    if args.command == "crawl":
        pages = spark.read.parquet(args.pages)
        start = spark.createDataFrame([(u,) for u in args.seeds], "url string")
        links = F.transform(F.coalesce("links", F.array().cast("array<struct<url:string,anchor:string>>")), lambda x: x["url"])
        got, log = crawl.crawl(start, pages.select("url", "content_type", links.alias("links"), "body"), settings=config.crawler)
        docs = documents_from_pages(pages.join(got.select("url"), "url", "left_semi")).drop("id_hex").dropDuplicates(["doc_id"])
        print(f"segment {segments.write_segment(docs, args.data)} written")
        for r in log.orderBy("outcome").collect():
            print(f"{r.outcome}: {r.n}")
        return 0
    if args.command == "authority":
        docs = segments.read_live(spark, args.data)
        ranks = authority.pagerank(docs.select(F.col("doc_id").alias("node")), authority.link_graph(docs), args.damping, args.iterations)
        print(f"segment {segments.write_segment(authority.with_authority(docs, ranks), args.data)} written")
        return 0
    view = segments.current_index(spark, args.data, config.analysis)
    docs = view.docs
    if args.command == "serve":
        from textharbor.api import Service, serve

        serve(Service(view, config, args.token, segments.Manifest.load(args.data).generation), args.port).serve_forever()
        return 0
    if args.command == "bench":
        times = []
        for _ in range(args.rounds):
            for q in args.queries:
                began = time.time()
                rank.top_k(view, parse(q, config.analysis), 20, config.ranking).collect()
                times.append(((time.time() - began) * 1000,))
        r = evaluate.latency(spark.createDataFrame(times, "ms double"), "ms").first()
        print(json.dumps({"queries": len(times), "qps": round(1000 * len(times) / sum(t for t, in times), 2), **{k: round(v, 1) for k, v in r.asDict().items()}}))
        return 0
    if args.command == "complete":
        for r in spell.complete(spell.all_fields(view.termstats()), args.prefix, spell.clamp(args.n, 100)).collect():
            print(r.term, r.df)
        return 0
    if args.command == "eval":
        rows = []
        for q in files.read_queries(spark, args.queries).collect():
            best = rank.top_k(view, parse(q.text, config.analysis, config.query.max_query_terms), 100, config.ranking).collect()
            rows += [(q.query_id, r.doc_id, i + 1) for i, r in enumerate(best)]
        run_ = spark.createDataFrame(rows, "query_id string, doc_id long, rank int")
        names = docs.select("doc_id", F.element_at(F.split("url", "/"), -1).alias("doc"))
        judged = files.read_judgments(spark, args.judgments).join(names, "doc").select("query_id", "doc_id", "grade")
        asked = files.read_queries(spark, args.queries).select("query_id")
        report = evaluate.evaluate(asked, run_, judged).orderBy("query_id")
        found = evaluate.means(report).first().asDict()
        print(json.dumps(found))
        if args.save:
            Path(args.save).write_text(json.dumps({"means": found, "queries": [r.asDict() for r in report.collect()]}))
        if args.baseline:
            before = spark.createDataFrame(json.loads(Path(args.baseline).read_text())["queries"], report.schema)
            changes = evaluate.compare(before, report).collect()
            for r in changes:
                print(f"{r.query_id}  {r.delta:+.4f}  {r.change}")
            return 1 if any(r.change == "worse" for r in changes) else 0
        return 0
    try:
        query = parse(args.query, config.analysis, config.query.max_query_terms)
    except InvalidQuery as e:
        print(f"invalid query: {e}", file=sys.stderr)
        return 2
    k = spell.clamp(args.k, 100)
    if args.all:
        words = words_query(config.analysis, None, args.query)
        for r in boolean(view, words).join(docs.select("doc_id", "title", "url"), "doc_id").orderBy("doc_id").toLocalIterator():
            print(f"{r.doc_id}  {r.title}  {r.url}")
        return 0
    rows = _print_hits(rank.top_k(view, query, k, config.ranking), docs)
    if args.explain:
        rank.explained(view, query, k, config.ranking).orderBy("doc_id", "field", "term").show(1000, False)
        rank.field_scores(view, query, k, config.ranking).orderBy(F.desc("score"), "doc_id", "field").show(1000, False)
    if not rows and (better := spell.did_you_mean(spell.all_fields(view.termstats()), args.query, config.analysis)):
        print(f"did you mean: {better}")
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
