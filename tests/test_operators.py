import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textharbor.config import PLAIN, Crawler
from textharbor.functions import hashing, urls
from textharbor.functions.text import snippet_of
from textharbor.operators import authority, cluster, crawl, dedup, evaluate, rank, robots, spell
from textharbor.operators.cluster import Router
from textharbor.operators.index import IndexView
from textharbor.plans import search
from textharbor.plans.query import parse
from textharbor.sources import segments
from textharbor.sources.files import documents_from, markdown_body, markdown_title, query_ids, read_judgments, scan, text_document
from textharbor.sources.html import extract
from textharbor.sources.pages import documents_from_pages
from textharbor.streaming.ingest import append_generations

DOC = "doc_id long, title string, headings array<string>, body string, anchor_text array<string>, url string, metadata map<string,string>, timestamp long"


def docs_of(spark, bodies):
    return spark.createDataFrame([(i, "", [], b, [], f"t://{i}", {}, 0) for i, b in bodies.items()], DOC)


def found(spark, path, text):
    return sorted(r.doc_id for r in search.boolean(IndexView.of(segments.read_live(spark, path), PLAIN), parse(text, PLAIN)).collect())


def test_generations(spark, tmp_path):
    path = str(tmp_path / "index")
    segments.write_segment(docs_of(spark, {1: "alpha version one", 2: "gamma"}), path)
    segments.write_segment(docs_of(spark, {1: "beta version two", 3: "gamma"}), path)
    assert found(spark, path, "alpha") == [] and found(spark, path, "beta") == [1]
    assert segments.delete(path, 3) and not segments.delete(path, 3)
    assert found(spark, path, "gamma") == [2]
    before = sorted(map(str, segments.read_live(spark, path).select("doc_id", "body").collect()))
    assert segments.merge(spark, path) and segments.merge(spark, path) is None
    assert sorted(map(str, segments.read_live(spark, path).select("doc_id", "body").collect())) == before
    assert segments.Manifest.load(path).deleted == []


def test_random_operations_equal_a_rebuild(spark, tmp_path):
    rng, path, state = random.Random(11), str(tmp_path / "index"), {}
    gone = set()
    for _ in range(4):
        batch = {i: " ".join(rng.choice("abcdef") for _ in range(4)) for i in rng.sample(range(8), 3)}
        segments.write_segment(docs_of(spark, batch), path)
        state |= batch
        gone.add(i := rng.randrange(8))
        segments.delete(path, i)
    live = {i: b for i, b in state.items() if i not in gone}
    assert {r.doc_id: r.body for r in segments.read_live(spark, path).collect()} == live


@pytest.mark.parametrize("text", ["", "{", "[]", '{"generation": "x"}', '{"generation": 1}'])
def test_broken_manifest(tmp_path, text):
    (tmp_path / "manifest.json").write_text(text)
    with pytest.raises(segments.CorruptManifest):
        segments.Manifest.load(str(tmp_path))


def test_written_index_gives_the_same_answers(spark, tmp_path):
    docs = docs_of(spark, {1: "alpha beta", 2: "beta gamma", 3: "alpha gamma gamma"})
    view = IndexView.of(docs, PLAIN)
    segments.write_index(view, str(tmp_path / "i"))
    kept = segments.read_index(spark, str(tmp_path / "i"), docs, PLAIN)
    for text in ("alpha", '"beta gamma"', "NOT alpha"):
        assert sorted(search.boolean(kept, parse(text, PLAIN)).collect()) == sorted(search.boolean(view, parse(text, PLAIN)).collect())
        assert rank.top_k(kept, parse(text, PLAIN), 5).collect() == rank.top_k(view, parse(text, PLAIN), 5).collect()
    assert all(r.sound for r in segments.verify_index(spark, str(tmp_path / "i")).collect())
    scans = rank.top_k(kept, parse("alpha OR beta", PLAIN), 5)._jdf.queryExecution().executedPlan().toString()
    assert scans.count("FileScan parquet") == 1 and "EqualTo(field,2)" in scans.partition("PushedFilters:")[2] and "positions" not in scans.partition("ReadSchema:")[2]
    spark.createDataFrame([(0, "alpha", 1, [0], 9, 9, 1, 0)], spark.read.parquet(str(tmp_path / "i/postings")).schema).write.mode("append").parquet(str(tmp_path / "i/postings"))
    assert {r.table: r.sound for r in segments.verify_index(spark, str(tmp_path / "i")).collect()} == {"postings": False, "dictionary": True, "blocks": True, "doclen": True}
    (tmp_path / "i/statistics.json").unlink()
    with pytest.raises(segments.CorruptIndex):
        segments.read_index(spark, str(tmp_path / "i"))


def test_index_follows_the_segments(spark, tmp_path):
    path = str(tmp_path / "index")
    segments.write_segment(docs_of(spark, {1: "alpha", 2: "beta"}), path)
    ask = lambda: sorted(r.doc_id for r in search.boolean(segments.current_index(spark, path, PLAIN), parse("alpha", PLAIN)).collect())
    assert ask() == [1]
    segments.write_segment(docs_of(spark, {2: "alpha"}), path)
    assert ask() == [1, 2]
    segments.delete(path, 1)
    assert ask() == [2] and [r.readable for r in segments.verify_segments(spark, path).collect()] == [True, True]
    m = segments.Manifest.load(path)
    assert m.remove_segment(1) and not m.remove_segment(1) and m.clear_tombstones() == 1 and m.deleted == []


def test_segments_are_copied_once(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    segments.write_segment(docs_of(spark, {1: "alpha", 2: "beta"}), a)
    assert segments.copy_segments(spark, a, b) == 1 and segments.copy_segments(spark, a, b) == 0
    segments.write_segment(docs_of(spark, {2: "alpha"}), a)
    segments.delete(a, 1)
    assert segments.copy_segments(spark, a, b) == 1 and found(spark, b, "alpha") == [2] and segments.Manifest.load(b) == segments.Manifest.load(a)


def test_a_cluster_must_name_its_folder():
    from types import SimpleNamespace

    from textharbor.operators.lineage import shared_dir

    session = lambda name: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: name), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    assert shared_dir(session("hdfs://name/shared/")) == "hdfs://name/shared"
    with pytest.raises(RuntimeError):
        shared_dir(session(None))


def test_manifest_on_a_named_file_system(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    assert segments.Manifest.load(path).segments == []
    segments.write_segment(docs_of(spark, {1: "alpha"}), path)
    segments.write_segment(docs_of(spark, {2: "alpha"}), path)
    assert found(spark, path, "alpha") == [1, 2] and segments.Manifest.load(path).segments == [1, 2]


def test_streamed_batches_become_generations(spark, tmp_path):
    source = str(tmp_path / "in")
    docs_of(spark, {1: "one", 2: "two"}).withColumn("arrived_at", F.lit(1)).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    append_generations(stream, str(tmp_path / "index"), str(tmp_path / "check")).awaitTermination()
    docs_of(spark, {2: "changed"}).withColumn("arrived_at", F.lit(2)).write.mode("append").parquet(source)
    append_generations(stream, str(tmp_path / "index"), str(tmp_path / "check")).awaitTermination()
    assert {r.doc_id: r.body for r in segments.read_live(spark, str(tmp_path / "index")).collect()} == {1: "one", 2: "changed"}
    before = segments.Manifest.load(str(tmp_path / "index"))
    again = segments.write_segment(docs_of(spark, {2: "changed"}), str(tmp_path / "index"), batch=list(before.batches)[-1])
    assert again == before.segments[-1] and segments.Manifest.load(str(tmp_path / "index")) == before and len(before.batches) == 2


def test_hashes(spark):
    assert hashing.fnv1a(b"") == 0xCBF29CE484222325 and hashing.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    rows = spark.createDataFrame([("a",), ("",), (None,), ("foobar",)], "t string").select("t", hashing.fnv1a_hex("t").alias("h")).collect()
    assert {r.t: r.h for r in rows} == {"a": "af63dc4c8601ec8c", "": "cbf29ce484222325", None: None, "foobar": "85944171f73967e8"}
    assert spark.sql("SELECT hex(crc32('123456789')) AS h").first().h == "CBF43926"
    for v in (0, 127, 128, 300, 2**64 - 1):
        assert hashing.decode_varint(hashing.encode_varint(v)) == (v, len(hashing.encode_varint(v)))
    assert hashing.decode_varint(b"\x80") is None and hashing.decode_varint(b"\xff" * 10) is None
    values = [3, 7, 8, 100, 10_000, 2**40]
    row = spark.createDataFrame([(values,)], "v array<long>").select(hashing.encode_deltas(F.col("v")).alias("d"), hashing.decode_deltas(hashing.encode_deltas(F.col("v"))).alias("v")).first()
    assert row.d == [3, 4, 1, 92, 9900, 2**40 - 10_000] and row.v == values
    shards = spark.range(50).select("id", hashing.shard_of(F.col("id"), 4).alias("s")).collect()
    assert all(r.s == hashing.fnv1a(r.id.to_bytes(8, "little")) % 4 for r in shards)


def test_duplicates(spark):
    sentence = "the quick brown fox jumps over the lazy dog and sleeps " * 6
    near = sentence.split()
    near[17] = "cat"
    bodies = {1: sentence, 2: "  " + sentence.upper(), 3: " ".join(near), 4: "short text here", 5: "short text there", 6: "entirely other words " + " ".join(f"w{i}" for i in range(60))}
    got = {r.doc_id: r.outcome for r in dedup.near(docs_of(spark, bodies)).collect()}
    assert got == {1: "unique", 2: "exact_duplicate", 3: "near_duplicate", 4: "unique", 5: "unique", 6: "unique"}


def test_texts_of_one_hash_follow_their_first(spark, monkeypatch):
    """The second of two texts of one hash is no original when the first repeats an earlier text."""
    sims = {1: 0b1111111, 2: 0, 3: 0, 4: -1 << 40, 5: -1 << 40}
    prints = spark.createDataFrame([(i, f"h{i}", s, 30) for i, s in sims.items()], "doc_id long, hash string, sim long, words int")
    monkeypatch.setattr(dedup, "fingerprints", lambda docs, text: prints)
    got = {r.doc_id: r.outcome for r in dedup.near(prints).collect()}
    assert got == {1: "unique", 2: "near_duplicate", 3: "near_duplicate", 4: "unique", 5: "near_duplicate"}
    assert {r.outcome: r.n for r in dedup.counters(dedup.near(prints)).collect()} == {"unique": 2, "near_duplicate": 3}


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(6)]
    sims = [b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(10))) for b in base for _ in range(5)]
    signed = [s - (1 << 64) if s >> 63 else s for s in sims]
    rows = spark.createDataFrame([(i, s, 30) for i, s in enumerate(signed)], "doc_id long, sim long, words int")
    got = {(r.a, r.b) for r in dedup.near_pairs(rows).collect()}
    first = {s: sims.index(s) for s in sims}
    exp = {(i, j) for i, a in enumerate(sims) for j, b in enumerate(sims) if i < j and (a ^ b).bit_count() <= 7 and first[a] == i and (a == b or first[b] == j)}
    assert got == exp
    for blocks in (9, 10):
        assert {(r.a, r.b) for r in dedup.near_pairs(rows, blocks=blocks).collect()} == exp
    with pytest.raises(ValueError):
        dedup.near_pairs(rows, blocks=7)
    links = {r.doc_id: (r.representative, r.links) for r in dedup.classes(rows).collect()}
    for i, s in enumerate(sims):
        assert links[i] == (first[s], len({t for t in sims if t != s and (s ^ t).bit_count() <= 7}))
    assert dedup.near_pairs(rows.limit(0)).count() == 0


@pytest.mark.parametrize("large", [0, dedup.LARGE_BUCKET])
def test_every_bucket_gives_its_pairs_once(monkeypatch, large):
    monkeypatch.setattr(dedup, "LARGE_BUCKET", large)
    rng = random.Random(4)
    for blocks, distance in ((8, 7), (9, 7), (12, 11), (8, 0)):
        base = [rng.getrandbits(64) for _ in range(5)]
        sims = sorted({b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(distance + 3))) for b in base for _ in range(20)})
        got, ends = [], [64 * i // blocks for i in range(blocks + 1)]
        for key, (low, high) in enumerate(zip(ends, ends[1:])):
            buckets = {}
            for i, s in enumerate(sims):
                buckets.setdefault(s >> low & (1 << high - low) - 1, []).append(i)
            for own in buckets.values():
                for x, y, dist in dedup.bucket_pairs(np.array([sims[i] for i in own], dtype=np.uint64), key, blocks, distance):
                    got += [(*sorted((own[a], own[b])), int(d)) for a, b, d in zip(x, y, dist)]
        assert sorted(got) == [(i, j, (a ^ b).bit_count()) for i, a in enumerate(sims) for j, b in enumerate(sims) if i < j and (a ^ b).bit_count() <= distance]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_of_hashes_are_never_broadcast(spark):
    """The keys of a table of hashes are many times its size, which Spark's estimate does not count."""
    rows = spark.range(100).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("sim"), F.lit(30).alias("words"))
    assert "Broadcast" not in plan(dedup.near_pairs(rows))


def test_keys_of_texts_are_never_broadcast(spark):
    assert "Broadcast" not in plan(dedup.near_pairs(dedup.fingerprints(docs_of(spark, {i: f"text {i}" for i in range(20)}))))


def test_classes_of_hashes_are_never_broadcast(spark):
    rows = spark.range(100).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("sim"), F.lit(30).alias("words"))
    assert "Broadcast" not in plan(dedup.classes(rows))


def test_outcomes_of_texts_are_never_broadcast(spark):
    assert "Broadcast" not in plan(dedup.near(docs_of(spark, {i: f"text {i}" for i in range(20)})))


def test_simhash_of_many_texts():
    texts = ["", "one", "a b c d e f g", "wörter " * 40, *[" ".join(f"w{i * j % 17}" for j in range(i)) for i in range(2, 300, 7)]]

    def plain(text):
        words = text.split()
        if not words:
            return 0
        votes = [0] * 64
        for i in range(max(1, len(words) - 4)):
            h = int(hashing._mix(np.array([hashing.fnv1a(" ".join(words[i : i + 5]).encode())], dtype=np.uint64))[0])
            votes = [v + (1 if h >> b & 1 else -1) for b, v in enumerate(votes)]
        return sum(1 << b for b, v in enumerate(votes) if v > 0)

    assert [int(x) for x in hashing.simhash_many(texts)] == [plain(t) for t in texts]


def test_urls():
    assert urls.canonical("HTTP://Example.COM:80/a/./b/../c#frag") == "http://example.com/a/c" == urls.canonical("http://example.com/a/c")
    assert urls.canonical("ftp://x.y/") is None and urls.canonical("http://") is None and urls.canonical(None) is None and urls.canonical("https://x.y") == "https://x.y/"
    assert urls.canonical("https://x.y:8443/?q=1#f") == "https://x.y:8443/?q=1"
    assert urls.resolve("http://x.y/a/b", "../other") == "http://x.y/other" and urls.resolve("http://x.y/", "mailto:a@b") is None
    assert not urls.address_allowed("127.0.0.1") and not urls.address_allowed("10.1.2.3") and not urls.address_allowed("::1") and urls.address_allowed("8.8.8.8") and not urls.address_allowed("x")


def test_html():
    page = """<html><head><title> A  page </title><style>x{}</style><meta name=description content="said"><link rel=canonical href="/c"></head>
    <body><nav>menu</nav><h1>Head</h1><p>One <b>two</p><img src=i.png alt="pic"><a href="/l#x">link</a><a href="javascript:x">no</a><script>bad()</script><footer>foot</footer></body>"""
    got = extract("http://x.y/z", page)
    assert got["title"] == "A page" and got["headings"] == ["Head"] and got["links"] == [{"url": "http://x.y/l", "anchor": "link"}]
    assert "menu" not in got["body"] and "bad" not in got["body"] and "foot" not in got["body"] and got["body"].startswith("A page Head One two")
    assert got["image_alts"] == ["pic"] and got["canonical"] == "http://x.y/c" and got["description"] == "said"
    assert extract("http://x.y", '<meta property="og:description" content=" shared ">')["description"] == "shared"
    for bad in ("", "<", "<<<>>>", "<a href=", "<!--", "<p></b></p></p>", "<title>x", None):
        extract("http://x.y", bad)


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain text")
    (tmp_path / "b.MD").write_text("\n# Big *Title*\n```\ncode\n```\n- **item** one\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/c.html").write_text("<title>Web</title><p>hello<img alt='pic'></p>")
    (tmp_path / "d.bin").write_bytes(b"\0")
    files, skipped = scan(spark, str(tmp_path))
    got = {r.title: r for r in documents_from(files).collect()}
    assert skipped.first().n == 1 and got["a"].body == "plain text" and set(got) == {"a", "Big *Title*", "Web"}
    assert "code" in got["Big *Title*"].body and "```" not in got["Big *Title*"].body and "item one" in got["Big *Title*"].body
    assert got["Web"].body.endswith("\n\npic")


def test_judgments(spark, tmp_path):
    (tmp_path / "j.tsv").write_text("# comment\nq1\t3\ta.txt\n\nq1\t0\tb.txt\n")
    assert read_judgments(spark, str(tmp_path / "j.tsv")).count() == 2
    for bad, said in (("q1\tx\ta.txt\n", "(?i)malformed"), ("q1\t4\ta.txt\n", "bad grade"), ("\t2\ta.txt\n", "bad grade"), ("q1\t2\n", "(?i)bad grade|malformed")):
        (tmp_path / "bad.tsv").write_text(bad)
        with pytest.raises(Exception, match=said):
            read_judgments(spark, str(tmp_path / "bad.tsv")).collect()
    (tmp_path / "twice.tsv").write_text("q2\t3\ta.txt\nq1\t1\ta.txt\nq2\t1\ta.txt\n")
    twice = read_judgments(spark, str(tmp_path / "twice.tsv"))
    assert {(r.query_id, r.grade) for r in twice.collect()} == {("q1", 1), ("q2", 1)} and [r.query_id for r in query_ids(twice).collect()] == ["q1", "q2"]


def test_markdown_marks(spark):
    text = "## A **bold** head\n  - **item** `one`\n> said\n```\ncode\n```\n#\n"
    got = spark.createDataFrame([(text,)], "t string").select(markdown_title(F.col("t")).alias("title"), markdown_body(F.col("t")).alias("body")).first()
    assert got.title == "A **bold** head" and got.body.split("\n") == ["A **bold** head", "item one", "said", "code", "", ""]


def test_pages_as_documents(spark):
    pages = spark.createDataFrame(
        [("http://a/", "", ["h"], "text", [("http://b/", "to b"), ("http://c/", " ")], ["alt"], "said", ["http://a/1.png", "http://a/2.png"], "link:x", 5)],
        "url string, title string, headings array<string>, body string, links array<struct<url:string,anchor:string>>, image_alts array<string>, description string, image_srcs array<string>, crawl_source string, timestamp long",
    )
    r = documents_from_pages(pages).first()
    assert r.doc_id % (1 << 64) == hashing.fnv1a(b"http://a/") == int(r.id_hex, 16) and r.title == "http://a/" and r.anchor_text == ["to b"] and r.timestamp == 5
    assert r.metadata == {"crawl_source": "link:x", "outlinks": "http://b/\nhttp://c/", "image_refs": "http://a/1.png,http://a/2.png", "image_count": "2", "description": "said"}
    assert text_document(1, "f.txt", "t", "b")["url"] == "" and text_document(1, "f.txt", "t", "b")["source"]["value"] == "f.txt"


def test_robots(spark):
    body = "User-agent: *\nDisallow: /secret\nAllow: /secret/public\nDisallow: /*.php$\nCrawl-delay: 2\n\nUser-agent: other\nDisallow: /\n"
    asked = spark.createDataFrame([("h", p) for p in ("/", "/secret/x", "/secret/public/x", "/a.php", "/a.php.php", "/a.php5")] + [("none", "/secret")], "host string, path string")
    got = {(r.host, r.path): (r.allowed, r.delay_ms) for r in robots.allowed(asked, spark.createDataFrame([("h", body)], "host string, body string"), "me").collect()}
    assert {p: a for (h, p), (a, _) in got.items() if h == "h"} == {"/": True, "/secret/x": False, "/secret/public/x": True, "/a.php": False, "/a.php.php": False, "/a.php5": True}
    assert got["h", "/"][1] == 2000 and got["none", "/secret"] == (True, None)
    assert robots.parse(body, "Other bot")[0] == [(False, "^/", 1)]


def test_crawl(spark):
    pages = spark.createDataFrame(
        [("http://s/", "text/html", ["http://s/page2", "http://s/blocked", "http://s/pic", "http://far/x"]), ("http://s/page2", "TEXT/HTML; x", ["http://s/"]), ("http://s/blocked", "text/html", []), ("http://s/pic", "image/png", None), ("http://far/x", "text/html", [])],
        "url string, content_type string, links array<string>",
    )
    rules = spark.createDataFrame([("s", "User-agent: *\nDisallow: /blocked\n")], "host string, body string")
    start = spark.createDataFrame([("HTTP://S:80",), ("nonsense",)], "url string")
    got, log = crawl.crawl(start, pages, rules)
    assert sorted(r.url for r in got.collect()) == ["http://s/", "http://s/page2"]
    assert {r.outcome: r.n for r in log.collect()} == {"fetched": 2, "disallowed": 1, "not_html": 1}
    assert crawl.crawl(start, pages, None, Crawler(max_pages=1))[0].count() == 1 and crawl.crawl(start, pages, None, Crawler(max_depth=0))[0].count() == 1
    front = spark.createDataFrame([("http://a/1", "a", 50), ("http://a/2", "a", 100), ("http://b/1", "b", 10)], "url string, host string, priority int").selectExpr("*", "0L AS next_eligible_ms", "1 AS retries")
    assert [r.url for r in crawl.pop_order(front).collect()] == ["http://a/2", "http://b/1", "http://a/1"]
    assert crawl.retry_later(front, 5).first().next_eligible_ms == 4005 and crawl.priority(9) == 0
    starts = {r.url: r.start_ms for r in crawl.polite(front, spark.createDataFrame([("a", 3000.0)], "host string, delay_ms double")).collect()}
    assert starts == {"http://a/2": 0, "http://a/1": 3000, "http://b/1": 0}


def test_crawl_retries_and_duplicates(spark):
    text = " ".join(f"word{i}" for i in range(60))
    pages = spark.createDataFrame(
        [("http://s/", "text/html", ["http://s/a", "http://s/b", "http://s/c", "http://s/d"], "start", 0), ("http://s/a", "text/html", [], text, 2), ("http://s/b", "text/html", ["http://s/only"], text.upper() + " ", 0),
         ("http://s/c", "text/html", [], text + " more", 0), ("http://s/d", "text/html", [], "never", 9), ("http://s/only", "text/html", [], "from a duplicate", 0)],
        "url string, content_type string, links array<string>, body string, failures int",
    )
    got, log = crawl.crawl(spark.createDataFrame([("http://s/",)], "url string"), pages, None, Crawler(backoff_ms=1000, delay_ms=100))
    at = {r.url: r.at_ms for r in got.collect()}
    # a comes back after 1 and 2 seconds, when b, fetched before it, holds its text
    assert set(at) == {"http://s/", "http://s/b", "http://s/only"} and at["http://s/only"] >= 0
    assert {r.outcome: r.n for r in log.collect()} == {"fetched": 3, "retried": 5, "failed": 1, "near_duplicate": 1, "exact_duplicate": 1}


def test_frontier_is_kept(spark, tmp_path):
    front = crawl.seeds(spark.createDataFrame([("http://a/1",), ("http://a/2",)], "url string"))
    seen = front.select("url")
    links = crawl.queue_links(spark.createDataFrame([("http://a/1", 0, ["http://a/2", "http://a/3", "http://b/"])], "url string, depth int, links array<string>"), front.select("host").distinct())
    grown = crawl.push(front, links, seen)
    assert {(r.url, r.priority, r.depth) for r in grown.collect()} == {("http://a/1", 100, 0), ("http://a/2", 100, 0), ("http://a/3", 40, 1)}
    crawl.save_frontier(grown, seen, str(tmp_path / "f"))
    again, known = crawl.load_frontier(spark, str(tmp_path / "f"))
    assert crawl.sizes(again, known) == (3, 2) and crawl.next_wakeup(again) == 0 and crawl.next_wakeup(again.limit(0)) is None


def test_cluster_copies(spark, tmp_path):
    copies = cluster.layout(spark, 2, 2)
    up, notes = cluster.failover(copies, copies.where("node = 'node-0'").select("shard", "node"))
    assert {(r.shard, r.node) for r in up.collect()} == {(0, "node-1"), (1, "node-1")} and [(r.shard, r.node) for r in notes.collect()] == [(0, "node-0")]
    down, notes = cluster.failover(copies.withColumn("health", F.when(F.col("shard") == 1, "offline").otherwise("healthy")), copies.where("shard = 0").select("shard", "node"))
    assert down.count() == 0 and {(r.shard, r.note) for r in notes.collect() if r.node is None} == {(0, "all copies failed"), (1, "no healthy copy")}
    path = str(tmp_path / "s")
    cluster.write_sharded(docs_of(spark, {i: f"body {i}" for i in range(20)}).withColumn("seg", F.lit(1)), path, 3)
    shard = cluster.delete_sharded(spark, path, 7, 3)
    assert hashing.fnv1a((7).to_bytes(8, "little")) % 3 == shard and spark.read.parquet(path).count() == 19
    moved = cluster.move(copies, 0, "node-0", "node-5").where("shard = 0 AND node = 'node-5'").first()
    assert moved.generation == 1


def test_corrections_equal_the_plain_way(spark):
    rng = random.Random(5)
    terms = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(60)})
    v = spark.createDataFrame([(t, 1) for t in terms], "term string, df long")
    for term in ("abc", "cabba", "x"):
        assert sorted((r.term, r.dist) for r in spell.within(v, term, 2).collect()) == spell.naive_within(terms, term, 2)
    assert spell.did_you_mean(v, f"{terms[0]}x AND zzzzzz", PLAIN) == f"{terms[0]} AND zzzzzz" or terms[0] + "x" in terms


def test_canonical_urls_by_expressions(spark):
    some = ["HTTP://Example.COM:80/a/./b/../c#frag", "https://x.y", "https://x.y:443/a?b=1", "http://x.y:443/", "http://u@x.y/", "ftp://x", "", None, "http://x.y/a//b", "http://x.y/a/..", "HTTPS://WWW.A-b.C/p.html?q#f", "http://x.y/ü", "http://x.y?q=1", " http://x.y/ ", "http://x.y/a/b.c/d/"]
    rows = spark.createDataFrame([(u,) for u in some], "u string").select("u", urls.canonical_url("u").alias("c")).collect()
    assert {r.u: r.c for r in rows} == {u: urls.canonical(u) for u in some}


def test_pagerank(spark):
    edges = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 0), (2, 0), (3, 0), (1, 1), (1, 99)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in range(4)], "node long")
    got = {r.node: r.authority for r in authority.pagerank(nodes, edges).collect()}
    assert got[0] == 1 and got[1] == pytest.approx(got[2]) and 0 < got[1] < 1
    assert authority.pagerank(nodes.limit(0), edges).count() == 0


def test_spelling(spark):
    v = spark.createDataFrame([("organizer", 3), ("organize", 1), ("organized", 1), ("other", 9)], "term string, df long")
    best = spell.suggest(v, "organizar").collect()
    assert (best[0].term, best[0].dist) == ("organizer", 1)
    assert [r.term for r in spell.complete(v, "org").collect()] == ["organizer", "organize", "organized"]
    assert spell.did_you_mean(v, "organizar other", PLAIN) == "organizer other" and spell.did_you_mean(v, "other", PLAIN) is None and spell.did_you_mean(v, "(organizar)", PLAIN) is None
    assert spell.clamp(500, 100) == 100 and spell.clamp(0, 50) == 1


def test_metrics(spark):
    run = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("b", 9, 1)], "query_id string, doc_id long, rank int")
    judged = spark.createDataFrame([("a", 1, 3), ("a", 3, 1), ("a", 4, 2)], "query_id string, doc_id long, grade int")
    got = {r.query_id: r for r in evaluate.evaluate(run, run, judged, 2).collect()}
    assert got["a"].precision == 0.5 and got["a"].rr == 1 and got["a"].ap == pytest.approx((1 + 2 / 3) / 3) and got["a"].recall == pytest.approx(1 / 3)
    assert got["b"].ndcg == 1 and got["b"].recall == 1 and got["b"].ap == 1 and got["b"].rr == 0
    new = evaluate.evaluate(run, run.withColumn("rank", 4 - F.col("rank")), judged, 2)
    assert [r.change for r in evaluate.compare(evaluate.evaluate(run, run, judged, 2), new).collect()] == ["worse", "same"]
    samples = spark.createDataFrame([(float(i),) for i in range(1, 11)], "ms double")
    assert evaluate.latency(samples, "ms").first()[1:] == (5.0, 10.0, 10.0)


def test_snippets():
    text = snippet_of("an <b>organizer</b> of small drawers", "", frozenset(["organ"]), "porter", 200)
    assert "<mark>organizer</mark>" in text and "&lt;b&gt;" in text
    long = snippet_of("x " * 100 + "organizer" + " y" * 200, "", frozenset(["organ"]), "porter", 100)
    assert long.startswith("…") and long.endswith("…") and "<mark>organizer</mark>" in long
    assert snippet_of("", "The title", frozenset(["titl"]), "porter", 50) == "The <mark>title</mark>" and snippet_of(None, None, frozenset(), "none", 10) == ""


def test_router():
    turns = Router()
    assert [turns.pick(0, ["a", "b"]) for _ in range(3)] == ["a", "b", "a"]
    turns.failure(0, "a")
    assert turns.pick(0, ["a", "b"]) == "b" and turns.pick(0, ["a"]) is None
    turns.success(0, "a")
    least = Router(least_outstanding=True)
    assert [least.pick(0, ["a", "b"]), least.pick(0, ["a", "b"])] == ["a", "b"]
