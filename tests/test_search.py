import itertools
import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from textharbor.config import PLAIN, UNSTEMMED, Analysis, Ranking
from textharbor.functions.analysis import analyze
from textharbor.operators import rank
from textharbor.operators.cache import ResultCache
from textharbor.operators.cluster import layout, set_health, sharded_top_k
from textharbor.operators.index import IndexView, block_of
from textharbor.plans import search
from textharbor.plans.query import And, Fuzzy, InvalidQuery, MatchAll, MatchNothing, Not, Or, Phrase, Prefix, Site, Term, parse
from textharbor.sources import segments

SCHEMA = "doc_id long, title string, headings array<string>, body string, anchor_text array<string>, url string, metadata map<string,string>, timestamp long, seg int"


def make(spark, rows):
    return spark.createDataFrame([(i, t, h, b, a, u, m, ts, 0) for i, t, h, b, a, u, m, ts in rows], SCHEMA)


def small(spark, rows):
    return make(spark, [(i, t, [], b, [], f"t://{i}", {}, 0) for i, t, b in rows])


@pytest.fixture(scope="module")
def harvesters(spark):
    docs = small(spark, [(1, "harvester drawing", "harvester calibration routes"), (2, "translator manual", "phrasebook translator circles"), (3, "harvester engine", "diesel fuel mixture")])
    return IndexView.of(docs, PLAIN).cached()


def ids(df):
    return sorted(r.doc_id for r in df.collect())


@pytest.mark.parametrize(
    "text, expected",
    [
        ("harvester calibration", [1]), ("harvester OR translator", [1, 2, 3]), ("harvester NOT diesel", [1]), ("body:harvester", [1]), ("title:harvester", [1, 3]),
        ("NOT harvester", [2]), ("harv*", [1, 3]), ("harvestar~1", [1, 3]), ("harvestxr~", [1, 3]), ("hrvestar~2", [1, 3]), ("site:t://1", [1]), ("site:T://1 OR phrasebook", [1, 2]), ('"translator circles"', [2]), ('"circles translator"', []),
        ("nonexistent", []), ("", []), ("title:", []), ('title:"harvester drawing"', [1]), ("(harvester OR phrasebook) NOT (calibration OR engine)", [2]), ("harvester OR NOT phrasebook", [1, 3]), ("a~3", []),
    ],
)
def test_boolean(harvesters, text, expected):
    assert ids(search.boolean(harvesters, parse(text, PLAIN))) == expected


def test_identities(harvesters):
    assert ids(search.boolean(harvesters, MatchAll())) == [1, 2, 3]
    for nothing in (MatchNothing(), And(()), Or(())):
        assert ids(search.boolean(harvesters, nothing)) == []
    assert ids(search.boolean(harvesters, Not(And(())))) == [1, 2, 3]


def test_stop_words_match_nothing_and_break_phrases(spark):
    view = IndexView.of(small(spark, [(1, "x", "the end of the week"), (2, "x", "end week")]), UNSTEMMED)
    assert ids(search.boolean(view, parse("the week", UNSTEMMED))) == []
    assert ids(search.boolean(view, parse('"end of week"', UNSTEMMED))) == [2]


def test_parser():
    term = lambda t: Or(tuple(Term(f, t) for f in range(4)))
    assert parse("a OR b AND c", PLAIN) == Or((term("a"), And((term("b"), term("c")))))
    assert parse("NOT x (y OR z)", PLAIN) == And((Not(term("x")), Or((term("y"), term("z")))))
    assert parse('h:big* "a b" site:X.Y body:q~2', PLAIN) == And((Prefix(1, "big"), Phrase(2, ("a", "b")), Site("x.y"), Fuzzy(2, "q", 2)))
    assert parse('title:"a b"', PLAIN, scoped_phrases=False) == And((MatchNothing(), Phrase(2, ("a", "b"))))
    assert parse("the", UNSTEMMED) == MatchNothing() and parse("  ", PLAIN) == MatchNothing()
    assert parse("databases*", Analysis()) == Prefix(None, "databas")
    for bad in ("(a", "a)", "harvester and", "OR", "NOT"):
        with pytest.raises(InvalidQuery):
            parse(bad, PLAIN)
    with pytest.raises(InvalidQuery):
        parse("a b c d", PLAIN, max_terms=15)


def test_parser_survives_garbage():
    rng = random.Random(7)
    for _ in range(500):
        text = "".join(rng.choice('ab ()":*~ANDORNOT|site:título12') for _ in range(rng.randrange(20)))
        try:
            parse(text, PLAIN)
        except InvalidQuery:
            pass


def oracle(docs, query):
    """Documents by scanning their analysed texts."""
    found = []
    for i, t, h, b, a, u, *_ in docs:
        fields = [dict(), dict(), dict(), dict()]
        for f, text in enumerate((t, "\n".join(h), b, "\n".join(a))):
            for term, p in analyze(text, PLAIN.of(f)):
                fields[f].setdefault(term, []).append(p)

        def holds(q):
            if isinstance(q, Term):
                return any(q.term in fields[f] for f in (range(4) if q.field is None else [q.field]))
            if isinstance(q, Phrase):
                return any(all(p + i in fields[q.field].get(t, []) for i, t in enumerate(q.terms)) for p in fields[q.field].get(q.terms[0], []))
            if isinstance(q, And):
                return all(map(holds, q.arms))
            if isinstance(q, Or):
                return any(map(holds, q.arms))
            return not holds(q.arm)

        if holds(query):
            found.append(i)
    return found


@pytest.fixture(scope="module")
def random_docs():
    rng = random.Random(11)
    words = "alpha beta gamma delta epsilon zeta".split()
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    return [(i, text(2), [text(1)], text(9), [text(1)], f"t://{i}", {"authority": str(rng.random())} if i % 3 else {}, rng.randrange(3) * 86400 * 30) for i in range(30)]


def test_boolean_agrees_with_scan(spark, random_docs):
    view = IndexView.of(make(spark, random_docs), PLAIN).cached()
    rng = random.Random(5)
    words = "alpha beta gamma delta epsilon zeta omega".split()

    def tree(depth):
        kind = rng.randrange(5 if depth else 2)
        if kind == 0:
            return Term(rng.choice([None, 0, 1, 2, 3]), rng.choice(words))
        if kind == 1:
            return Phrase(2, (rng.choice(words), rng.choice(words)))
        if kind == 4:
            return Not(tree(depth - 1))
        return (And if kind == 2 else Or)((tree(depth - 1), tree(depth - 1)))

    for query in [tree(2) for _ in range(12)]:
        assert ids(search.boolean(view, query)) == oracle(random_docs, query), query


def bm25(docs, terms, k1=1.2, b=0.75, weights=(4.0, 2.0, 1.0, 1.5)):
    """Scores by definition."""
    n = len(docs)
    lists = {(d[0], f): [t for t, _ in analyze(x, PLAIN.of(f))] for d in docs for f, x in enumerate((d[1], "\n".join(d[2]), d[3], "\n".join(d[4])))}
    avg = [sum(len(lists[d[0], f]) for d in docs) / n for f in range(4)]
    out = {}
    for term, f in itertools.product(terms, range(4)):
        df = sum(term in lists[d[0], f] for d in docs)
        for d in docs:
            if tf := lists[d[0], f].count(term):
                idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                out[d[0]] = out.get(d[0], 0) + weights[f] * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(lists[d[0], f]) / avg[f]))
    return sorted(((round(s, 4), i) for i, s in out.items()), key=lambda x: (-x[0], x[1]))


def test_bm25_by_definition_and_pruning_changes_nothing(spark, random_docs):
    view = IndexView.of(make(spark, random_docs), PLAIN).cached()
    query = parse("alpha OR zeta", PLAIN)
    expected = bm25(random_docs, ["alpha", "zeta"])
    for k in (1, 3, 10):
        got = [(r.score, r.doc_id) for r in rank.top_k(view, query, k).collect()]
        assert [i for _, i in got] == [i for _, i in expected[:k]]
        assert [s for s, _ in got] == pytest.approx([s for s, _ in expected[:k]], abs=1e-4)
        best, work = rank.pruned_top_k(replace(view, shift=2), query, k)
        assert [(r.score, r.doc_id) for r in best.collect()] == got
        w = work.first()
        assert w.blocks == w.blocks_scored + w.blocks_skipped and w.postings >= w.postings_scored
    blends = Ranking(authority_weight=2, freshness_weight=3)
    for text in ("alpha OR zeta", "alpha OR NOT beta", "NOT alpha"):
        q = parse(text, PLAIN)
        for shift in (0, 2, None):
            assert rank.pruned_top_k(replace(view, shift=shift), q, 5, blends)[0].collect() == rank.top_k(view, q, 5, blends).collect()


def test_selective_queries_read_few_postings(spark, tmp_path, monkeypatch):
    rows = [(i, "", [], "common filler text", [], "", {}, 0) for i in range(200)] + [(1000, "", [], "vellumquist common", [], "", {}, 0), (1001, "", [], "vellumquist common again", [], "", {}, 0)]
    view = replace(IndexView.of(make(spark, rows), PLAIN), shift=1)
    segments.write_index(view, str(tmp_path / "i"))
    kept = segments.read_index(spark, str(tmp_path / "i"), analysis=PLAIN)
    query = parse("common OR vellumquist", PLAIN)
    for ranges, blocks in ((rank.MOST_RANGES, rank.MOST_BLOCKS), (0, rank.MOST_BLOCKS), (0, 0)):  # ranges that reach the scan, joins with blocks of the driver and of a table
        monkeypatch.setattr(rank, "MOST_RANGES", ranges)
        monkeypatch.setattr(rank, "MOST_BLOCKS", blocks)
        best, work = rank.pruned_top_k(kept, query, 2)
        assert [r.doc_id for r in best.collect()] == [1000, 1001] == [r.doc_id for r in rank.top_k(kept, query, 2).collect()]
        w = work.first()
        assert w.postings == 204 and w.postings_scored <= 5 and w.blocks_scored <= 2


def test_blocks_in_many_ranges_are_one_condition(spark):
    """As many ranges as are pushed into a scan, none beside another."""
    rows = spark.range(3 * rank.MOST_RANGES).select(F.col("id").alias("block"))
    kept = rank._Blocks([(3 * i, 1.0, 1) for i in range(rank.MOST_RANGES)], None)
    assert sorted(r.block for r in kept.of(rows).collect()) == [3 * i for i in range(rank.MOST_RANGES)]
    assert rank._Blocks([], None).of(rows).count() == 0


def test_blocks_of_sparse_ids_hold_as_many_documents(spark):
    docs = make(spark, [(i * 10**15 - 5 * 10**17, "", [], "a", [], "", {}, 0) for i in range(1000)])
    shift = IndexView.of(docs, PLAIN).id_shift()
    blocks = docs.select(block_of(F.col("doc_id"), shift).alias("b")).groupBy("b").count().agg(F.max("count").alias("m"), F.count("*").alias("n")).first()
    assert 32 <= blocks.m <= 130 and blocks.n < 40


def test_shards_change_nothing_and_partial_is_told(spark, random_docs):
    view = IndexView.of(make(spark, random_docs), PLAIN).cached()
    query = parse("alpha OR zeta", PLAIN)
    whole = [(r.doc_id, r.score) for r in rank.top_k(view, query, 10).collect()]
    for n in (1, 3, 4):
        assert [(r.doc_id, r.score) for r in sharded_top_k(view, query, 10, n).collect()] == whole
    copies = layout(spark, 2, 2)
    one_down = set_health(copies, "node-0", "offline")
    rows = sharded_top_k(view, query, 10, 2, one_down).collect()
    assert [(r.doc_id, r.score) for r in rows] == whole and not rows[0].partial
    lost = set_health(layout(spark, 4, 1).withColumn("node", search.F.col("shard").cast("string")), "0", "offline")
    rows = sharded_top_k(view, query, 30, 4, lost).collect()
    assert rows[0].partial and len(rows) < 30


def test_blends(spark):
    docs = make(spark, [(1, "", [], "harvester", [], "", {"authority": "0.2"}, 86400 * 30), (2, "", [], "harvester", [], "", {"authority": "0.9"}, 86400 * 60), (3, "", [], "harvester", [], "", {"authority": "nan"}, 0)])
    view = IndexView.of(docs, PLAIN)
    q = parse("harvester", PLAIN)
    base = rank.top_k(view, q, 3).first().score
    got = {r.doc_id: r.score for r in rank.top_k(view, q, 3, Ranking(authority_weight=5)).collect()}
    assert got[2] - base == pytest.approx(4.5, abs=1e-3) and got[1] - base == pytest.approx(1, abs=1e-3) and got[3] == base
    got = {r.doc_id: r.score for r in rank.top_k(view, q, 3, Ranking(freshness_weight=5)).collect()}
    assert got[2] - base == pytest.approx(5, abs=1e-3) and got[1] - base == pytest.approx(2.5, abs=1e-3) and got[3] == base


def test_limit_zero_and_missing_documents(harvesters, spark):
    assert rank.top_k(harvesters, parse("harvester", PLAIN), 0).count() == 0
    empty = IndexView.of(small(spark, [(1, None, None)]).limit(0), PLAIN)
    assert rank.top_k(empty, parse("harvester", PLAIN), 5).count() == 0
    nulls = IndexView.of(small(spark, [(1, None, None)]), PLAIN)
    assert ids(search.boolean(nulls, parse("NOT x", PLAIN))) == [1]


def test_cache_key_holds_all_settings():
    cache = ResultCache(2)
    cache.put("q", 10, Ranking(), 1, "a")
    assert cache.get("q", 10, Ranking(), 1) == "a"
    assert cache.get("q", 10, Ranking(scoring="tfidf"), 1) is None and cache.get("q", 10, Ranking(), 2) is None
    cache.put("r", 10, Ranking(), 1, "b")
    cache.put("s", 10, Ranking(), 1, "c")
    assert cache.get("q", 10, Ranking(), 1) is None and 0 < cache.hit_rate < 1


def test_relevance_of_the_seed_set(spark):
    """Known rankings of a few texts give known metrics."""
    from textharbor.operators.evaluate import evaluate, means

    bodies = {
        "gear-lathe": "Turning Gears on a Lathe\n\nA sharp tool and slow feeds leave smooth teeth. Balancing the lathe\nbefore each cut keeps harvesters and mills\nrunning with less noise.\n",
        "pickles": "Keeping Pickled Beets\n\nPickled beets need clean jars, vinegar and a cool shelf.\n",
        "tides": "Reading Tide Tables\n\nTide tables list high and low water for each port.\n",
    }
    names = sorted(bodies)
    view = IndexView.of(small(spark, [(i, n, bodies[n]) for i, n in enumerate(names)]), Analysis())
    run = [("q1", r.doc_id, i + 1) for i, r in enumerate(rank.top_k(view, parse("balancing lathes", Analysis()), 10).collect())]
    run += [("q2", r.doc_id, i + 1) for i, r in enumerate(rank.top_k(view, parse("pickling beets", Analysis()), 10).collect())]
    assert [r[1] for r in run] == [names.index("gear-lathe"), names.index("pickles")]
    run = spark.createDataFrame(run, "query_id string, doc_id long, rank int")
    judged = spark.createDataFrame([("q1", 0, 1), ("q1", 1, 0), ("q2", 1, 3), ("q2", 2, 1)], "query_id string, doc_id long, grade int")
    got = {r.query_id: r for r in evaluate(run, run, judged).collect()}
    assert got["q1"].ndcg == 1 and got["q1"].rr == 1 and got["q2"].ap == 0.5 and got["q2"].precision == 0.1
    assert means(evaluate(run, run, judged)).first().rr == 1
