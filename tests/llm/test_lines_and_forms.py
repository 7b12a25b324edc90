import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from textharbor.llm import distinctive, lookalike, sitelines
from textharbor.llm.common import host_of, one_per_key

DOCS = "doc_id long, url string, body string, host string, line string, clean_body string"


def site(spark, rows):
    return spark.createDataFrame([(i, u, b, "x", "y", "z") for i, u, b in rows], DOCS)


def brute_lines(rows, least):
    norm = lambda s: re.sub(r"\d+", "0", " ".join(s.lower().split()))
    host = lambda u: re.sub(r"^www\.", "", re.sub(r"^\w+://", "", (u or "").lower())).split("/")[0].split(":")[0]
    held = {}
    for i, u, b in dict((r[0], r) for r in rows).values():
        for line in (b or "").split("\n"):
            if host(u) and norm(line):
                held.setdefault((host(u), norm(line)), set()).add(i)
    return {(i, n) for i, u, b in rows for n, line in enumerate((b or "").split("\n")) if len(held.get((host(u), norm(line)), ())) >= least}


@pytest.mark.parametrize("counters", [2, 4096])
def test_repeated_lines_equal_brute_force(spark, counters):
    rng = random.Random(1)
    lines = [f"Site line {c}" for c in "abcdef"] + ["Posted 12 times", "posted  7 TIMES "]
    rows = [(i, rng.choice(["http://www.a.b/x", "HTTPS://A.b:443/y", "http://c.d/", None, ""]), "\n".join(rng.choice([*lines, f"own {i}", ""]) for _ in range(5))) for i in range(120)]
    rows += rows[:5] + [(500, "http://a.b/", None), (501, "http://a.b/", "")]
    got = {(r.doc_id, r.line_no) for r in sitelines.found_lines(site(spark, rows), 10, counters).collect()}
    assert got == brute_lines(rows, 10) and got


def test_lines_are_removed(spark):
    rows = [(i, "http://a.b/", f"own {'x' * i}\nLegal notice {i}\n\nend {'y' * i}") for i in range(12)] + [(50, None, "Legal notice 1"), (51, "http://a.b/", None)]
    got = {r.doc_id: r for r in sitelines.without_repeated_lines(site(spark, rows)).collect()}
    assert got[3].clean_body == "own xxx\n\nend yyy" and got[3].removed == 1
    assert got[50].clean_body == "Legal notice 1" and got[51].clean_body is None and got[51].removed == 0 and got[3].line == "y"
    assert sitelines.found_lines(site(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("counters", [3, 40])
def test_summaries_never_fall_short_and_stay_bounded(spark, counters):
    rng = random.Random(2)
    rows = [(i, "http://a.b/" if i % 3 else "http://c.d/", "\n".join(str(chr(97 + min(25, int(rng.expovariate(0.3))))) + ("q" * (i % 7) if rng.random() < 0.5 else "") for _ in range(4))) for i in range(400)]
    lines = sitelines.ranged(sitelines._lines(site(spark, rows).repartition(7)), 10, counters).cache()
    true = {(r.h, r.line): r["count"] for r in lines.select("h", F.explode(F.array_distinct("lines")).alias("line")).groupBy("h", "line").count().collect()}
    found = sitelines.summaries(lines, 10, counters).collect()
    error, seen, size = {}, {}, {}
    for r in found:
        if r.line is None:
            error[r.h, r.part] = error.get((r.h, r.part), 0) + r.error
        else:
            seen[r.h, r.line] = (r.seen, r.part)
            size[r.h, r.part] = size.get((r.h, r.part), 0) + 1
    parts = {r.h: r.parts for r in lines.select("h", "parts").distinct().collect()}
    assert max(size.values()) <= counters and (counters > 3 or max(parts.values()) > 1 and error)
    for (h, line), n in true.items():
        part = ((line % (1 << 64)) >> 1) % parts[h]
        got, p = seen.get((h, line), (0, part))
        assert p == part and got <= n <= got + error.get((h, part), 0)


def test_candidates_are_few(spark):
    rows = [(i, "http://a.b/", f"own {'x' * i}\nother {'y' * i}\nLegal notice") for i in range(300)]
    lines = sitelines.ranged(sitelines._lines(site(spark, rows)), 10, 20).cache()
    likely, whole = sitelines.candidates(lines, 10, 20)
    assert likely.count() <= 10 and whole.count() == 0
    r = sitelines.host_summary(site(spark, rows), 10, 20).collect()
    assert [(x.host, x.lines, x.distinct_lines, x.repeated) for x in r] == [("a.b", 900, 601, 1)] and r[0].candidates <= 10


def test_hosts_and_keys(spark, tmp_path):
    urls = {"HTTP://www.A.b:80/x": "a.b", "https://u@c.d.?q": "c.d", "x": None, "": None, None: None, "ftp://e.f#g": "e.f"}
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", host_of(F.col("u")).alias("h")).collect()
    assert {r.u: r.h for r in rows} == urls
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, "b"), (2, "c")], "k long, v string")
    df.write.parquet(str(tmp_path / "t"))
    for d in (df, spark.read.parquet(str(tmp_path / "t"))):
        assert sorted(map(str, one_per_key(d, "k").collect())) == ["Row(k=1, v='a')", "Row(k=2, v='c')", "Row(k=None, v='b')"]


TITLES = "doc_id long, title string, s string, skeleton string"


def test_same_looking_titles(spark):
    t = [
        (1, "A small café"), (2, "Ａ small café"), (3, "А sm​all café"), (4, "A small cafe"), (5, "a small café"), (6, "A smallcafé"), (7, "A small café"), (8, "A small café"),
        (9, None), (10, ""), (11, "​"), (12, "Старый мост"), (13, "Cтарый мoст"), (14, "x" * 3000 + "é"), (2, "Ａ small café"),
    ]
    df = spark.createDataFrame([(i, s, "x", "y") for i, s in t], TITLES)
    got = {(r.a, r.b) for r in lookalike.same_looking(df, "doc_id", "title").collect()}
    same = [1, 2, 3, 7, 8]
    exp = {(a, b) for a in same for b in same if a < b and (a, b) != (1, 8)} | {(12, 13)}
    assert got == exp
    assert lookalike.same_looking(df.limit(0), "doc_id", "title").count() == 0


def test_file_of_lookalikes(spark, tmp_path):
    file = tmp_path / "confusables.txt"
    file.write_text("# comment\n2CA2 ;\t0043 ;\tMA\t# C\n0030 ;\t004F ;\tMA\nbroken\n", encoding="utf-8")
    assert lookalike.read_confusables(str(file)) == {"\u2ca2": "C"}
    df = spark.createDataFrame([("\u2ca2af\u00e9",), ("\ua4da\u0585de",)], "s string")
    got = {r.s: r.skeleton for r in lookalike.consistent_forms(df, confusables=str(file)).collect()}
    assert got == {"\u2ca2af\u00e9": "Caf\u00e9", "\ua4da\u0585de": "Code"}


def test_forms(spark):
    strings = ["Ｗｉｄｅ　text", "ệx", "ệx", "nä⁠ive", "Мосt", "mоst", "Москва", "ab­c", "tab\tend ", "plain"]
    df = spark.createDataFrame([(s,) for s in strings], "s string")
    got = {r.s: r for r in lookalike.consistent_forms(df).collect()}
    assert got["Ｗｉｄｅ　text"].form == "Wide text" and got["tab\tend "].form == "tab end" and got["ab­c"].form == "abc"
    assert got["ệx"].form == got["ệx"].form == unicodedata.normalize("NFC", "ệx")
    assert got["Москва"].form == "Москва" and got["mоst"].form == "most"
    low = {r.s: r.skeleton for r in lookalike.consistent_forms(spark.createDataFrame([("βook",), ("τext",), ("plain",)], "s string"), lowered=True).collect()}
    assert low == {"βook": "book", "τext": "text", "plain": "plain"}


def brute_terms(rows, min_tf, max_df, window=4):
    docs = {i: re.findall(r"[^\W_]+", (b or "").lower()) for i, b in rows}
    df = {}
    for ws in docs.values():
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    out = {}
    for i, ws in docs.items():
        for w in set(ws):
            if ws.count(w) >= min_tf and df[w] <= max_df:
                near = {v for p, x in enumerate(ws) if x == w for v in ws[max(0, p - window + 1) : p + window] if v != w}
                out[i, w] = (ws.count(w), len(near), df[w], len(near) * distinctive.rarity(len(docs), df[w]))
    return out


@pytest.mark.parametrize("min_tf, max_df", [(1, 99), (3, 2)])
def test_term_weights_equal_brute_force(spark, min_tf, max_df):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("alpha Beta γάμα d5 12 x_y".split()) for _ in range(rng.randrange(12)))) for i in range(15)] + [(90, None), (91, ""), (92, "solo " * 300)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows + rows[:3]], "doc_id long, body string, term string, key int")
    got = {(r.doc_id, r.term): (r.tf, r.degree, r.df, r.weight) for r in distinctive.term_weights(df, "doc_id", "body", min_tf=min_tf, max_df=max_df).collect()}
    exp = brute_terms(rows, min_tf, max_df)
    assert set(got) == set(exp)
    for k, v in exp.items():
        assert got[k] == pytest.approx(v)
    assert distinctive.term_weights(df.limit(0), "doc_id", "body").count() == 0
