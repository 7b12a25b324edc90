import json
import threading
import urllib.error
import urllib.request

import pytest

import __spark_entry__
from textharbor import cli
from textharbor.api import Service, serve
from textharbor.config import Analysis
from textharbor.operators.index import IndexView


def test_command_line(spark, tmp_path, capsys):
    corpus, data = tmp_path / "corpus", str(tmp_path / "index")
    corpus.mkdir()
    (corpus / "gardener.txt").write_text("A gardener plants early potatoes")
    (corpus / "fences.txt").write_text("Painting fences takes patience")
    (corpus / "x.bin").write_bytes(b"1")
    run = lambda *a: cli.run(["--data", data, *a], spark)
    assert run("index", str(corpus)) == 0 and "1 files skipped" in capsys.readouterr().out
    assert run("search", "gardeners", "--explain") == 0
    out = capsys.readouterr().out
    assert "gardener.txt" in out and "fences.txt" not in out
    assert run("search", "gardenar") == 0 and "did you mean: garden" in capsys.readouterr().out
    assert run("search", "(a") == 2
    assert run("complete", "pai") == 0 and capsys.readouterr().out.split()[-2:] == ["paint", "1"]
    (tmp_path / "q.tsv").write_text("q1\tgardener potatoes\nq2\tfences\n")
    (tmp_path / "j.tsv").write_text("q1\t3\tgardener.txt\nq2\t2\tfences.txt\n")
    assert run("eval", str(tmp_path / "q.tsv"), str(tmp_path / "j.tsv")) == 0
    assert json.loads(capsys.readouterr().out)["ndcg"] == 1
    assert run("eval", str(tmp_path / "q.tsv"), str(tmp_path / "j.tsv"), "--save", str(tmp_path / "r.json")) == 0
    assert run("eval", str(tmp_path / "q.tsv"), str(tmp_path / "j.tsv"), "--baseline", str(tmp_path / "r.json")) == 0 and "same" in capsys.readouterr().out
    assert run("authority") == 0 and run("merge") == 0 and run("stats") == 0 and run("verify") == 0 and run("delete", "5") == 0
    assert run("search", "--all", "early gardener") == 0 and "gardener.txt" in capsys.readouterr().out
    assert run("bench", "--rounds", "1", "gardener", "fences") == 0 and json.loads(capsys.readouterr().out.splitlines()[-1])["queries"] == 2


def test_cluster_and_crawl_commands(spark, tmp_path, capsys):
    corpus, data = tmp_path / "corpus", str(tmp_path / "index")
    corpus.mkdir()
    for i in range(6):
        (corpus / f"{i}.txt").write_text(f"shared word and own{i}")
    run = lambda *a: cli.run(["--data", data, *a], spark)
    assert run("cluster", "status") == 1 and run("cluster", "init", "--shards", "3", "--replicas", "2") == 0 and run("cluster", "index", str(corpus)) == 0
    capsys.readouterr()
    assert run("cluster", "search", "shared own3") == 0
    out = capsys.readouterr().out
    assert "3.txt" in out and "partial" not in out
    doc_id = next(line.split()[1] for line in out.splitlines() if line.endswith("3.txt"))
    assert run("cluster", "delete", "--", doc_id) == 0 and run("cluster", "merge") == 0 and run("cluster", "status") == 0 and run("shard", "list") == 0 and run("node") == 0
    capsys.readouterr()
    assert run("cluster", "search", "own3") == 0 and "3.txt" not in capsys.readouterr().out
    assert run("shard", "move", "1", "node-1", "node-7") == 0 and "node-7" not in capsys.readouterr().out and run("node") == 0 and "node-7" in capsys.readouterr().out
    page = "url string, content_type string, title string, headings array<string>, body string, links array<struct<url:string,anchor:string>>, image_alts array<string>, description string"
    spark.createDataFrame([("http://s/", "text/html", "S", [], "start here", [("http://s/2", "two")], [], None), ("http://s/2", "text/html", "T", [], "second page", [], ["a"], "d")], page).write.parquet(str(tmp_path / "pages"))
    assert run("crawl", "http://s/", "--pages", str(tmp_path / "pages")) == 0 and "fetched: 2" in capsys.readouterr().out
    assert run("search", "second") == 0 and "http://s/2" in capsys.readouterr().out


def test_http(spark):
    docs = spark.createDataFrame([(1, "Gardener", [], "a <gardener> manual", [], "u", {}, 0)], "doc_id long, title string, headings array<string>, body string, anchor_text array<string>, url string, metadata map<string,string>, timestamp long")
    server = serve(Service(IndexView.of(docs, Analysis()), token="secret"), 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def get(path, token=None):
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", headers={"Authorization": f"Bearer {token}"} if token else {})
        try:
            with urllib.request.urlopen(request) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    code, answer = get("/api/search?q=gardener")
    assert code == 200 and answer["hits"][0]["doc_id"] == 1 and "&lt;<mark>gardener</mark>&gt;" in answer["hits"][0]["snippet"]
    assert get("/api/search?q=gardener")[1]["hits"] == answer["hits"]
    assert get("/api/search?q=gardnr")[1]["suggestion"] == "garden"
    assert get("/api/search")[0] == 400 and get("/api/search?q=(")[0] == 400 and get("/api/search?q=a&limit=x")[0] == 400 and get("/x")[0] == 404
    assert get("/api/complete?q=gard")[1]["completions"] == [{"field": f, "term": "garden", "df": 1} for f in ("title", "body")]
    assert get("/api/complete?q=the")[1]["completions"] == []
    assert get("/api/admin/status")[0] == 401 and get("/api/admin/status", "secret")[1]["docs"] == 1
    seen = get("/api/admin/metrics", "secret")[1]
    assert get("/api/admin/metrics")[0] == 401 and seen["searches"] >= 3 and seen["completes"] == 2 and seen["cache"]["entries"] >= 1
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/search?q=gardener") as r:
        assert "<mark>gardener</mark>" in r.read().decode() and r.headers["Content-Type"].startswith("text/html")
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/") as r:
        assert "<form" in r.read().decode()
    server.shutdown()


def test_a_cleared_index_is_written_again(spark, tmp_path):
    import shutil

    from textharbor import catalogue

    row = (1, "Gardener", [], "plants potatoes", [], "u", {}, 0, 1)
    schema = "doc_id long, title string, headings array<string>, body string, anchor_text array<string>, url string, metadata map<string,string>, timestamp long, seg int"
    spark.createDataFrame([row], schema).write.parquet(str(tmp_path / "docs.parquet"))
    first = catalogue._index_path(spark, str(tmp_path))
    assert catalogue._index_path(spark, str(tmp_path)) == first
    shutil.rmtree(first.removeprefix("file://") + "/postings")
    again = catalogue._index_path(spark, str(tmp_path))
    assert again != first and catalogue._stored(spark, str(tmp_path)).postings.count() == 3
    spark.createDataFrame([row, (2, *row[1:])], schema).write.mode("overwrite").parquet(str(tmp_path / "docs.parquet"))
    assert catalogue._stored(spark, str(tmp_path)).docs.count() == 2


def test_entry_points():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert "bm25_topk" in queries and set(sql) <= set(queries)


@pytest.mark.parametrize("name", ["bm25_topk", "eval_queries", "shard_balance"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from pathlib import Path

    d = Path("/root/testdata/sf0.001")
    if not d.exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for f in d.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = __spark_entry__.queries()[name](spark, str(d))
    cursor = con.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    shown = lambda v: str(v) if isinstance(v, (str, type(None))) else f"{float(v):.3f}"
    rows = lambda rs, ns: sorted(tuple(shown(r[ns.index(c)]) for c in sorted(ns)) for r in rs)
    assert rows(cursor.fetchall(), names) == rows(map(tuple, df.collect()), df.columns)
