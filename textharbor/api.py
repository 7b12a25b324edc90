"""HTTP interface over the standard library: /, /search, /api/search, /api/complete, /api/admin/status, /api/admin/metrics."""

from __future__ import annotations

import hmac
import html
import json
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import functions as F

from textharbor.config import FIELDS, Config
from textharbor.functions.analysis import analyze
from textharbor.functions.text import snippet
from textharbor.operators import rank, spell
from textharbor.operators.cache import ResultCache
from textharbor.operators.index import IndexView
from textharbor.plans.query import InvalidQuery, Phrase, Term, parse


class Service:
    """Answers of one index view; ``generation`` changes with the index and so empties the cache."""

    def __init__(self, view: IndexView, config: Config = Config(), token: str | None = None, generation: int = 0) -> None:
        self.view, self.config, self.token, self.generation = view, config, token, generation
        self.cache = ResultCache()
        self.counts = {"searches": 0, "cache_hits": 0, "partials": 0, "completes": 0}

    def search(self, text: str | None, limit: int = 20) -> tuple[int, dict]:
        if not text:
            return 400, {"error": "q is missing"}
        k = spell.clamp(limit, 100)
        began = time.time()
        try:
            query = parse(text, self.config.analysis, self.config.query.max_query_terms)
        except InvalidQuery as e:
            return 400, {"error": str(e)}
        hits = self.cache.get(text, k, self.config.ranking, self.generation)
        self.counts["searches"] += 1
        self.counts["cache_hits"] += hits is not None
        if hits is None:
            terms = [t for q, _ in query.leaves() for t in ([q.term] if isinstance(q, Term) else q.terms if isinstance(q, Phrase) else [])]
            best = F.broadcast(rank.top_k(self.view, query, k, self.config.ranking))  # at most 100 rows
            stemmer = self.config.analysis.of(2).stemmer
            rows = self.view.docs.join(best, "doc_id").select("doc_id", "score", "title", "url", snippet(F.col("body"), F.col("title"), terms, stemmer).alias("snippet"))
            hits = [r.asDict() for r in rows.orderBy(F.desc("score"), "doc_id").collect()]
            self.cache.put(text, k, self.config.ranking, self.generation, hits)
        answer = {"query": text, "hits": hits, "partial": False, "trace_ms": round((time.time() - began) * 1000, 1)}
        if not hits:
            answer["suggestion"] = spell.did_you_mean(spell.all_fields(self.view.termstats()), text, self.config.analysis)
        return 200, answer

    def complete(self, prefix: str | None, limit: int = 8) -> tuple[int, dict]:
        if not prefix:
            return 400, {"error": "q is missing"}
        self.counts["completes"] += 1
        terms = analyze(prefix, self.config.analysis.of(2))
        if not terms:
            return 200, {"prefix": prefix, "completions": []}
        rows = spell.complete(self.view.termstats(), terms[0][0], spell.clamp(limit, 50)).collect()
        return 200, {"prefix": prefix, "completions": [{"field": FIELDS[r.field], "term": r.term, "df": r.df} for r in rows]}

    def _refused(self, authorization: str | None) -> bool:
        return self.token is None or not hmac.compare_digest((authorization or "").encode(), f"Bearer {self.token}".encode())

    def metrics(self, authorization: str | None) -> tuple[int, dict]:
        if self._refused(authorization):
            return 401, {"error": "not allowed"}
        c = self.cache
        return 200, {**self.counts, "cache": {"hits": c.hits, "misses": c.misses, "evictions": c.evictions, "entries": len(c.kept)}}

    def page(self, asked: dict[str, str]) -> str:
        """The search form, with the hits of ``q`` where it is given."""
        text = asked.get("q", "")
        parts = [f'<!doctype html><meta charset="utf-8"><title>Search</title><form action="/search"><input name="q" value="{html.escape(text)}"><button>Search</button></form>']
        if text:
            code, answer = self.search(text)
            if code != 200:
                parts.append(f"<p>{html.escape(answer['error'])}</p>")
            for hit in answer.get("hits", ()):
                parts.append(f"<p><b>{html.escape(hit['title'] or '')}</b> {html.escape(hit['url'] or '')}<br>{hit['snippet']}</p>")
            if answer.get("suggestion"):
                parts.append(f"<p>Did you mean {html.escape(answer['suggestion'])}?</p>")
        return "".join(parts)

    def status(self, authorization: str | None) -> tuple[int, dict]:
        if self._refused(authorization):
            return 401, {"error": "not allowed"}
        return 200, {"docs": self.view.docs.count(), "generation": self.generation, "cache_hit_rate": self.cache.hit_rate}

    def answer(self, target: str, authorization: str | None = None) -> tuple[int, dict | str]:
        """(code, answer) of a request: a dict, or a page's text."""
        parts = urlsplit(target)
        asked = {k: v[0] for k, v in parse_qs(parts.query).items()}
        if parts.path in ("/", "/search"):
            return 200, self.page(asked)
        try:
            limit = int(asked.get("limit", 20 if parts.path == "/api/search" else 8))
        except ValueError:
            return 400, {"error": "limit is not a number"}
        if parts.path == "/api/search":
            return self.search(asked.get("q"), limit)
        if parts.path == "/api/complete":
            return self.complete(asked.get("q"), limit)
        if parts.path == "/api/admin/status":
            return self.status(authorization)
        if parts.path == "/api/admin/metrics":
            return self.metrics(authorization)
        return 404, {"error": "no such page"}


def serve(service: Service, port: int = 8080) -> ThreadingHTTPServer:
    """A server ready for ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            code, answer = service.answer(self.path, self.headers.get("Authorization"))
            body = (answer if isinstance(answer, str) else json.dumps(answer, ensure_ascii=False)).encode()
            self.send_response(code)
            self.send_header("Content-Type", f"{'text/html' if isinstance(answer, str) else 'application/json'}; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
