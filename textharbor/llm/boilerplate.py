"""Main content of web pages (problem 4): consensus host paths over the lines of extracted pages.

The extractor kept one block per line and no tags, so a line's *path* stands for its tag-class path: its words, with site
names, numbers and words that few pages know generalised (``@``, ``#``, ``*``) and words of running text (those spread over many
hosts' sentences) too (``w``). What is left are the words that belong to the page's frame.

1. *Lexicon.* For every word: the share of pages that hold it and its distinct hosts, over all pages. Words under
   ``lexicon_share`` of the pages are no part of a path, which bounds the lexicon by (words per page / share).
2. *Score.* On every page, running text spans from its first to its last prose line; a line is inside or outside of it. Lines
   made of link texts only, and trails that end in the page's own title, are furniture at once; the page's own title is not.
3. *Vote.* Per host and path, and per path over all hosts, the lines outside are counted against those inside. Word votes
   serve paths too rare to vote on. Lines without a word of the lexicon that several hosts know, as a site's own menu or slogan, have no
   word votes: their host votes on the words themselves (*form*).
4. *Extraction.* Lines whose path is voted furniture go; all others are main content. Headings that only announce a run of
   link texts go with it.

The same steps serve any table of (key, url, title, body); links are used where there are any.

Defined results: null and empty bodies have no lines; empty lines are never furniture; pages without url count as one
host each; repeated rows of one key count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textharbor.llm.common import cut, host_of, map_batches, one_per_key, sized, slices

LEXICON_SHARE = 0.001
PROSE_SHARE = 0.01
#: A path is furniture from this share of lines outside the running text on, within its host or over all hosts.
OUTSIDE = 0.15
LEAST_VOTES = 8
#: Share of its pages on which a host repeats a line in its own words, and share of these lines outside of the running text.
OWN_SHARE, OWN_OUTSIDE = 0.1, 0.5
#: Pages, and share of its pages, on which a host repeats a sentence of its frame.
REPEATS, REPEAT_SHARE = 3, 0.01
TOKEN = re.compile(r"\d+|[^\W\d_]+")
SPLIT = re.compile(r"\s+[|·•>/»-]\s+|\s*[|·•>/»]\s*")
TRAIL = re.compile(r"\s+[|·•>/»]\s+")
BETWEEN = "|·•>/»,-"
WORDS = re.compile(r"[^\W\d_]+")
#: Shorter parts of a prose line, as a list's number, are no sentences of their own.
SENTENCE_WORDS = 4
SENTENCE_END = re.compile(r"(?<=[.!?…])\s+")
BULLET = re.compile(r"^\s*(?:[*•–-]|\d+[.)])\s+")


def _site(host: str | None) -> set[str]:
    return {p for p in re.split(r"[.-]", host or "") if len(p) > 2}


def lexicon(pages: DataFrame, total: int, lexicon_share: float = LEXICON_SHARE) -> dict[str, tuple[float, int, int]]:
    """word -> (share of pages, distinct hosts, occurrences) of every word that lexicon_share of the pages or more hold."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in slices(batches, 1000):
            hosts = b.column("host").to_pylist()
            code: dict[str, int] = {}
            host_code: dict[str, int] = {}
            flat, of, at = [], [], []
            for page, (h, body) in enumerate(zip(hosts, b.column("body").to_pylist())):
                words = TOKEN.findall(body.lower())
                flat += [code.setdefault(w, len(code)) for w in words]
                of += [host_code.setdefault(h, len(host_code))] * len(words)
                at += [page] * len(words)
            if not flat:
                continue
            word, of, at = (np.array(x, dtype=np.int64) for x in (flat, of, at))
            held, times = np.unique((word * len(host_code) + of) * len(hosts) + at, return_counts=True)
            pair, first = np.unique(held // len(hosts), return_index=True)
            words, names = list(code), list(host_code)
            keep = np.array([not words[i].isdigit() for i in pair // len(host_code)])
            n, times = np.diff(np.append(first, len(held))), np.add.reduceat(times, first)
            pair = pair[keep]
            yield {"w": [words[i] for i in pair // len(host_code)], "h": [names[i] for i in pair % len(host_code)], "n": n[keep], "times": times[keep]}

    held = map_batches(pages.select("host", "body"), work, "w string, h string, n long, times long")
    found = held.groupBy("w").agg(F.sum("n").alias("n"), F.sum("times").alias("times"), F.approx_count_distinct("h").alias("hosts")).where(F.col("n") >= max(2.0, total * lexicon_share))
    return {r.w: (r.n / total, r.hosts, r.times) for r in found.collect()}


def _form(text: str) -> str:
    return " ".join(text.lower().replace("\u200b", " ").replace("\ufeff", " ").split())


def _first_words(anchors: set[str]) -> dict[str, list[int]]:
    """First word of every link text, and how many words the link texts that begin with it have."""
    sizes: dict[str, set[int]] = {}
    for a in anchors:
        words = a.split(" ")
        sizes.setdefault(words[0], set()).add(len(words))
    return {w: sorted(n, reverse=True) for w, n in sizes.items()}


def _said(sentence: str, site: set[str], known: set[str], local: set[str]) -> int:
    """Hash of a sentence's words, names and numbers generalised."""
    words = ["#" if w.isdigit() else "@" if w in site or w not in known or w in local else w for w in TOKEN.findall(sentence)]
    return xxhash.xxh3_64_intdigest(" ".join(words)) - (1 << 63)


def _tiled(line: str, anchors: set[str], starts: dict[str, list[int]], title: str) -> bool:
    """Whether the line consists of link texts only (and at its end, at most, of the page's own title). starts: as of ``_first_words``."""
    words = line.split(" ")
    if words[0] not in starts:
        return False
    parts = [p for p in SPLIT.split(line) if p]
    if len(parts) > 1 and (parts[-1] == title or parts[-1] in anchors) and all(p in anchors for p in parts[:-1]):
        return True
    reach = [True] + [False] * len(words)
    for at, word in enumerate(words):
        if not reach[at]:
            continue
        if not (bare := word.strip(BETWEEN)):
            reach[at + 1] |= at > 0
        for n in starts.get(word, starts.get(bare, ())):
            if at + n <= len(words) and " ".join(words[at : at + n]).strip(BETWEEN) in anchors:
                reach[at + n] = True
    return reach[-1]


def line_paths(pages: DataFrame, words: dict[str, tuple[float, int, int]]) -> DataFrame:
    """(key, line_no, host, path, form, sentences, outside, sure): every line that is not empty.

    sure: 1 furniture, 0 content, null undecided. path: what is left of an undecided line's words after generalisation. Prose
    lines have no path, but hashes of their sentences, generalised likewise. form: hash of the words of a line whose path is generalised throughout.
    """
    hosts = max((h for _, h, _ in words.values()), default=1)
    prose = {w for w, (share, n, _) in words.items() if share >= PROSE_SHARE / 4 and n >= min(4, max(2, hosts // 10))}
    local = {w for w, (_, n, _) in words.items() if n < min(3, hosts)}
    shared = pages.sparkSession.sparkContext.broadcast((set(words), prose, local))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known, prose, local = shared.value
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("key", "line_no", "host", "path", "form", "sentences", "outside", "sure")}
            columns = [b.column(c).to_pylist() for c in ("key", "host", "title", "anchors", "body")]
            for key, host, title, anchors, body in zip(*columns):
                site = _site(host)
                own = _form(title or "")
                anchors = {f for a in anchors or [] if a and (f := _form(a))}
                lines = [_form(x) for x in body.split("\n")]
                found, text = [], []
                for i, line in enumerate(lines):
                    if not line:
                        continue
                    tokens = TOKEN.findall(line)
                    is_prose = len(tokens) >= 7 and line[-1] in ".!?…)"
                    if is_prose:
                        other = [w for w in tokens if w not in prose or w in site]
                        digits = sum(w.isdigit() for w in other)
                        n = len(tokens) - digits
                        is_prose = n >= 7 and len(other) - digits <= 0.05 * n
                    if is_prose:
                        text.append(i)
                    found.append((i, line, tokens, is_prose))
                first, last = (text[0], text[-1]) if text else (len(lines), -1)
                starts = _first_words(anchors)
                links = {i for i, line, _, p in found if anchors and line != own and (line in anchors or not p and _tiled(line, anchors, starts, own))}
                present = [i for i, *_ in found]
                for at, (i, line, tokens, is_prose) in enumerate(found):
                    if is_prose:
                        said = [_said(x, site, known, local) for x in SENTENCE_END.split(line) if len(WORDS.findall(x)) >= SENTENCE_WORDS] or [_said(line, site, known, local)]
                        for k, v in (("key", key), ("line_no", i), ("host", host), ("path", None), ("form", None), ("sentences", said), ("outside", None), ("sure", None)):
                            out[k].append(v)
                        continue
                    sure = 1 if i in links else 0 if line == own else None
                    path = ("- " if BULLET.match(line) else "") + " ".join(
                        "#" if w.isdigit() else "@" if w in site else "*" if w not in known or w in local else w for w in tokens
                    )
                    parts = [x for x in TRAIL.split(line) if x]
                    if sure is None and len(parts) > 1:
                        front = {w for x in parts[:-1] for w in TOKEN.findall(x)}
                        path = "> " + " ".join(w for w in path.split(" ") if w in front or w in "#@*")
                    run = [j in links for j in present[at + 1 : at + 3]]
                    if sure is None and len(run) == 2 and all(run) and len(tokens) <= 8 and line[-1] not in ".!?":
                        path = "^ " + path
                    form = None
                    if sure is None and any(not w.isdigit() for w in tokens) and all(w.isdigit() or w in site or w not in known or w in local for w in tokens):
                        form = xxhash.xxh3_64_intdigest(" ".join("#" if w.isdigit() else w for w in tokens).encode("utf-8", "surrogatepass")) - (1 << 63)
                    for k, v in (("key", key), ("line_no", i), ("host", host), ("path", None if sure is not None else path), ("form", form), ("sentences", None), ("outside", i < first or i > last), ("sure", sure)):
                        out[k].append(v)
            yield out

    rows = pages.select("key", "host", "title", "anchors", "body")
    return map_batches(rows, work, "key long, line_no int, host string, path string, form long, sentences array<long>, outside boolean, sure int")


def furniture_lines(pages: DataFrame, key: str, outside: float = OUTSIDE, least: int = LEAST_VOTES, lexicon_share: float = LEXICON_SHARE) -> DataFrame:
    """(key, line_no) of every furniture line of ``pages(key, url, title, body[, links])``."""
    anchors = F.transform("links", lambda x: x["anchor"]) if "links" in pages.columns else F.lit(None).cast("array<string>")
    host = F.coalesce(host_of(F.col("url")), F.concat(F.lit("#"), F.col(key).cast("string")))
    rows = one_per_key(pages, key).where(F.col(key).isNotNull() & F.col("body").isNotNull() & (F.col("body") != ""))
    rows = rows.select(F.col(key).cast("long").alias("key"), host.alias("host"), "title", anchors.alias("anchors"), "body")
    on = cut(rows.groupBy("host").agg(F.count("*").alias("pages")))
    total = on.agg(F.coalesce(F.sum("pages"), F.lit(0)).alias("n")).first().n
    words = lexicon(rows, total, lexicon_share)
    lines = cut(line_paths(rows, words))
    prose = lines.where("sentences IS NOT NULL").select("key", "line_no", "host", F.size("sentences").alias("of"), F.explode("sentences").alias("sentence"))
    open_ = lines.where("path IS NOT NULL").select("key", "line_no", "host", "path", "form", "outside")

    out = F.sum(F.col("outside").cast("int")).alias("out")
    by_host = open_.groupBy("host", "path").agg(F.count("*").alias("n_host"), F.sum(F.col("outside").cast("int")).alias("out"))
    by_path = cut(by_host.groupBy("path").agg(F.sum("n_host").alias("n"), F.sum("out").alias("out"), F.count("*").alias("hosts")))
    # words: how many of their occurrences are in undecided lines outside of the running text
    each = by_path.select(F.explode(F.array_distinct(F.split("path", " "))).alias("w"), "n", "out")
    vote = each.groupBy("w").agg(F.sum("n").alias("n"), F.sum("out").alias("out")).where(F.col("n") >= least).collect()  # words of the lexicon and signs
    score = {r.w: r.out / max(r.n, words[r.w][2]) for r in vote if r.w in words}
    shared = pages.sparkSession.sparkContext.broadcast((score, set(words)))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        score, known = shared.value
        for b in batches:
            paths = b.column("path").to_pylist()
            rates = []
            for p in paths:
                s = sorted((score.get(w, 0.0) for w in dict.fromkeys(p.split(" ")) if w in known), reverse=True)
                rates.append(sum(s[: max(1, (len(s) + 1) // 2)]) / max(1, (len(s) + 1) // 2) if s else 0.0)
            yield {"path": paths, "n": b.column("n").to_numpy(), "out": b.column("out").to_numpy(), "rate": rates}

    rated = map_batches(by_path.select("path", "n", "out"), rate, "path string, n long, out long, rate double")
    rated = cut(rated.where((F.col("rate") >= 0.2) | F.col("path").startswith("^ ")))
    voted = (F.col("n") >= least) & (F.col("out") >= outside * F.col("n")) & (F.col("rate") >= 0.2)
    rare = (F.col("n") < least) & (F.col("rate") >= 0.35)
    announced = F.col("path").startswith("^ ") & ((F.col("rate") >= 0.2) | (F.col("n") >= least))
    # what a host's own lines vote furniture, where it has enough of them, and what those of all hosts do
    own = by_host.where((F.col("n_host") >= least) & (F.col("out") >= outside * F.col("n_host"))).join(sized(rated.where("rate >= 0.2").select("path")), "path", "left_semi")
    gone = rated.where(voted | rare | announced).select("path")
    # lines in a host's own words
    forms = open_.where("form IS NOT NULL").groupBy("host", "form").agg(F.countDistinct("key").alias("n"), F.count("*").alias("lines"), out)
    forms = forms.where((F.col("n") >= least) & (F.col("out") >= OWN_OUTSIDE * F.col("lines"))).join(on, "host").where(F.col("n") >= OWN_SHARE * F.col("pages"))
    # sentences that a host, or many hosts, repeat word for word belong to the frame, and so do lines that consist of them by half
    often = prose.groupBy("sentence").agg(F.count("*").alias("n"), F.approx_count_distinct("host").alias("hosts")).where(F.col("n") >= REPEATS)
    often = sized(cut(often))  # nearly all sentences stand once
    often_said = cut(prose.join(often.select("sentence"), "sentence"))
    again = often_said.groupBy("host", "sentence").agg(F.countDistinct("key").alias("n")).where(F.col("n") >= REPEATS)
    again = again.join(on, "host").where(F.col("n") >= F.col("pages") * REPEAT_SHARE).select("host", "sentence")
    wide = often.where((F.col("n") >= max(REPEATS, total * lexicon_share)) & (F.col("hosts") >= 5)).select("sentence")
    found = open_.join(sized(cut(own.select("host", "path"))), ["host", "path"], "left_semi").select("key", "line_no")
    found = found.unionByName(open_.join(sized(cut(forms.select("host", "form"))), ["host", "form"], "left_semi").select("key", "line_no"))
    found = found.unionByName(open_.join(sized(cut(gone)), "path", "left_semi").select("key", "line_no"))
    framed = often_said.join(sized(cut(again)).withColumn("again", F.lit(True)), ["host", "sentence"], "left").join(sized(cut(wide)).withColumn("wide", F.lit(True)), "sentence", "left")
    framed = framed.where(F.coalesce("again", "wide", F.lit(False))).groupBy("key", "line_no", "of").agg(F.count("*").alias("n")).where(F.col("n") >= F.col("of") / 2)
    found = found.unionByName(framed.select("key", "line_no"))
    found = found.unionByName(lines.where("sure = 1").select("key", "line_no"))
    return found.distinct().withColumnRenamed("key", key)


def main_content(pages: DataFrame, key: str, **how) -> DataFrame:
    """``pages`` with ``main_body`` and ``main_headings``: without furniture lines, and headings that were furniture lines."""
    lost = furniture_lines(pages, key, **how).groupBy(key).agg(F.collect_set("line_no").alias("__lost"))
    kept = F.filter(F.split("body", "\n"), lambda x, i: ~F.array_contains("__lost", i))
    joined = pages.join(sized(cut(lost)), key, "left")
    body = F.when(F.col("__lost").isNull(), F.col("body")).otherwise(F.array_join(kept, "\n"))
    joined = joined.withColumn("main_body", body)
    if "headings" in pages.columns:
        norm = lambda x: F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))
        gone = F.transform(F.filter(F.split("body", "\n"), lambda x, i: F.array_contains("__lost", i)), norm)
        joined = joined.withColumn("main_headings", F.when(F.col("__lost").isNull(), F.col("headings")).otherwise(F.filter("headings", lambda x: ~F.array_contains(gone, norm(x)))))
    return joined.drop("__lost")
