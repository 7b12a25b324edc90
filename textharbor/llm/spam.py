"""Keyword-stuffed and link-list pages (problem 6).

A page is flagged when its body, but for one real sentence at most, is stitched from phrases that other sites carry
too. Two kinds of evidence meet:

* list density - a *real sentence* ends in ``.``, ``!``, ``?`` or ``…``, has at least five words and holds function words of
  its language (words that many of the known-language samples share). A body with two of them is settled at once;
* replicated phrases - two-word shingles of all other text of the remaining pages. For each of them the distinct hosts
  are counted over *all* pages, and a page's share of phrases that at least ``min_hosts`` hosts carry must reach
  ``min_share``.

Defined results: a null, empty or blank body is never flagged; a page without url counts as a host of its own; repeated rows of
one key count once; several rows of one key that differ are each judged, and the key is flagged if one of them is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textharbor.llm.common import WORD, Hashes, cut, hash_words, map_batches, slices

MIN_HOSTS = 3
MIN_SHARE = 0.5
MIN_WORDS = 10
SENTENCE = re.compile(r"[^.!?…\n]+(?:[.!?…]+(?=\s|$|[\"'»”)])|[.!?…]|\n|$)")
#: Between the entries of a list on one line.
BETWEEN = re.compile(r"[#,|;·•/>»\t]+")
#: The most candidate phrases that one worker looks up in memory; beyond, the counting is a shuffle join.
MOST_PHRASES = 2_000_000


def function_words(samples: DataFrame, share: float = 0.1, least: int = 4) -> set[str]:
    """Words that at least ``share`` of one language's samples hold. At most ``1/share`` words per word of a mean sample."""
    words = samples.select("language", F.array_distinct(F.regexp_extract_all(F.lower("sample"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("w"))
    n = words.groupBy("language").agg(F.count("*").alias("n"))
    held = words.select("language", F.explode("w").alias("w")).groupBy("language", "w").count().join(n, "language")
    rows = held.where((F.col("count") >= F.col("n") * share) & (F.col("count") >= least)).select("w").distinct().collect()
    return {r.w for r in rows if not r.w.isdigit()}


def _judge(body: str, function: set[str]) -> tuple[int, int, list[list[str]], int] | None:
    """(real sentences, words of the rest, the rest's segments, its function words), or None from the second sentence on."""
    real, rest, common = 0, [], 0
    for m in SENTENCE.finditer(body):
        s = m.group().strip()
        if not s:
            continue
        words = WORD.findall(s.lower())
        n = sum(w in function for w in words)
        if len(words) >= 5 and s[-1] in ".!?…\"'»”)" and n and n >= 0.1 * len(words):
            real += 1
            if real > 1:
                return None
        elif words:
            rest += [p for part in BETWEEN.split(s.lower()) if (p := WORD.findall(part))]
            common += n
    return real, sum(map(len, rest)), rest, common


def _pairs(h: np.ndarray) -> np.ndarray:
    """Hashes of all runs of two words."""
    with np.errstate(over="ignore"):
        return (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] + (h[:-1] >> np.uint64(29)))


def _phrases(segments: list[list[str]], seen: Hashes) -> np.ndarray:
    """Distinct hashes of the two-word shingles of segments; a segment of one word is a phrase itself."""
    h = hash_words([w for s in segments for w in s], seen)
    of = np.repeat(np.arange(len(segments)), [len(s) for s in segments])
    alone = np.array([len(s) == 1 for s in segments])[of]
    return np.unique(np.concatenate([_pairs(h)[of[1:] == of[:-1]], h[alone]])).view(np.int64)


def keyword_pages(pages: DataFrame, function: set[str], min_hosts: int = MIN_HOSTS, min_share: float = MIN_SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """Flagged pages of ``pages(tab, rec_id, host, body)`` as (tab, rec_id, words, phrases, shared).

    phrases: distinct shingles outside sentences; shared: those of them that at least min_hosts hosts carry.
    """
    spark = pages.sparkSession
    pages = pages.select("tab", "rec_id", "host", "body").where("body IS NOT NULL AND rec_id IS NOT NULL AND trim(body) <> ''")
    words_of = spark.sparkContext.broadcast(function)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen = Hashes()
        known = words_of.value
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("tab", "rec_id", "real", "words", "common", "phrases")}
            for tab, key, body in zip(b.column("tab").to_pylist(), b.column("rec_id").to_pylist(), b.column("body").to_pylist()):
                if (found := _judge(body, known)) is None or found[1] < min_words:
                    continue
                real, n, rest, common = found
                for k, v in (("tab", tab), ("rec_id", key), ("real", real), ("words", n), ("common", common), ("phrases", _phrases(rest, seen).tolist())):
                    out[k].append(v)
            yield out

    some = cut(map_batches(pages.select("tab", "rec_id", "body"), candidates, "tab string, rec_id long, real int, words int, common int, phrases array<long>"))
    some = some.where("common <= 0.05 * words").dropDuplicates(["tab", "rec_id", "phrases"])
    phrase = cut(some.select(F.explode("phrases").alias("p")).distinct())

    counted = _count_hosts(pages, phrase, min_hosts)
    held = some.select("tab", "rec_id", "words", F.size("phrases").alias("n"), F.explode("phrases").alias("p"))
    shared = held.join(counted, "p", "left").groupBy("tab", "rec_id", "words", "n").agg(F.count("shared").alias("shared"))
    return shared.where(F.col("shared") >= F.col("n") * min_share).groupBy("tab", "rec_id").agg(
        F.max("words").alias("words"), F.max("n").alias("phrases"), F.max("shared").alias("shared")
    )


def _count_hosts(pages: DataFrame, phrase: DataFrame, min_hosts: int) -> DataFrame:
    """(p, shared=true) of the candidate phrases that at least min_hosts distinct hosts of all pages carry."""
    spark = pages.sparkSession
    wide = phrase.count() > MOST_PHRASES
    wanted = None if wide else spark.sparkContext.broadcast(np.sort(np.array([r.p for r in phrase.toLocalIterator()], dtype=np.int64)))
    text = pages.select(F.when(F.col("host").isNull(), F.xxhash64("tab", "rec_id")).otherwise(F.xxhash64("host")).alias("h"), "body")

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen = Hashes()
        w = None if wanted is None else wanted.value
        likely = np.zeros(1 << 20, bool)  # by the upper 20 bits: most shingles are no candidates and end here
        if w is not None:
            likely[(w.view(np.uint64) >> np.uint64(44)).astype(np.int64)] = True
        for b in slices(batches, 500):
            host = b.column("h").to_numpy()
            lists = [WORD.findall(x.lower()) for x in b.column("body").to_pylist()]
            one = hash_words([w for x in lists for w in x], seen)
            if not len(one):
                continue
            of = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            pair = np.concatenate([_pairs(one), one])
            at = np.concatenate([of[1:], of])
            keep = np.concatenate([of[1:] == of[:-1], np.ones(len(one), bool)])
            if w is not None:
                keep &= likely[(pair >> np.uint64(44)).astype(np.int64)]
            pair, at = pair[keep].view(np.int64), at[keep]
            if w is not None and len(w):
                same = w[np.minimum(np.searchsorted(w, pair), len(w) - 1)] == pair
                pair, at = pair[same], at[same]
            if len(pair):
                both = np.unique(np.stack([pair, host[at]], 1), axis=0)
                yield {"p": both[:, 0], "h": both[:, 1]}

    found = map_batches(text, carried, "p long, h long")
    if wide:
        found = found.join(phrase, "p", "left_semi")
    return found.distinct().groupBy("p").count().where(F.col("count") >= min_hosts).select("p", F.lit(True).alias("shared"))


def spam_pages(docs: DataFrame | None, extracted: DataFrame | None, samples: DataFrame, **how) -> DataFrame:
    """Flagged records of both tables, or of the one given: (tab, rec_id, words, phrases, shared)."""
    from textharbor.llm.common import host_of

    parts = []
    if docs is not None:
        parts.append(docs.select(F.lit("docs").alias("tab"), F.col("doc_id").alias("rec_id"), host_of(F.col("url")).alias("host"), "body"))
    if extracted is not None:
        parts.append(extracted.select(F.lit("extracted").alias("tab"), F.col("page_id").alias("rec_id"), host_of(F.col("url")).alias("host"), "body"))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return keyword_pages(both, function_words(samples), **how)


def evidence(found: DataFrame, docs: DataFrame, extracted: DataFrame) -> DataFrame:
    """``found`` with lines, listed and linked: of the body's lines, those that end no sentence, and those that are a link's or an inbound anchor's text.

    It tells links from keywords on flagged pages; whether a page is flagged does not depend on its links and anchors.
    """
    from textharbor.llm.common import sized

    none = F.array().cast("array<string>")
    parts = [
        docs.select(F.lit("docs").alias("tab"), F.col("doc_id").alias("rec_id"), "body", F.coalesce("anchor_text", none).alias("anchors")),
        extracted.select(F.lit("extracted").alias("tab"), F.col("page_id").alias("rec_id"), "body", F.coalesce(F.transform("links", lambda x: x["anchor"]), none).alias("anchors")),
    ]
    form = lambda x: F.lower(F.trim(F.regexp_replace(x, r"[\s\p{Z}]+", " ")))
    rows = parts[0].unionByName(parts[1]).where("body IS NOT NULL").join(sized(cut(found)), ["tab", "rec_id"])
    rows = rows.withColumn("anchors", F.transform("anchors", form)).withColumn("forms", F.filter(F.transform(F.split("body", "\n"), form), lambda x: x != ""))
    listed = F.size(F.filter("forms", lambda x: ~x.rlike(r"[.!?…]$")))
    linked = F.size(F.filter("forms", lambda x: F.array_contains("anchors", x)))
    counts = F.max(F.struct(F.size("forms").alias("lines"), listed.alias("listed"), linked.alias("linked"))).alias("x")  # of rows of one key that differ, the longest
    return rows.groupBy(*found.columns).agg(counts).select(*found.columns, "x.lines", "x.listed", "x.linked")
