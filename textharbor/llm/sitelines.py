"""Lines repeated across one site's documents (problem 1).

Lines are compared in one form: lower case, outer blanks gone, runs of blanks one blank, each run of digits ``0``.

1. *Summaries.* A host's lines are cut into ranges of their hashes, so many that each holds about ``counters * min_docs / SPARE``
   occurrences. Every partition keeps per host and range a bounded summary (at most ``counters`` lines with counts). What exceeds
   it is pruned as in mergeable Misra-Gries summaries: the first count that does not fit is taken off all others and
   remembered as the summary's error. Summaries merge in a tree by adding counts and errors, and are pruned again at each level, so
   none is ever larger. ``count + error`` never falls short of the true number, and the error of a merged summary is at most
   its occurrences / ``counters``, far below ``min_docs``.
2. *Candidates.* Lines whose bound reaches ``min_docs``: at most one per ``min_docs - error`` occurrences. Should the error alone reach it (a
   range that came out far too full), all lines of that range are candidates; nothing can be missed.
3. *Exact counts* of the candidates in a second pass, in different documents.
4. *Removal.* Confirmed (host, line) pairs meet every document's lines: by broadcast if their number is small enough,
   else by a shuffle join.

Defined results: documents without url, or whose url has no host, have no host and keep every line; null and empty
bodies have no lines; empty lines are never removed but keep their numbers; repeated rows of one doc_id count once (of
rows of one doc_id that differ, one is taken).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textharbor.llm.common import cut, host_of, map_batches, sized

MIN_DOCS = 10
COUNTERS = 4096
#: A merged summary's error stays under min_docs / SPARE in a range of mean size.
SPARE = 4
#: Summaries of one range that one task of the merging tree's first level takes.
FAN = 16


def line_form(line: Column) -> Column:
    """The form in which lines are compared."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(line), r"[\s\p{Z}\x{200B}\x{FEFF}]+", " ")), r"\p{Nd}+", "0")


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, host, lines): 64-bit hashes of a document's lines in order, null for empty ones."""
    forms = F.transform(F.split("body", "\n"), lambda x: line_form(x))
    hashed = F.transform(forms, lambda x: F.when(x != "", F.xxhash64(x)))
    rows = docs.select("doc_id", host_of(F.col("url")).alias("host"), "body").where("host IS NOT NULL AND body IS NOT NULL AND body <> ''")
    rows = rows.select("doc_id", "host", hashed.alias("lines"))
    return rows.groupBy("doc_id").agg(F.min(F.struct("host", "lines")).alias("x")).select("doc_id", "x.host", "x.lines")


def _prune(value: np.ndarray, count: np.ndarray, counters: int) -> tuple[np.ndarray, np.ndarray, int]:
    """At most ``counters`` lines of a summary, and what was taken off each of them."""
    if len(value) <= counters:
        return value, count, 0
    off = int(np.partition(count, len(count) - counters - 1)[len(count) - counters - 1])
    return value[count > off], count[count > off] - off, off


def _rows(group: np.ndarray, value: np.ndarray, count: np.ndarray, error: np.ndarray) -> dict:
    """Output of summaries: group is (host hash, range) per line."""
    return {"h": group[:, 0], "part": group[:, 1].astype(np.int32), "line": value, "seen": count, "error": error}


_SCHEMA = "h long, part int, slice int, line long, seen long, error long"


def summaries(lines: DataFrame, min_docs: int = MIN_DOCS, counters: int = COUNTERS) -> DataFrame:
    """Merged summaries (h, part, line, seen, error) of ``lines(h, parts, lines)``: h is a host's hash, part one of its ``parts`` ranges.

    A range's error stands in rows of their own, with line null.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        slice_ = TaskContext.get().partitionId() % FAN
        kept: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        error: dict[tuple[int, int], int] = {}
        for b in batches:
            size = pc.list_value_length(b.column("lines")).to_numpy(zero_copy_only=False)
            h, parts = (np.repeat(b.column(c).to_numpy(), size) for c in ("h", "parts"))
            line = b.column("lines").flatten().to_numpy()
            part = ((line.view(np.uint64) >> np.uint64(1)) % parts.astype(np.uint64)).astype(np.int64)
            order = np.lexsort((line, part, h))
            h, part, line = h[order], part[order], line[order]
            new_group = np.concatenate([[True], (h[1:] != h[:-1]) | (part[1:] != part[:-1])]) if len(h) else np.zeros(0, bool)
            first = np.flatnonzero(new_group | np.concatenate([[True], line[1:] != line[:-1]])) if len(h) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(h)))
            starts = np.flatnonzero(new_group[first])
            for low, high in zip(starts, np.append(starts[1:], len(first))):
                at = first[low]
                key = int(h[at]), int(part[at])
                value, count = line[first[low:high]], times[low:high]
                if key in kept:
                    v, c = kept[key]
                    value, inverse = np.unique(np.concatenate([v, value]), return_inverse=True)
                    count = np.bincount(inverse, weights=np.concatenate([c, count])).astype(np.int64)
                value, count, off = _prune(value, count, counters)
                if off:
                    error[key] = error.get(key, 0) + off
                kept[key] = value, count
        for key in kept:
            value, count = kept[key]
            n = len(value)
            yield {"h": np.full(n, key[0]), "part": np.full(n, key[1], np.int32), "slice": np.full(n, slice_, np.int32), "line": value, "seen": count, "error": np.zeros(n, np.int64)}
        if error:
            groups = np.array(list(error), dtype=np.int64).reshape(-1, 2)
            yield _rows(groups, [None] * len(error), [0] * len(error), np.array(list(error.values()))) | {"slice": np.full(len(error), slice_, np.int32)}

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """Of rows sorted by (h, part, slice), one pruned summary each."""

        def done(parts: list[pa.RecordBatch]) -> dict:
            x = pa.Table.from_batches(parts).combine_chunks()
            h, part, slice_, line = x["h"].to_numpy(), x["part"].to_numpy().astype(np.int64), x["slice"].to_numpy(), x["line"]
            is_line = line.is_valid().to_numpy(zero_copy_only=False)
            line = line.fill_null(0).to_numpy()
            seen, err = x["seen"].to_numpy(), x["error"].to_numpy()
            order = np.lexsort((line, ~is_line, slice_, part, h))
            h, part, slice_, line, is_line, seen, err = (y[order] for y in (h, part, slice_, line, is_line, seen, err))
            new_group = _changes(h, part, slice_)
            first = np.flatnonzero(new_group | np.concatenate([[True], (line[1:] != line[:-1]) | (is_line[1:] != is_line[:-1])]))
            seen, err = np.add.reduceat(seen, first), np.add.reduceat(err, first)
            h, part, line, is_line = h[first], part[first], line[first], is_line[first]
            group = np.cumsum(new_group[first]) - 1
            size = np.bincount(group, weights=is_line).astype(np.int64)
            keep = np.ones(len(h), bool)
            extra: list[tuple[int, int, int]] = []
            for g in np.flatnonzero(size > counters):
                low = np.searchsorted(group, g)
                rows = slice(low, low + size[g])  # a group's lines come before its error
                off = _prune(line[rows], seen[rows], counters)[2]
                seen[rows] -= off
                keep[rows] = seen[rows] > 0
                extra.append((int(h[low]), int(part[low]), off))
            out = {"h": h[keep], "part": part[keep].astype(np.int32), "line": pa.array(line[keep], mask=~is_line[keep]), "seen": seen[keep], "error": err[keep]}
            if extra:
                e = np.array(extra, dtype=np.int64)
                out = {
                    "h": np.concatenate([out["h"], e[:, 0]]),
                    "part": np.concatenate([out["part"], e[:, 1].astype(np.int32)]),
                    "line": pa.concat_arrays([out["line"], pa.nulls(len(e), pa.int64())]),
                    "seen": np.concatenate([out["seen"], np.zeros(len(e), np.int64)]),
                    "error": np.concatenate([out["error"], e[:, 2]]),
                }
            return out | {"slice": np.zeros(len(out["h"]), np.int32)}

        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            keys = [b.column(c).to_numpy() for c in ("h", "part", "slice")]
            start = int(np.flatnonzero(_changes(*keys))[-1])  # where the last group begins: it may go on in the next batch
            if start or held and any(held[0].column(c)[0].as_py() != k[0] for c, k in zip(("h", "part", "slice"), keys)):
                yield done([*held, b.slice(0, start)])
                held = []
            held.append(b.slice(start))
        if held:
            yield done(held)

    made = map_batches(lines.select("h", "parts", F.array_compact(F.array_distinct("lines")).alias("lines")), summarise, _SCHEMA)
    for level in range(2):  # of the merging tree: FAN-th parts of a range, then ranges
        keys = ("h", "part", "slice")[: 3 - level]
        made = map_batches(made.repartition(*keys).sortWithinPartitions("h", "part", "slice"), merge, _SCHEMA)
    return made.drop("slice")


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the row before."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def ranged(lines: DataFrame, min_docs: int = MIN_DOCS, counters: int = COUNTERS) -> DataFrame:
    """``lines(doc_id, host, lines)`` with h, the host's hash, and parts, its number of ranges."""
    lines = lines.withColumn("h", F.xxhash64("host"))
    total = lines.groupBy("h").agg(F.sum(F.size("lines")).alias("n"))
    large = total.select("h", F.ceil(F.col("n") * SPARE / (counters * min_docs)).cast("int").alias("parts")).where("parts > 1")
    return lines.join(sized(cut(large)), "h", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))


def candidates(lines: DataFrame, min_docs: int = MIN_DOCS, counters: int = COUNTERS) -> tuple[DataFrame, DataFrame]:
    """(h, line) of the lines that may repeat often enough, and (h, part) of the ranges all of whose lines may. lines: as of ``ranged``."""
    found = cut(summaries(lines, min_docs, counters))
    errors = cut(found.where("line IS NULL").groupBy("h", "part").agg(F.sum("error").alias("error")))
    bound = found.where("line IS NOT NULL").drop("error").join(sized(errors), ["h", "part"], "left").withColumn("error", F.coalesce("error", F.lit(0)))
    likely = bound.where((F.col("seen") + F.col("error") >= min_docs) & (F.col("error") < min_docs)).select("h", "line")
    return cut(likely), errors.where(F.col("error") >= min_docs).select("h", "part")


def repeated_lines(lines: DataFrame, min_docs: int = MIN_DOCS, counters: int = COUNTERS) -> DataFrame:
    """(h, line, docs) of every line that at least min_docs different documents of its host hold. lines: as of ``ranged``."""
    likely, full = candidates(lines, min_docs, counters)
    each = lines.select("h", "parts", F.explode(F.array_distinct("lines")).alias("line")).where("line IS NOT NULL")
    chosen = each.select("h", "line").join(sized(likely), ["h", "line"], "left_semi")
    if full.limit(1).count():
        part = F.pmod(F.shiftrightunsigned("line", 1), F.col("parts").cast("long")).cast("int")
        chosen = chosen.unionByName(each.withColumn("part", part).join(sized(full), ["h", "part"], "left_semi").select("h", "line"))
    return chosen.groupBy("h", "line").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs)


def found_lines(docs: DataFrame, min_docs: int = MIN_DOCS, counters: int = COUNTERS) -> DataFrame:
    """(doc_id, line_no, host, docs) of every repeated line of every document."""
    lines = cut(ranged(cut(_lines(docs)), min_docs, counters))
    confirmed = sized(cut(repeated_lines(lines, min_docs, counters)))
    each = lines.select("doc_id", "host", "h", F.posexplode("lines").alias("line_no", "line")).where("line IS NOT NULL")
    return each.join(confirmed, ["h", "line"]).select("doc_id", "line_no", "host", "docs")


def host_summary(docs: DataFrame, min_docs: int = MIN_DOCS, counters: int = COUNTERS) -> DataFrame:
    """(host, lines, distinct_lines, candidates, repeated) per host: what the summaries let through, and what the exact count confirmed."""
    lines = cut(ranged(cut(_lines(docs)), min_docs, counters))
    likely, full = candidates(lines, min_docs, counters)
    confirmed = cut(repeated_lines(lines, min_docs, counters))
    each = lines.select("host", "h", F.explode("lines").alias("line")).where("line IS NOT NULL")
    out = each.groupBy("host", "h", "line").agg(F.count("*").alias("n")).groupBy("host", "h").agg(F.sum("n").alias("lines"), F.count("*").alias("distinct_lines"))
    for name, rows in (("candidates", likely), ("repeated", confirmed)):
        out = out.join(rows.groupBy("h").agg(F.count("*").alias(name)).hint("merge"), "h", "left").fillna(0, [name])
    return out.drop("h")


def without_repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, counters: int = COUNTERS) -> DataFrame:
    """``docs`` with ``clean_body`` (the body without the repeated lines) and ``removed`` (their number); one row per row.

    Confirmed lines are gathered per document, so bodies are shuffled only where a document lost lines at all.
    """
    lost = found_lines(docs, min_docs, counters).groupBy("doc_id").agg(F.collect_set("line_no").alias("__lost"))
    kept = F.filter(F.split("body", "\n"), lambda x, i: ~F.array_contains("__lost", i))
    return (
        docs.join(sized(cut(lost)), "doc_id", "left")
        .withColumn("clean_body", F.when(F.col("__lost").isNull(), F.col("body")).otherwise(F.array_join(kept, "\n")))
        .withColumn("removed", F.when(F.col("__lost").isNull(), 0).otherwise(F.size("__lost")))
        .drop("__lost")
    )
