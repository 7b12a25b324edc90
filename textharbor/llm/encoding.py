"""Text that was decoded with the wrong encoding (problem 10).

A *run* is a maximal sequence of characters beyond ASCII, seen with the characters before and after it. Every run
is decoded by every candidate chain: encoded back with the wrongly used code page and decoded with the right
encoding, once or twice. Character n-gram models trained on clean records score the original and every candidate; the likeliest candidate is
accepted if it beats the original by a margin per character that clean records never reach (validated on them). Replacement characters
U+FFFD stand for lost text: such runs are reported as not recoverable.

The model counts hashed character trigrams and bigrams that touch a non-ASCII character, over all clean records (those without a run that decodes as UTF-8, a
control character or U+FFFD), in tables of fixed size, so the broadcast does not grow with the data.

A run is a quotation, not damage, when its line also holds the repaired form: text that tells what wrong decoding looks like.

Defined results: null and empty texts are sound; ties between chains go to the first in the list; runs that no chain explains stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textharbor.llm.common import cut, map_batches, sized

BUCKETS = 1 << 18
RUN = re.compile(r"[^\x00-\x7f]+")
LOST = re.compile("\ufffd+")
#: Smoothing of the n-gram counts.
ALPHA = 0.02
#: The least gains, in nats, that margins may ask of a run and of a line's runs.
LEAST_RUN, LEAST_LINE = 2.0, 12.0
# Pairs of code pages in which text is read wrongly and written rightly.
CHAINS = [
    ("cp1252", "utf-8"), ("latin-1", "utf-8"), ("mac_roman", "utf-8"), ("cp437", "utf-8"), ("cp850", "utf-8"), ("cp1251", "utf-8"), ("koi8-r", "utf-8"), ("cp866", "utf-8"), ("cp1250", "utf-8"), ("iso8859-15", "utf-8"),
    ("cp1252", "cp1251"), ("latin-1", "cp1251"), ("cp1252", "koi8-r"), ("latin-1", "koi8-r"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1252", "cp866"),
    ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp1251", "cp1252"), ("cp1250", "cp1252"), ("latin-1", "cp850"), ("latin-1", "mac_roman"), ("mac_cyrillic", "cp1251"), ("cp1251", "mac_cyrillic"), ("latin-1", "iso8859-5"),
]


def _encode(text: str, page: str) -> bytes | None:
    """Bytes of a text in a code page; in cp125x, undefined bytes stand for the control character of that number."""
    try:
        return text.encode(page)
    except UnicodeEncodeError:
        if not page.startswith("cp125"):
            return None
    out = bytearray()
    for c in text:
        try:
            out += c.encode(page)
        except UnicodeEncodeError:
            if not 0x80 <= ord(c) < 0xA0:
                return None
            out.append(ord(c))
    return bytes(out)


def candidates(run: str) -> list[tuple[str, str]]:
    """(chain, text) of every way to decode a run again, once or twice as UTF-8."""
    found: list[tuple[str, str]] = []
    seen = {run}

    def step(text: str, name: str, depth: int) -> None:
        for wrong, right in CHAINS:
            if depth and right != "utf-8":
                continue
            raw = _encode(text, wrong)
            if raw is None:
                continue
            try:
                out = raw.decode(right)
            except UnicodeDecodeError:
                continue
            if out in seen or any(0x80 <= ord(c) < 0xA0 for c in out) and right != "utf-8":
                continue
            seen.add(out)
            found.append((f"{name}{wrong}>{right}", out))
            if right == "utf-8" and depth < 2:
                step(out, f"{name}{wrong}>{right} ", depth + 1)

    step(run, "", 0)
    return found


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _buckets(a: np.ndarray, b: np.ndarray, c: np.ndarray | None) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + (np.uint64(7) if c is None else c * np.uint64(0x165667B19E3779F9) + np.uint64(11))
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(40)) % np.uint64(BUCKETS)


def _fold(codes: np.ndarray) -> np.ndarray:
    """ASCII letters, digits and other ASCII characters count as one each: what matters is what stands beyond ASCII."""
    out = codes.copy()
    ascii_ = codes < 128
    letter = ascii_ & (((codes | 32) >= 97) & ((codes | 32) <= 122))
    digit = ascii_ & (codes >= 48) & (codes <= 57)
    upper = letter & (codes < 97)
    blank = ascii_ & (codes <= 32)
    out[ascii_] = 1
    out[letter] = 2
    out[upper] = 3
    out[digit] = 4
    out[blank] = 5
    return out


def suspicious(text: str) -> bool:
    """Whether a text holds anything that shuts it out of the clean records."""
    for m in RUN.finditer(text):
        run = m.group()
        if any(c == "�" or 0x80 <= ord(c) < 0xA0 for c in run):
            return True
        if len(run) > 1:
            for wrong in ("cp1252", "mac_roman", "cp1251", "cp437", "latin-1"):
                raw = _encode(run, wrong)
                if raw is not None:
                    try:
                        raw.decode("utf-8")
                        return True
                    except UnicodeDecodeError:
                        pass
    return False


def train(documents: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts of trigrams (a, b, c) and of their contexts (a, b), in tables of BUCKETS entries, over all clean records."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        tri, bi = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        known: dict[str, bool] = {}
        for b in batches:
            clean = []
            for t in b.column("t").to_pylist():
                for m in RUN.finditer(t):
                    run = m.group()
                    bad = known.get(run)
                    if bad is None:
                        if len(known) > 500_000:
                            known.clear()
                        bad = known[run] = suspicious(run)
                    if bad:
                        break
                else:
                    clean.append(t)
            for low in range(0, len(clean), 256):
                raw = _codes("\n\n" + "\n\n".join(clean[low : low + 256]) + "\n\n")
                near = np.flatnonzero(raw >= 128)
                if not len(near):
                    continue
                at = np.unique(np.concatenate([near, near + 1]))  # places whose character or predecessor is beyond ASCII
                code = _fold(raw)
                tri += np.bincount(_buckets(code[at - 2], code[at - 1], code[at]).astype(np.int64), minlength=BUCKETS)
                bi += np.bincount(_buckets(code[at - 2], code[at - 1], None).astype(np.int64), minlength=BUCKETS)
        for kind, counts in ((0, tri), (1, bi)):
            used = np.flatnonzero(counts)
            yield {"kind": np.full(len(used), kind, np.int32), "bucket": used, "n": counts[used]}

    rows = documents.select(F.col(text).alias("t")).where(F.col(text).rlike(r"[^\x00-\x7F]"))
    counts = map_batches(rows, work, "kind int, bucket long, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n"))
    tables = (np.zeros(BUCKETS), np.zeros(BUCKETS))
    for r in counts.collect():  # at most 2 x BUCKETS rows
        tables[r.kind][r.bucket] = r.n
    return tables


class Scorer:
    """Verdicts on runs and lines by the gain in log-likelihood (nats) of the likeliest candidate."""

    def __init__(self, tri: np.ndarray, bi: np.ndarray) -> None:
        self.tri, self.bi = tri, bi
        self.known: dict[tuple[str, str, str], tuple[tuple[str, str, float] | None, dict[str, tuple[str, float]]]] = {}

    def total(self, before: str, run: str, after: str) -> float:
        code = _fold(_codes(before.rjust(2, "\n")[-2:] + run + (after or "\n")[:1]))
        a, b, c = code[:-2], code[1:-1], code[2:]
        n = self.tri[_buckets(a, b, c).astype(np.int64)]
        m = self.bi[_buckets(a, b, None).astype(np.int64)]
        return float(np.log((n + ALPHA) / (m + ALPHA * 200)).sum())

    def joint(self, before: str, run: str, after: str) -> float:
        """Log-frequency of a run's trigrams: texts garbled alike know each other's contexts, but are rare altogether."""
        code = _fold(_codes(before.rjust(2, "\n")[-2:] + run + (after or "\n")[:1]))
        return float(np.log(self.tri[_buckets(code[:-2], code[1:-1], code[2:]).astype(np.int64)] + 1).sum())

    def run(self, before: str, run: str, after: str) -> tuple[tuple[str, str, float] | None, dict[str, tuple[str, float]]]:
        """(best chain through UTF-8, its text and gain, or None; single-byte chains with text and gain)."""
        key = (before, run, after)
        if key not in self.known:
            if len(self.known) > 300_000:
                self.known.clear()
            own, frequent = self.total(*key), self.joint(*key)
            best, single = None, {}
            for chain, text in candidates(run):
                if chain.endswith("utf-8"):
                    gain = self.total(before, text, after) - own
                    if best is None or gain > best[2]:
                        best = (chain, text, gain)
                else:
                    single[chain] = (text, self.joint(before, text, after) - frequent)
            self.known[key] = (best, single)
        return self.known[key]

    def line(self, line: str, margin: float, line_margin: float) -> list[tuple[int, int, str, str]]:
        """(start, end, chain, repaired) of the damaged runs of a line.

        UTF-8 hardly ever decodes by chance, so each run is judged by itself. Single-byte chains always decode: one
        counts only if it clearly fits neighbouring runs together, all those of the line or some.
        """
        found, rest = [], []
        for m in RUN.finditer(line):
            run, at, to = m.group(), m.start(), m.end()
            if "\ufffd" in run:
                continue
            best, single = self.run("".join(map(_kind, line[max(0, at - 2) : at])), run, _kind(line[to : to + 1]))
            if best is not None and best[2] >= margin:
                if not _quoted(line, at, to, best[1]):
                    found.append((at, to, best[0], best[1]))
            else:
                rest.append((at, to, run, single))
        part = self.segment([single for *_, single in rest], line_margin)
        if part is not None:
            gain, chain, low, high = part
            letters = sum(len(run) for _, _, run, _ in rest[low:high])
            whole = high - low == len(rest)
            if gain >= (1.5 if whole else 3) * letters and letters >= (3 if whole else 4):
                found += [(at, to, chain, single[chain][0]) for at, to, _, single in rest[low:high]]
        return sorted(found)

    @staticmethod
    def segment(runs: list[dict[str, tuple[str, float]]], least: float) -> tuple[float, str, int, int] | None:
        """(gain, chain, first, end) of the neighbouring runs that one chain gains most on; None if that is under ``least``."""
        if sum(max(0.0, max((g for _, g in single.values()), default=0.0)) for single in runs) < least:
            return None
        best = None
        for chain in dict.fromkeys(c for single in runs for c, (_, g) in single.items() if g > 0):
            gain, low = 0.0, 0
            for i, single in enumerate(runs):
                if chain not in single:
                    gain, low = 0.0, i + 1
                    continue
                gain += single[chain][1]
                if gain <= 0:
                    gain, low = 0.0, i + 1
                elif gain >= least and (best is None or gain > best[0]):
                    best = gain, chain, low, i + 1
        return best


def survey(documents: DataFrame, key: str, text: str, tables: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(kind, key, gain, n) over all records; kinds are

    line: how much the best single-byte chain gains on neighbouring runs of a line, in whole nats, and the number of such lines, of all lines beyond ASCII in clean records;
    run: how much the best chain through UTF-8 gains on a run, of all runs that have one, in any record;
    key: records that could be damaged by the least of all margins, once per row: no others need be judged again.
    Gains count as -100 below and as 1000 above that, so a histogram is as small as its range.
    """
    shared = documents.sparkSession.sparkContext.broadcast(tables)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        score, count = Scorer(*shared.value), np.zeros((2, 1101), np.int64)
        known: dict[str, bool] = {}
        place = lambda gain: int(np.floor(min(max(gain, -100.0), 1000.0))) + 100
        for b in batches:
            keys = []
            for k, t in zip(b.column("k").to_pylist(), b.column("t").to_pylist()):
                if len(known) > 500_000:
                    known.clear()
                found = {m.group() for m in RUN.finditer(t)}
                for run in found:
                    if run not in known:
                        known[run] = suspicious(run)
                clean = not any(known[run] for run in found)
                possible = not clean
                for line in t.split("\n"):
                    if line.isascii() or not clean and not any(known[m.group()] for m in RUN.finditer(line)):
                        continue
                    runs = [score.run("".join(map(_kind, line[max(0, m.start() - 2) : m.start()])), m.group(), _kind(line[m.end() : m.end() + 1])) for m in RUN.finditer(line)]
                    for best, _ in runs:
                        if best is not None:
                            count[1, place(best[2])] += 1
                            possible |= best[2] >= LEAST_RUN
                    if clean:
                        best = score.segment([single for _, single in runs], 0.0)
                        count[0, place(best[0] if best else 0.0)] += 1
                        possible |= best is not None and best[0] >= LEAST_LINE
                if possible:
                    keys.append(k)
            yield {"kind": ["key"] * len(keys), "key": keys, "gain": [0] * len(keys), "n": [1] * len(keys)}
        kind, at = np.nonzero(count)
        yield {"kind": pa.array(["line", "run"]).take(pa.array(kind)), "key": [None] * len(at), "gain": (at - 100).astype(np.int32), "n": count[kind, at]}

    return cut(map_batches(_rows(documents, key, text), work, "kind string, key long, gain int, n long"))


def _rows(documents: DataFrame, key: str, text: str) -> DataFrame:
    return documents.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where(F.col("k").isNotNull() & F.col("t").rlike(r"[^\x00-\x7F]"))


def line_margin(gain: np.ndarray, n: np.ndarray, least: float = LEAST_LINE) -> float:
    """The gain that single-byte chains must reach: 10 nats above what nine tenths of the sound lines of all clean records reach.

    Lines read in a wrong single-byte page are among them. Where they form a mode of their own, the emptiest 10 nats from a gain of 0 on part
    them from the sound lines: those hold less than a tenth of the lines above them.
    """
    held = lambda low, high: int(n[(gain >= low) & (gain < high)].sum())
    valley = min(range(0, 51), key=lambda g: held(g, g + 10))
    if held(valley, valley + 10) * 10 < held(valley + 10, 1001):
        gain, n = gain[gain < valley], n[gain < valley]
    if not n.sum():
        return least
    # within the sound lines, up to a tenth may still be misread ones of few letters
    return max(least, float(gain[np.searchsorted(np.cumsum(n), 0.9 * n.sum())]) + 11.0)


def run_margin(gain: np.ndarray, n: np.ndarray, usual: float = 4.0, most: int = 12) -> float:
    """The gain that chains through UTF-8 must reach: the middle of the emptiest 4 nats between 0 and ``most``, of equally empty ones the nearest to ``usual``.

    Runs that decode as UTF-8 by chance or are meant as they stand gain nothing by it, misread ones gain much.
    """
    held = lambda low: int(n[(gain >= low) & (gain < low + 4)].sum())
    return min((held(g), abs(g + 2 - usual), g + 2.0) for g in range(most - 3))[2]


def validated_margins(found: DataFrame) -> dict[str, float]:
    """margin and line_margin of ``garbled``, from the gains that ``survey`` counted over all records."""
    rows = found.where("kind <> 'key'").groupBy("kind", "gain").agg(F.sum("n").alias("n")).orderBy("kind", "gain").collect()  # some 2,200 rows at most
    histogram = {k: [np.array([r[c] for r in rows if r.kind == k], dtype=np.int64) for c in ("gain", "n")] for k in ("line", "run")}
    return {"margin": run_margin(*histogram["run"]), "line_margin": line_margin(*histogram["line"])}


def garbled(documents: DataFrame, key: str, text: str, tables: tuple[np.ndarray, np.ndarray], margin: float = 4.0, line_margin: float = LEAST_LINE, repair: bool = False, found: DataFrame | None = None) -> DataFrame:
    """(key, runs, lost, chain[, repaired]): damaged records with the number of repairable and of lost runs, and the chain used most.

    found: of ``survey``; records that it ruled out are not judged again.
    """
    shared = documents.sparkSession.sparkContext.broadcast(tables)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        score = Scorer(*shared.value)
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("key", "runs", "lost", "chain", "repaired")}
            for key, t in zip(b.column("k").to_pylist(), b.column("t").to_pylist()):
                fixed, lost, used, lines = 0, 0, {}, []
                for line in t.split("\n"):
                    if line.isascii():
                        lines.append(line)
                        continue
                    lost += len(LOST.findall(line))
                    last, parts = 0, []
                    for at, to, chain, right in score.line(line, margin, line_margin):
                        fixed += 1
                        used[chain] = used.get(chain, 0) + 1
                        parts += [line[last:at], right]
                        last = to
                    lines.append("".join([*parts, line[last:]]))
                if fixed or lost:
                    for name, v in (("key", key), ("runs", fixed), ("lost", lost), ("chain", max(used, key=used.get) if used else None), ("repaired", "\n".join(lines) if repair else None)):
                        out[name].append(v)
            yield out

    rows = _rows(documents, key, text)
    if found is not None:
        rows = rows.join(sized(cut(found.where("kind = 'key'").select(F.col("key").alias("k")).distinct())), "k", "left_semi")
    found = map_batches(rows, work, "key long, runs int, lost int, chain string, repaired string").withColumnRenamed("key", key)
    return found if repair else found.drop("repaired")


def _kind(c: str) -> str:
    """A neighbour as the model sees it, so that runs in like places share one verdict."""
    if not c:
        return "\n"
    if c > "\x7f":
        return c
    return " " if c <= " " else "a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else "."


def _quoted(line: str, at: int, to: int, right: str) -> bool:
    """Whether the line shows the repaired form too, both standing alone."""
    alone = (at == 0 or not line[at - 1].isalpha()) and (to == len(line) or not line[to].isalpha())
    return alone and re.search(rf"(?<!\w){re.escape(right)}(?!\w)", line.replace(line[at:to], "\x00")) is not None
