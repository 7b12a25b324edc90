"""New batches against all accepted history (problem 7).

Two texts *repeat* each other when their words, split at blanks and in lower case, have a longest common subsequence of at least
``share`` of the longer one's words. ``max(n_a, n_b) - LCS`` is a metric; call it the word distance.

``repeats`` finds all such pairs of a later and an earlier batch, the earlier one being no repeat itself:

1. One pass over the texts yields a narrow signature per document: a hash of all words, their number, minima of the hashes of five
   consecutive long words (``BINS`` of them; all hashes where a text has at most ``SHORT``), and a sketch of its word bag.
2. Equal texts form a class; one signature per class goes on.
3. Classes that share a minimum are candidates, however many share it: buckets of more than ``hot`` classes are only cut into blocks, each
   pair of blocks being met by one task. Within a bucket, pairs whose lengths or sketches differ by more than a repeat may are left out: both
   are bounds of the word distance, so no repeat is lost here.
4. The LCS of candidates decides.
5. Originals are told from repeats batch by batch along the links; only originals are reported as the earlier one.

``repeats_of_history`` does the same for one new batch against stored signatures of the originals of all earlier ones (``append``): only the new
texts are read and signed; of old texts, those of candidates are fetched.

With ``pivots`` both find candidates by the pivot-distance table instead of steps 1 and 3: distances of every text to fixed pivots, in the metric of word
bags, whose triangle inequality prunes pairs of texts; the true word distance verifies. Nothing is left to chance there: every pair within the rule comes out.
A single pivot prunes little at this radius, a fifth of the longer text: it admits differences of 0.4 n between pivot distances, whose spread between
unrelated texts is about the square root of n (``tests/llm/pivot_figures.py`` counts what is left). So the table also holds, cut to one bit each, the
distances to some four to eight pivots per word of the text, which share no words: their differences add up (``_pivot_links``). All pairs of texts of
similar length are met, so comparisons grow with the square of the table.

``pivot_pairs`` is the same for a small radius in words, for which single pivots prune: a join over ranges of the table. It takes stored rows likewise.

Defined results: null bodies and those under ``min_words`` words never count; null keys or batches are left out; repeated rows of one
key count once; equal texts of one batch do not repeat each other.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textharbor.llm.common import Hashes, cut, hash_words, map_batches, sized

SHARE = 0.8
MIN_WORDS = 40
BINS = 32
#: Texts of so many shingles or fewer keep the hashes of all.
SHORT = 64
SHINGLE = 5
LONG = 4
#: Classes of a bucket from which on it is cut into blocks of about so many. It bounds a task's memory, not the results.
HOT = 2000
#: Counters of a word bag's sketch.
BAG = 64
PIVOTS = 12
#: Words of the texts of a block that ``_pivot_links`` compares with another. It bounds a task's memory, not the results.
BLOCK = 1 << 22
_B = 0x9E3779B97F4A7C15


def signatures(docs: DataFrame, key: str, text: str, batch: str, min_words: int = MIN_WORDS, pivots: bool = False) -> DataFrame:
    """(key, batch, text_hash, n, signs, bag) of every row with min_words words or more. signs: the minima, or with ``pivots`` the pivot distances.
    bag: the words counted in BAG counters by their hashes, up to 255 in each, or with ``pivots`` a bit for each counter that is not zero (``_bits``).

    Pivot distances: for PIVOTS fixed halves of all words, the words in it minus those outside. It is, up to a constant, the distance
    of the word bag to the bag that holds that half without limit.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen = Hashes()
        for b in batches:
            keys, segs, texts = b.column("k").to_numpy(), b.column("s").to_numpy(), b.column("t").to_pylist()
            for low in range(0, len(keys), 500):
                lists = [t.lower().split() for t in texts[low : low + 500]]
                count = np.array([len(x) for x in lists], dtype=np.int64)
                use = np.flatnonzero(count >= min_words)
                lists, count = [lists[i] for i in use], count[use]
                if not len(use):
                    continue
                flat = [w for x in lists for w in x]
                h = hash_words(flat, seen)
                of = np.repeat(np.arange(len(use)), count)
                start = np.cumsum(count) - count
                with np.errstate(over="ignore"):
                    weight = (np.arange(len(h)) - np.repeat(start, count)).astype(np.uint64) * np.uint64(_B) | np.uint64(1)
                    mixed = (h ^ (h >> np.uint64(31))) * weight
                    whole = np.bitwise_xor.reduceat(mixed * np.uint64(0xBF58476D1CE4E5B9) ^ (mixed >> np.uint64(27)), start)
                    whole ^= np.add.reduceat(mixed, start) * np.uint64(0xD1B54A32D192ED03)
                if pivots:
                    halves = [((h >> np.uint64(k + 3)) & np.uint64(1)).astype(np.int64) * 2 - 1 for k in range(PIVOTS)]
                    # clipped to 16 bits, which moves no two distances apart: the bound still holds
                    signs = list(np.clip(np.stack([np.add.reduceat(s, start) for s in halves], 1), -32768, 32767).astype(np.int16))
                    yield {"key": keys[low + use], "batch": segs[low + use], "text_hash": whole.view(np.int64), "n": count, "signs": signs, "bag": _bits(h, of, count)}
                    continue
                # words of LONG letters or more; all words where a text has too few of them
                long = np.fromiter(map(len, flat), dtype=np.int64, count=len(flat)) >= LONG
                few = np.add.reduceat(long.astype(np.int64), start) < 2 * SHINGLE
                long |= few[of]
                g, o = h[long], of[long]
                with np.errstate(over="ignore"):
                    run = np.zeros(max(0, len(g) - SHINGLE + 1), np.uint64)
                    for j in range(SHINGLE):
                        run = run * np.uint64(_B) + g[j : len(g) - SHINGLE + 1 + j]
                    run = (run ^ (run >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
                    run ^= run >> np.uint64(29)
                same = o[SHINGLE - 1 :] == o[: len(g) - SHINGLE + 1]
                run, at = run[same], o[: len(g) - SHINGLE + 1][same]
                slot = at * BINS + (run % np.uint64(BINS)).astype(np.int64)
                order = np.lexsort((run, slot))
                slot, run = slot[order], run[order]
                all_ = (np.bincount(at, minlength=len(use)) <= SHORT)[slot // BINS]
                first = np.concatenate([[True], (slot[1:] != slot[:-1]) | all_[1:] & (run[1:] != run[:-1])]) if len(slot) else np.zeros(0, bool)
                least, owner = run[first].view(np.int64), slot[first] // BINS
                ends = np.searchsorted(owner, np.arange(len(use) + 1))
                signs = [least[ends[i] : ends[i + 1]] for i in range(len(use))]
                bags = np.bincount(of * BAG + ((h >> np.uint64(40)) % np.uint64(BAG)).astype(np.int64), minlength=len(use) * BAG)
                bags = [x.tobytes() for x in np.minimum(bags, 255).astype(np.uint8).reshape(-1, BAG)]
                yield {"key": keys[low + use], "batch": segs[low + use], "text_hash": whole.view(np.int64), "n": count, "signs": signs, "bag": bags}

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(batch).cast("long").alias("s"), F.col(text).alias("t")).where("k IS NOT NULL AND s IS NOT NULL AND t IS NOT NULL")
    return map_batches(rows, work, f"key long, batch long, text_hash long, n int, signs array<{'smallint' if pivots else 'long'}>, bag binary")


def _bits(h: np.ndarray, of: np.ndarray, count: np.ndarray) -> list[bytes]:
    """Bitmaps of texts, given the hashes h of their words, the text ``of`` each word and the number of words of each text.

    The first, second ... occurrence of a word in a text are different things, each of which sets the bit of its hash. So two texts differ in at most as many bits as
    their word bags differ in words. A map has 4 to 8 bits a word, 512 at least: a power of two, and halves laid over each other give the smaller map.
    """
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    first = np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])])
    at = np.flatnonzero(first)
    nth = (np.arange(len(h)) - at[np.cumsum(first) - 1]).astype(np.uint64)
    with np.errstate(over="ignore"):
        mixed = (h + nth * np.uint64(_B)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
    width = np.maximum(512, 4 << np.ceil(np.log2(count)).astype(np.int64))
    end = np.cumsum(width)
    flags = np.zeros(end[-1], dtype=bool)
    flags[(end - width)[of] + (mixed & (width[of] - 1).astype(np.uint64)).astype(np.int64)] = True
    whole = np.packbits(flags, bitorder="little").tobytes()
    return [whole[(e - w) // 8 : e // 8] for e, w in zip(end.tolist(), width.tolist())]


def known_hashes(docs: DataFrame, state: DataFrame) -> DataFrame:
    """(doc_id, accepted): documents whose content hash was accepted under a smaller doc_id, by ``state(doc_id, exact)``.

    Hashes are compared in lower case; null hashes match nothing; repeated rows count once. Only the narrow columns are read.
    """
    first = state.where("exact IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.lower("exact").alias("h")).agg(F.min("doc_id").alias("accepted"))
    new = docs.where("content_hash IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.lower("content_hash").alias("h")).distinct()
    return new.join(first, "h").where("accepted < doc_id").groupBy("doc_id").agg(F.min("accepted").alias("accepted"))


def append(table: DataFrame, path: str) -> None:
    """Add rows to a stored table, one folder per batch. A batch that is written again replaces itself, so a repeated run adds nothing twice."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & where.get(w, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def _distances(pairs: DataFrame, docs: DataFrame, key: str, text: str, share: float | None = None, radius: int | None = None) -> DataFrame:
    """(a, b, distance) of the pairs within ``share`` of the longer text or within ``radius`` words."""
    ids = sized(cut(pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct()))
    texts = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).join(ids, "k", "left_semi").dropDuplicates(["k"])
    texts = cut(texts)
    texts = texts.hint("merge")  # whole texts are never broadcast
    both = pairs.join(texts.select(F.col("k").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("k").alias("b"), F.col("t").alias("tb")), "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for x in batches:
            out: dict[str, list] = {"a": [], "b": [], "distance": []}
            for a, b, ta, tb in zip(*(x.column(c).to_pylist() for c in ("a", "b", "ta", "tb"))):
                u, v = ta.lower().split(), tb.lower().split()
                n = max(len(u), len(v))
                need = n - radius if share is None else share * n
                if min(len(u), len(v)) < need or sum(map(set(v).__contains__, u)) < need or sum((Counter(u) & Counter(v)).values()) < need:
                    continue
                if (common := lcs(u, v)) >= need:
                    out["a"].append(a)
                    out["b"].append(b)
                    out["distance"].append(n - common)
            yield out

    return map_batches(both.select("a", "b", "ta", "tb"), work, "a long, b long, distance int")


def _members(signs: DataFrame) -> DataFrame:
    """(key, batch, rep, n): one row per key, with the smallest key of those with an equal text."""
    rows = signs.groupBy("key").agg(F.min(F.struct("batch", "text_hash", "n")).alias("x")).select("key", "x.*")
    rep = rows.groupBy("text_hash", "n").agg(F.min("key").alias("rep"))
    return rows.join(rep, ["text_hash", "n"]).select("key", "batch", "rep", "n")


def _near(v: np.ndarray, side: np.ndarray, new: np.ndarray, n: np.ndarray, bags: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs of one bucket whose lengths and bags allow them to repeat each other; rows in the order of (v, n).

    side: 0 and 1 are paired with each other only, 2 with all of their bucket. new: pairs without a new one are left out.
    """
    left, right = [], []
    end = np.searchsorted(v, v, side="right")
    i, d = np.arange(len(v)), 1
    while True:
        i = i[i + d < end[i]]
        i = i[n[i] >= n[i + d] * share]  # those after i + d are longer still
        if not len(i):
            break
        at = i[((side[i] != side[i + d]) | (side[i] == 2)) & (new[i] | new[i + d])]
        for low in range(0, len(at), 4096):
            x = at[low : low + 4096]
            a, b = bags[x], bags[x + d]
            apart = (np.maximum(a, b) - np.minimum(a, b)).sum(1, dtype=np.int32)
            x = x[apart <= n[x] + n[x + d] - 2 * share * n[x + d] + 1e-6]
            left.append(x)
            right.append(x + d)
        d += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _links(signs: DataFrame, docs: DataFrame, key: str, text: str, share: float, hot: int) -> DataFrame:
    """(a, b, distance): keys, one per distinct text, whose texts repeat each other. signs.new, where there is such a column: pairs of two old texts are left out."""
    new = F.max("new") if "new" in signs.columns else F.lit(True)
    reps = signs.groupBy("text_hash", "n").agg(F.min(F.struct("key", "signs", "bag")).alias("x"), new.alias("new"))
    reps = cut(reps.select(F.col("x.key").alias("k"), "n", "x.signs", "x.bag", "new"))
    values = reps.select(F.explode("signs").alias("v"), "k", "new")
    counts = values.groupBy("v").agg(F.count("*").alias("count"), F.max("new").alias("asked")).where("count > 1 AND asked").select("v", "count")
    shared = cut(values.join(sized(cut(counts)), "v"))  # most minima are a text's own
    # blocks of a bucket: each pair of blocks, and each block with itself, is a bucket of its own
    blocks = F.ceil(F.col("count") / hot).cast("int")
    own = F.pmod(F.xxhash64("k"), blocks).cast("int")
    other = F.explode(F.when(blocks > 1, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.lit(0)))).alias("other")
    placed = shared.select("v", "k", "new", own.alias("own"), other)
    cell = F.when((F.col("own") == 0) & (F.col("other") == 0), F.col("v")).otherwise(F.xxhash64("v", F.least("own", "other"), F.greatest("own", "other")))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    rows = placed.select(cell.alias("v"), "k", "new", side.alias("side")).join(reps.select("k", "n", "bag").hint("merge"), "k")
    rows = rows.repartition("v").sortWithinPartitions("v", "n")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[pa.RecordBatch] = []  # the bucket that may go on in the next batch

        def pairs(parts: list[pa.RecordBatch]) -> dict:
            x = pa.Table.from_batches(parts).combine_chunks()
            k = x["k"].to_numpy()
            bags = np.frombuffer(b"".join(x["bag"].to_pylist()), dtype=np.uint8).reshape(-1, BAG)
            i, j = _near(x["v"].to_numpy(), x["side"].to_numpy(), x["new"].to_numpy(), x["n"].to_numpy().astype(np.int64), bags, share)
            a, b = np.minimum(k[i], k[j]), np.maximum(k[i], k[j])
            once = np.unique(np.stack([a[a < b], b[a < b]], 1), axis=0)
            return {"a": once[:, 0], "b": once[:, 1]}

        for b in batches:
            if not b.num_rows:
                continue
            v = b.column("v").to_numpy()
            if (start := int(np.searchsorted(v, v[-1]))) or held and held[0].column("v")[0].as_py() != v[0]:
                yield pairs([*held, b.slice(0, start)])
                held = []
            held.append(b.slice(start))
        if held:
            yield pairs(held)

    pairs = map_batches(rows.select("v", "k", "n", "side", "new", "bag"), work, "a long, b long").distinct()
    return cut(_distances(cut(pairs), docs, key, text, share=share))


def _folded(bag: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps, one per row, folded to ``width`` bits, as words of 64 bits."""
    while bag.shape[1] * 8 > width:
        half = bag.shape[1] // 2
        bag = bag[:, :half] | bag[:, half:]
    return np.ascontiguousarray(bag).view(np.uint64)


def _within(a: dict, b: dict | None, share: float) -> Iterator[dict]:
    """(a, b) of the pairs of one text of ``a`` and one of ``b`` (None: of two texts of ``a``) that pivots allow to repeat each other, in parts.

    A side holds k, n, pivots and the bitmaps whole and coarse of texts in the order of n. Each word that only one of two texts has moves each pivot distance by one at most, and
    one bit at most; texts that repeat each other have at most n_a + n_b - 2 share max(n_a, n_b) such words.
    """
    own, b = b is None, a if b is None else b
    least = [np.ceil(2 * share * x["n"] - 1e-6).astype(np.int32) for x in (a, b)]
    low = 0
    while low < len(a["n"]):
        start = low + 1 if own else int(np.searchsorted(b["n"], np.ceil(share * a["n"][low] - 1e-6)))
        most = lambda high: int(np.searchsorted(b["n"], np.floor(a["n"][high - 1] / share + 1e-6), side="right"))
        high = min(len(a["n"]), low + max(1, min(256, 65536 // max(1, most(low + 1) - start))))
        end = most(high)
        if start >= end:
            low = high
            continue
        na, nb = a["n"][low:high, None].astype(np.int32), b["n"][None, start:end].astype(np.int32)
        limit = np.minimum(na - least[0][low:high, None] + nb, na + (nb - least[1][None, start:end]))
        apart = np.zeros(limit.shape, dtype=np.int32)
        for u, v in zip(a["coarse"], b["coarse"]):
            apart += np.bitwise_count(u[low:high, None] ^ v[None, start:end])
        i, j = np.nonzero(apart <= limit)
        limit = limit[i, j]
        i, j = i + low, j + start
        if own:
            limit, i, j = limit[i < j], i[i < j], j[i < j]
        for at in range(0, len(i), 65536):
            x, y, most_apart = i[at : at + 65536], j[at : at + 65536], limit[at : at + 65536]
            ok = np.minimum(a["n"][x], b["n"][y]) >= share * np.maximum(a["n"][x], b["n"][y]) - 1e-6
            x, y, most_apart = x[ok], y[ok], most_apart[ok]
            ok = np.bitwise_count(a["whole"][x] ^ b["whole"][y]).sum(1, dtype=np.int32) <= most_apart
            x, y, most_apart = x[ok], y[ok], most_apart[ok]
            ok = (np.abs(a["pivots"][x] - b["pivots"][y]) <= most_apart[:, None]).all(1)
            k, m = a["k"][x[ok]], b["k"][y[ok]]
            yield {"a": np.minimum(k, m), "b": np.maximum(k, m)}
        low = high


def _pivot_links(signs: DataFrame, docs: DataFrame, key: str, text: str, share: float) -> DataFrame:
    """The same as ``_links``, of signatures with pivots, without a miss.

    Texts are cut into ranges of the number of words such that those that repeat each other are of one range or of neighbouring ones, and large ranges into blocks. Each two
    blocks of a range or of neighbours are met by one task.
    """
    new = F.max("new") if "new" in signs.columns else F.lit(True)
    reps = signs.groupBy("text_hash", "n").agg(F.min(F.struct("key", "signs", "bag")).alias("x"), new.alias("new"))
    cell = F.floor(F.log("n") / (-math.log(share) * (1 + 1e-9))).cast("int")
    reps = cut(reps.select(F.col("x.key").alias("k"), "n", F.col("x.signs").alias("pivots"), "x.bag", "new", cell.alias("cell")))
    parts = {r.cell: math.ceil(r.words / BLOCK) for r in reps.groupBy("cell").agg(F.sum("n").alias("words")).collect()}  # one row per range
    shape = signs.sparkSession.createDataFrame([(c, m, parts.get(c - 1, 0), parts.get(c + 1, 0)) for c, m in parts.items()], "cell int, parts int, below int, above int")
    tasks = sum(m * (m + 1) // 2 + m * parts.get(c + 1, 0) for c, m in parts.items())
    own = F.pmod(F.xxhash64("k"), F.col("parts")).cast("int")

    def met(others: str, unit: Callable[[Column], Column], side: Callable[[Column], Column]) -> Column:
        number = F.filter(F.sequence(F.lit(0), F.greatest(F.col(others), F.lit(1)) - 1), lambda j: j < F.col(others))
        return F.transform(number, lambda j: F.struct(unit(j).alias("unit"), side(j).alias("side")))

    # sides 0 and 1 are compared with each other, 2 is a block with itself
    same = met("parts", lambda j: F.xxhash64("cell", F.lit(0), F.least(own, j), F.greatest(own, j)), lambda j: F.when(own == j, 2).when(own < j, 0).otherwise(1))
    longer = met("above", lambda j: F.xxhash64("cell", F.lit(1), own, j), lambda j: F.lit(0))
    shorter = met("below", lambda j: F.xxhash64(F.col("cell") - 1, F.lit(1), j, own), lambda j: F.lit(1))
    rows = reps.join(F.broadcast(shape), "cell").select("k", "n", "pivots", "bag", "new", F.explode(F.concat(same, longer, shorter)).alias("x"))
    rows = rows.select("x.unit", "x.side", "k", "n", "pivots", "bag", "new").repartition(max(1, min(tasks, 2000)), "unit").sortWithinPartitions("unit", "n", "k")

    def pairs(x: pa.Table) -> Iterator[dict]:
        n, side, fresh, width = x["n"].to_numpy(), x["side"].to_numpy(), x["new"].to_numpy(), x["bag"].combine_chunks()
        size = pc.binary_length(width).to_numpy()
        least = int(size.min()) * 8
        whole = np.empty((len(n), least // 64), dtype=np.uint64)
        for z in np.unique(size):
            at = np.flatnonzero(size == z)
            whole[at] = _folded(np.frombuffer(b"".join(width.take(pa.array(at)).to_pylist()), dtype=np.uint8).reshape(len(at), z), least)
        pivots = np.array(x["pivots"].combine_chunks().flatten(), dtype=np.int32).reshape(len(n), -1)
        # first a bitmap just large enough to leave few pairs: with fewer bits than words nearly all are set
        coarse = _folded(whole.view(np.uint8), min(least, max(128, 1 << math.ceil(math.log2(n.max() * 4 / 3)))))
        k = x["k"].to_numpy()

        def of(rows: np.ndarray) -> dict:
            return {"k": k[rows], "n": n[rows], "pivots": pivots[rows], "whole": whole[rows], "coarse": [np.ascontiguousarray(c) for c in coarse[rows].T]}

        if side[0] == 2:
            now, old = of(fresh), of(~fresh)
            yield from _within(now, None, share)
            yield from _within(now, old, share)
        else:
            yield from _within(of((side == 0) & fresh), of(side == 1), share)
            yield from _within(of((side == 0) & ~fresh), of((side == 1) & fresh), share)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[pa.RecordBatch] = []  # the unit that may go on in the next batch
        for b in batches:
            while b.num_rows:
                v = b.column("unit").to_numpy()
                if held and held[0].column("unit")[0].as_py() != v[0]:
                    yield from pairs(pa.Table.from_batches(held))
                    held = []
                end = int(np.searchsorted(v, v[0], side="right"))
                held.append(b.slice(0, end))
                b = b.slice(end)
        if held:
            yield from pairs(pa.Table.from_batches(held))

    found = map_batches(rows, work, "a long, b long")
    return cut(_distances(cut(found.distinct()), docs, key, text, share=share))


def _signed(docs: DataFrame, key: str, text: str, batch: str, without: DataFrame | None, pivots: bool) -> DataFrame:
    signs = signatures(docs, key, text, batch, pivots=pivots)
    if without is not None:
        signs = signs.join(sized(cut(without.select(F.col(key).cast("long").alias("key")).distinct())), "key", "left_anti")
    return cut(signs)


def repeats(docs: DataFrame, key: str, text: str, batch: str, without: DataFrame | None = None, share: float = SHARE, hot: int = HOT, pivots: bool = False) -> DataFrame:
    """(a, b, distance): b repeats a, which is of an earlier batch and no repeat itself. without(key): documents that never count. pivots: by the pivot-distance table."""
    signs = _signed(docs, key, text, batch, without, pivots)
    links = _pivot_links(signs, docs, key, text, share) if pivots else _links(signs, docs, key, text, share, hot)
    members = cut(_members(signs))
    many = members.groupBy("rep").agg(F.count("*").alias("m")).where("m > 1").select("rep")
    linked = cut(links.select(F.col("a").alias("rep")).union(links.select("b")).union(many).distinct())
    members = cut(members.join(sized(linked), "rep", "left_semi"))
    # nodes: the copies of one text in one batch; edges: from earlier to later nodes whose texts repeat each other
    nodes = cut(members.select("rep", "batch").distinct())
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance")).unionByName(linked.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(0).alias("distance")))
    edges = nodes.select(F.col("rep").alias("a"), F.col("batch").alias("sa")).join(both, "a")
    edges = cut(edges.join(nodes.select(F.col("rep").alias("b"), F.col("batch").alias("sb")), "b").where("sa < sb").select("a", "sa", "b", "sb", "distance").distinct())
    open_, originals = nodes, None
    while True:
        # original: no open or original node before it; repeat: an original before it
        waiting = edges.join(open_.select(F.col("rep").alias("a"), F.col("batch").alias("sa")), ["a", "sa"], "left_semi")
        new = open_.join(waiting.select(F.col("b").alias("rep"), F.col("sb").alias("batch")).distinct(), ["rep", "batch"], "left_anti")
        new = cut(new)
        originals = new if originals is None else originals.unionByName(new)
        struck = edges.join(new.select(F.col("rep").alias("a"), F.col("batch").alias("sa")), ["a", "sa"], "left_semi").select(F.col("b").alias("rep"), F.col("sb").alias("batch"))
        open_ = cut(open_.join(new.unionByName(struck).distinct(), ["rep", "batch"], "left_anti"))
        if not open_.limit(1).count():
            break
    from_ = edges.join(originals.select(F.col("rep").alias("a"), F.col("batch").alias("sa")), ["a", "sa"], "left_semi")
    a = members.select(F.col("key").alias("doc_a"), F.col("rep").alias("a"), F.col("batch").alias("sa"))
    b = members.select(F.col("key").alias("doc_b"), F.col("rep").alias("b"), F.col("batch").alias("sb"))
    return from_.join(a, ["a", "sa"]).join(b, ["b", "sb"]).select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"), "distance")


def repeats_of_history(
    new: DataFrame, history: str | None, docs: DataFrame, key: str, text: str, batch: str, without: DataFrame | None = None, share: float = SHARE, hot: int = HOT, pivots: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(a, b, distance): b of the one batch ``new`` repeats a, an original of an earlier batch; and the signatures of the new batch's originals, to be appended.

    history: folder of the originals' signatures, filled by ``append`` batch after batch (None: there is none yet). docs: where the texts of old
    candidates are found; no old text is signed again. Rows of other batches' keys in ``new`` count as new ones. pivots: by the pivot-distance table.
    """
    signs = _signed(new, key, text, batch, without, pivots)
    columns = ["key", "batch", "text_hash", "n", "signs", "bag"]
    signs = cut(signs.groupBy("key").agg(F.min(F.struct(*columns[1:])).alias("x")).select("key", "x.*"))
    if history is None:
        return signs.sparkSession.createDataFrame([], "a long, b long, distance int"), signs
    old = signs.sparkSession.read.parquet(history).select(*[F.col(c).cast(signs.schema[c].dataType).alias(c) for c in columns])
    old = old.join(sized(cut(signs.select("key"))), "key", "left_anti")  # a batch that is checked again meets no row of its own
    both = old.withColumn("new", F.lit(False)).unionByName(signs.withColumn("new", F.lit(True)))
    links = _pivot_links(both, docs, key, text, share) if pivots else _links(both, docs, key, text, share, hot)
    # a link holds for all originals and all new documents of its two texts
    rep = both.groupBy("text_hash", "n").agg(F.min("key").alias("rep"), F.max("new").alias("asked"))
    rep = cut(rep.join(sized(cut(links.select(F.col("a").alias("rep")).union(links.select("b")).distinct())).withColumn("linked", F.lit(True)), "rep", "left").where("asked OR linked"))
    members = cut(both.select("key", "text_hash", "n", "new").join(rep.select("text_hash", "n", "rep").hint("merge"), ["text_hash", "n"]).select("key", "rep", "new"))
    each = links.union(links.select("b", "a", "distance")).union(rep.select("rep", F.col("rep").alias("same"), F.lit(0))).toDF("a", "b", "distance")
    held = members.where("NOT new").select(F.col("rep").alias("a"), F.col("key").alias("doc_a"))
    asked = members.where("new").select(F.col("rep").alias("b"), F.col("key").alias("doc_b"))
    pairs = cut(each.join(held, "a").join(asked, "b").select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"), "distance").distinct())
    return pairs, signs.join(sized(cut(pairs.select(F.col("b").alias("key")).distinct())), "key", "left_anti")


def _axes(n: int) -> int:
    """Pivots that range the join of n texts: as the table grows, more of them keep ranges small."""
    return min(PIVOTS, max(2, (n // 1000).bit_length()))


def pivot_rows(docs: DataFrame, key: str, text: str, batch: str) -> DataFrame:
    """(key, batch, text_hash, n, signs): the rows of the pivot-distance table. signs: the distances."""
    rows = signatures(docs, key, text, batch, pivots=True)
    return rows.groupBy("key").agg(F.min(F.struct("batch", "text_hash", "n", "signs")).alias("x")).select("key", "x.*")


def pivot_pairs(docs: DataFrame, key: str, text: str, batch: str, radius: int = 2, history: str | None = None, new: DataFrame | None = None) -> DataFrame:
    """(a, b, distance), a < b: texts within ``radius`` words of each other, by pivot distances.

    Equal texts are reported once, against the smallest key that holds them; other pairs are those of such keys. By the triangle inequality,
    pivot distances of texts within the radius differ by at most twice the radius. The table is cut into ranges of the
    number of words and of some pivots' distances; texts meet those of their own ranges only, and the other pivots prune further. Ranges of more
    than HOT texts are split among tasks.

    history, new: only pairs with a text of ``new`` come out; the other texts' rows are read from the folder that ``append(pivot_rows(...))`` filled.
    """
    rows = cut(pivot_rows(docs if new is None else new, key, text, batch)).withColumn("new", F.lit(True))
    if history is not None:
        old = rows.sparkSession.read.parquet(history).select(*[F.col(c).cast(rows.schema[c].dataType).alias(c) for c in ("key", "batch", "text_hash", "n", "signs")])
        rows = old.join(sized(cut(rows.select("key"))), "key", "left_anti").withColumn("new", F.lit(False)).unionByName(rows)
    classes = rows.groupBy("text_hash", "n").agg(F.min(F.struct("key", "signs")).alias("x"), F.max("new").alias("new"))
    reps = cut(classes.select("x.key", F.col("x.signs").alias("pivots"), "n", "text_hash", "new"))
    grid = _axes(reps.count())
    reach, width, width_n = 2 * radius, 12 * radius, 5 * radius
    axes = [(F.col("n"), radius, width_n)] + [(F.col("pivots")[k].cast("int"), reach, width) for k in range(grid)]
    own = F.xxhash64(*[F.floor(c / w).cast("int") for c, _, w in axes])
    held = cut(reps.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("pivots").alias("pa"), F.col("new").alias("new_a"), own.alias("cell")))
    # a text asks in every range that holds a text within its reach: one or two per axis
    asked = reps
    for i, (c, r, w) in enumerate(axes):
        low, high = F.floor((c - r) / w).cast("int"), F.floor((c + r) / w).cast("int")
        asked = asked.withColumn(f"c{i}", F.explode(F.array_distinct(F.array(low, high))))
    asked = asked.select("key", "n", "pivots", "new", F.xxhash64(*[f"c{i}" for i in range(len(axes))]).alias("cell"))
    full = cut(held.groupBy("cell").agg(F.ceil(F.count("*") / HOT).cast("int").alias("parts")).where("parts > 1"))
    parts = F.coalesce("parts", F.lit(1))
    held = held.join(sized(full), "cell", "left").withColumn("part", F.pmod(F.xxhash64("a"), parts).cast("int")).drop("parts")
    asked = asked.join(sized(full), "cell", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    bound = F.abs(F.col("na") - F.col("n")) <= radius
    for k in range(PIVOTS):
        bound = bound & (F.abs(F.col("pa")[k] - F.col("pivots")[k]) <= reach)
    met = held.hint("merge").join(asked.hint("merge"), ["cell", "part"]).where((F.col("a") < F.col("key")) & (F.col("new_a") | F.col("new")) & bound)
    found = _distances(cut(met.select("a", F.col("key").alias("b")).distinct()), docs, key, text, radius=radius)
    equal = rows.select("key", "text_hash", "n", "new").join(reps.select("text_hash", "n", F.col("key").alias("rep")).hint("merge"), ["text_hash", "n"]).where("key <> rep")
    if history is not None:
        kept = rows.select(F.col("key").alias("rep"), F.col("new").alias("rep_new"))
        equal = equal.join(kept.hint("merge"), "rep").where("new OR rep_new")
    return found.unionByName(equal.select(F.col("rep").alias("a"), F.col("key").alias("b"), F.lit(0).alias("distance")))
