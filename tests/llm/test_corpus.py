import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textharbor.llm import encoding, history, leakage, mixing


def words(rng, n):
    return [f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.choice('bcdf')}" for _ in range(n)]


def brute_repeats(rows, without=()):
    docs = {i: ((b or "").lower().split(), s) for i, b, s in rows if i not in without and i is not None}
    docs = {i: v for i, v in docs.items() if len(v[0]) >= 40}

    def near(a, b):
        n = max(len(a), len(b))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for x, u in enumerate(a):
            for y, v in enumerate(b):
                table[x + 1, y + 1] = table[x, y] + 1 if u == v else max(table[x, y + 1], table[x + 1, y])
        return table[-1, -1] >= 0.8 * n

    repeat, out = {}, set()
    for b in sorted(docs, key=lambda i: (docs[i][1], i)):
        before = {a for a in docs if docs[a][1] < docs[b][1] and not repeat[a] and near(docs[a][0], docs[b][0])}
        repeat[b] = bool(before)
        out |= {(a, b) for a in before}
    return out


@pytest.mark.parametrize("hot", [100, 1])
def test_repeats_equal_brute_force(spark, hot):
    rng = random.Random(6)
    rows, i = [], 0
    for _ in range(7):
        base = words(rng, rng.randrange(45, 70))
        for seg in range(4):
            if rng.random() < 0.7:
                for _ in range(rng.randrange(1, 3)):
                    w = list(base)
                    for _ in range(rng.choice([0, 0, 2, 5, 20])):
                        w[rng.randrange(len(w))] = words(rng, 1)[0]
                    rows.append((i, " ".join(w).upper() if rng.random() < 0.2 else "\n".join([" ".join(w[:20]), " ".join(w[20:])]), seg))
                    i += 1
    rows += [(900, None, 1), (901, "", 1), (902, "short text", 2), (None, "x " * 50, 1), rows[0]]
    rows = sorted(rows, key=lambda r: (r[2], r[0] or 0))
    rows = [(k if r[0] is not None else None, r[1], r[2]) for k, r in enumerate(rows)]
    df = spark.createDataFrame([(*r, 5, "q") for r in rows + rows[3:5]], "doc_id long, body string, seg int, n int, rep string")
    got = {(r.a, r.b) for r in history.repeats(df, "doc_id", "body", "seg", hot=hot).collect()}
    assert got == brute_repeats(rows) and got
    left = df.where("doc_id = 0").select("doc_id")
    assert {(r.a, r.b) for r in history.repeats(df, "doc_id", "body", "seg", without=left, hot=hot).collect()} == brute_repeats(rows, {0})
    assert history.repeats(df.limit(0), "doc_id", "body", "seg").count() == 0


def test_copied_lines_keep_their_minima(spark):
    rng = random.Random(21)
    lines = [[w[: rng.choice([3, 3, 5, 5, 5])] for w in words(rng, 40)] for _ in range(6)]
    rows = [(i, "\n".join(map(" ".join, lines)), 0) for i in range(12)]
    for i in range(12):
        changed = [list(x) for x in lines]
        changed[i % 6][rng.randrange(40)] = "changed"
        rows.append((100 + i, "\n".join(map(" ".join, changed)), 1))
    df = spark.createDataFrame(rows, "doc_id long, body string, seg int")
    got = {(r.a, r.b) for r in history.repeats(df, "doc_id", "body", "seg").collect()}
    assert got == {(a, 100 + b) for a in range(12) for b in range(12)}


def scattered(rng, pairs, sizes, keep=0.8):
    """Rows of texts and of copies with scattered changes, and the pairs that keep five consecutive words in common."""
    rows, kept = [], set()
    for i in range(pairs):
        a = words(rng, rng.choice(sizes))
        b = list(a)
        for at in rng.sample(range(len(a)), int(len(a) * (1 - keep) + 1e-9)):
            b[at] = "changed"
        rows += [(2 * i, " ".join(a), 0), (2 * i + 1, " ".join(b), 1)]
        if any("changed" not in b[at : at + 5] for at in range(len(b) - 4)):
            kept.add((2 * i, 2 * i + 1))
    return rows, kept


def test_pairs_that_share_crowded_minima_only(spark):
    rows, kept = scattered(random.Random(22), 40, [64])
    df = spark.createDataFrame(rows, "doc_id long, body string, seg int")
    got = {(r.a, r.b) for r in history.repeats(df, "doc_id", "body", "seg", hot=1).collect()}
    assert len(got) >= 0.9 * len(kept) and got <= kept


def test_blocks_of_a_bucket_lose_no_pair(spark):
    rng = random.Random(23)
    base = words(rng, 60)
    rows = []
    for i in range(60):
        w = list(base)
        for at in rng.sample(range(50), rng.choice([2, 6, 12])):
            w[at] = words(rng, 1)[0]
        rows.append((i, " ".join(w), i // 20))
    df = spark.createDataFrame(rows, "doc_id long, body string, seg int")
    got = {(r.a, r.b) for r in history.repeats(df, "doc_id", "body", "seg", hot=7).collect()}
    assert got == brute_repeats(rows) and got


def test_repeats_of_two_originals_keep_both(spark):
    rng = random.Random(24)
    rows = []
    for i in range(0, 24, 3):
        base = words(rng, 100)  # all that the second original shares with the repeat, the first one shares too
        rows += [(i, " ".join(base[17:]), 0), (i + 1, " ".join(words(rng, 15) + base[15:] + words(rng, 6)), 0), (i + 2, " ".join(base), 1)]
    df = spark.createDataFrame(rows, "doc_id long, body string, seg int")
    got = {(r.a, r.b) for r in history.repeats(df, "doc_id", "body", "seg", hot=1).collect()}
    assert got == {(i + k, i + 2) for i in range(0, 24, 3) for k in range(2)}


def test_short_texts_keep_all_shingles(spark):
    rows, kept = scattered(random.Random(25), 40, [40, 50, 60])
    df = spark.createDataFrame(rows, "doc_id long, body string, seg int")
    got = {(r.a, r.b) for r in history.repeats(df, "doc_id", "body", "seg").collect()}
    assert got == kept and len(kept) > 20


def test_pivot_pairs_equal_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for g in range(12):
        base = words(rng, 45 + g)
        for _ in range(4):
            w = list(base)
            for _ in range(rng.randrange(5)):
                w[rng.randrange(len(w))] = words(rng, 1)[0]
            rows.append((len(rows), " ".join(w), 0))
    df = spark.createDataFrame(rows, "doc_id long, body string, seg int")
    got = {(r.a, r.b): r.distance for r in history.pivot_pairs(df, "doc_id", "body", "seg", radius=2).collect()}
    text = {i: b.split() for i, b, _ in rows}
    first = {}
    for i, b, _ in rows:
        first.setdefault(b, i)
    exp = {}
    for i in text:
        for j in text:
            d = max(len(text[i]), len(text[j])) - history.lcs(text[i], text[j])
            if i < j and d <= 2 and first[rows[i][1]] == i and (d == 0 or first[rows[j][1]] == j):
                exp[i, j] = d
    assert got == exp and any(exp.values())


def batches_of(rng):
    rows = []
    for g in range(10):
        base = words(rng, rng.randrange(45, 90))
        for seg in range(4):
            for _ in range(rng.randrange(3)):
                w = list(base)
                for _ in range(rng.choice([0, 0, 1, 3, 8])):
                    w[rng.randrange(len(w))] = words(rng, 1)[0]
                rows.append((len(rows), " ".join(w), seg))
    return sorted(((i, b, s) for i, b, s in rows), key=lambda r: r[2])


@pytest.mark.parametrize("hot", [100, 3])
def test_batches_against_stored_history_equal_one_run(spark, tmp_path, hot):
    rows = [(i, b, s) for i, (_, b, s) in enumerate(batches_of(random.Random(31)))] + [(900, None, 2), (901, "short", 3)]
    df = spark.createDataFrame(rows + rows[-4:], "doc_id long, body string, seg int").cache()
    whole = {(r.a, r.b) for r in history.repeats(df, "doc_id", "body", "seg", hot=hot).collect()}
    assert whole == brute_repeats(rows) and whole
    path, got = str(tmp_path / "h"), set()
    for seg in range(4):
        for again in range(2):  # a batch that is checked and written twice changes nothing
            found, fresh = history.repeats_of_history(df.where(f"seg = {seg}"), path if seg or again else None, df, "doc_id", "body", "seg", hot=hot)
            pairs = {(r.a, r.b) for r in found.collect()}
            assert not again or pairs == last
            last = pairs
            history.append(fresh, path)
        got |= pairs
    assert got == whole
    found, fresh = history.repeats_of_history(df.limit(0), path, df, "doc_id", "body", "seg")
    assert found.count() == 0 and fresh.count() == 0


def test_pivot_table_by_batches_equals_one_run(spark, tmp_path):
    rows = [(i, b, s) for i, (_, b, s) in enumerate(batches_of(random.Random(32)))]
    df = spark.createDataFrame(rows, "doc_id long, body string, seg int").cache()
    whole = {(r.a, r.b, r.distance) for r in history.pivot_pairs(df, "doc_id", "body", "seg").collect()}
    path, got = str(tmp_path / "p"), set()
    for seg in range(4):
        batch = df.where(f"seg = {seg}")
        found = history.pivot_pairs(df, "doc_id", "body", "seg", history=path if seg else None, new=batch)
        got |= {(r.a, r.b, r.distance) for r in found.collect()}
        history.append(history.pivot_rows(batch, "doc_id", "body", "seg"), path)
    assert got == whole and any(d for *_, d in whole) and any(not d for *_, d in whole)


def test_crowded_ranges_are_split(spark, monkeypatch):
    monkeypatch.setattr(history, "HOT", 5)
    rng = random.Random(33)
    base = words(rng, 60)
    rows = []
    for i in range(40):
        w = list(base)
        w[i] = "changed" if i % 2 else w[i]
        rows.append((i, " ".join(w), 0))
    df = spark.createDataFrame(rows, "doc_id long, body string, seg int")
    got = {(r.a, r.b, r.distance) for r in history.pivot_pairs(df, "doc_id", "body", "seg").collect()}
    odd = range(1, 40, 2)
    assert got == {(0, i, 0) for i in range(2, 40, 2)} | {(0, i, 1) for i in odd} | {(i, j, 2) for i in odd for j in odd if i < j}


def test_a_repeat_of_a_repeat_in_a_crowd(spark):
    rng = random.Random(34)
    z = words(rng, 200)
    a = words(rng, 30) + z[30:]
    b1, b2 = list(a), list(a)
    b1[80:96], b2[140:156] = words(rng, 16), words(rng, 16)
    rows = [(1, z, 1), (2, a, 2), (3, b1, 3), (4, b2, 4)]
    for i in range(150):
        w, at = list(a), rng.randrange(195)
        w[at : at + 5] = words(rng, 5)
        rows.append((10 + i, w, 5))
    df = spark.createDataFrame([(i, " ".join(w), s) for i, w, s in rows], "doc_id long, body string, seg int")
    got = {(r.a, r.b) for r in history.repeats(df, "doc_id", "body", "seg", hot=20).where("b < 10").collect()}
    assert got == {(1, 2), (3, 4)}


def test_no_frame_over_the_limit_is_broadcast(spark):
    from textharbor.llm.common import cut, sized

    rows = cut(spark.range(3000).select("id", F.repeat(F.lit("x"), 100).alias("t")))
    left = spark.range(10)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(left.join(sized(rows), "id"))
    for small in ({"most": 2999}, {"most_bytes": 300_000}):
        assert "BroadcastHashJoin" not in plan(left.join(sized(rows, **small), "id")) and "SortMergeJoin" in plan(left.join(sized(rows, **small), "id"))


def changed_texts(rng):
    """Rows of originals and of later texts with up to a fifth of the longer one's words changed, or one more: scattered, cut off, swapped, in one place, or of few different words."""
    rows = []
    for size in (40, 45, 50, 100, 130):
        base = words(rng, size)
        fifth = size // 5
        texts = []
        for lost in (fifth, fifth + 1):
            every = list(base)
            for at in range(lost):  # no five consecutive words in common
                every[(5 * at + 2) % size if at < fifth else 0] = f"new{at}"
            block = list(base)
            block[3 : 3 + lost] = [f"other{i}" for i in range(lost)]
            texts += [every, block, base + words(rng, lost + size // 20), base[lost:], base[lost:] + base[:lost]]
        rows += [(base, 0), *((w, 1 + i % 2) for i, w in enumerate(texts)), (list(map(str.upper, texts[0])), 2)]
    same = ["word"] * 60
    rows += [(same, 0), (same[:48], 1), (same[:47], 1), (["word", "more"] * 30, 1), (same + ["end"] * 15, 2), (same + ["end"] * 16, 2)]
    rows = [(i, " ".join(w), s) for i, (w, s) in enumerate(sorted(rows, key=lambda r: r[1]))]
    return rows + [(900, None, 1), (901, "", 1), (902, "short text", 2)]


def test_p7_method_takes_the_whole_rule(spark, tmp_path, monkeypatch):
    from textharbor.llm import catalogue

    rows = changed_texts(random.Random(41))
    df = spark.createDataFrame(rows + rows[:4], "doc_id long, body string, seg int")
    df.write.parquet(str(tmp_path / "docs.parquet"))
    left = rows[3][0]
    for without in ((), (left,)):
        listed = spark.createDataFrame([(i,) for i in without], "doc_id long")
        monkeypatch.setattr(catalogue, "_spam", lambda *_, listed=listed: listed)
        exp = brute_repeats(rows, without)
        text = {i: b.split() for i, b, _ in [(i, (b or "").lower(), s) for i, b, s in rows]}
        far = {(a, b): max(len(text[a]), len(text[b])) - history.lcs(text[a], text[b]) for a, b in exp}
        got = [tuple(r) for r in catalogue.p7_method(spark, str(tmp_path)).select("doc_id_a", "doc_id_b", "distance").collect()]
        assert sorted(got) == sorted((a, b, d) for (a, b), d in far.items())
        assert max(far.values()) > 20 and sum(d > 2 for d in far.values()) > 15
        newest = {(r.doc_id_a, r.doc_id_b, r.distance) for r in catalogue.p7_pivots(spark, str(tmp_path)).collect()}
        seg = {i: s for i, _, s in rows}
        assert newest == {(a, b, d) for (a, b), d in far.items() if seg[b] == 2} and newest


@pytest.mark.parametrize("block", [1 << 22, 1500])
def test_repeats_by_pivots_equal_brute_force(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(history, "BLOCK", block)
    rng = random.Random(42)
    rows = [(i, b, s) for i, (_, b, s) in enumerate(batches_of(rng))]
    base = words(rng, 60)
    for i in range(30):  # one crowd of changed texts
        w = list(base)
        for at in rng.sample(range(60), rng.choice([2, 6, 12, 13])):
            w[at] = words(rng, 1)[0]
        rows.append((500 + i, " ".join(w), i // 8))
    df = spark.createDataFrame(rows + rows[-4:] + [(900, None, 2), (None, rows[0][1], 1)], "doc_id long, body string, seg int").cache()
    whole = {(r.a, r.b, r.distance) for r in history.repeats(df, "doc_id", "body", "seg", pivots=True).collect()}
    assert {(a, b) for a, b, _ in whole} == brute_repeats(rows) and max(d for *_, d in whole) > 10
    path, got = str(tmp_path / "p"), set()
    for seg in range(4):
        for again in range(2):
            found, fresh = history.repeats_of_history(df.where(f"seg = {seg}"), path if seg or again else None, df, "doc_id", "body", "seg", pivots=True)
            pairs = {(r.a, r.b, r.distance) for r in found.collect()}
            assert not again or pairs == last
            last = pairs
            history.append(fresh, path)
        got |= pairs
    assert got == whole
    assert history.repeats(df.limit(0), "doc_id", "body", "seg", pivots=True).count() == 0


def test_bits_differ_no_more_than_word_bags():
    from collections import Counter

    rng = random.Random(43)
    texts = [[f"w{int(rng.paretovariate(0.4)) % 5000}" for _ in range(rng.choice([40, 60, 200, 700]))] for _ in range(40)]
    count = np.array([len(t) for t in texts])
    h = history.hash_words([w for t in texts for w in t], history.Hashes())
    bits = [np.frombuffer(b, dtype=np.uint8)[None] for b in history._bits(h, np.repeat(np.arange(40), count), count)]
    for i in range(40):
        for j in range(i):
            width = 8 * min(bits[i].shape[1], bits[j].shape[1])
            a, b = Counter(texts[i]), Counter(texts[j])
            for w in (width, 256):
                assert np.bitwise_count(history._folded(bits[i], w) ^ history._folded(bits[j], w)).sum() <= ((a - b) + (b - a)).total()


def test_lcs():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for x in range(len(a)):
            for y in range(len(b)):
                best[x + 1][y + 1] = best[x][y] + 1 if a[x] == b[y] else max(best[x][y + 1], best[x + 1][y])
        assert history.lcs(a, b) == best[-1][-1]


def test_leaked_items_equal_brute_force(spark):
    rng = random.Random(9)
    items = [(i, " ".join(words(rng, rng.choice([8, 12, 13, 40])))) for i in range(20)] + [(50, None), (51, "")]
    docs = []
    for d in range(60):
        w = words(rng, rng.choice([5, 30, 400]))
        if d % 2 and len(w) > 5:
            p = items[rng.randrange(20)][1].split()
            n = rng.choice([11, 12, len(p)])
            at = rng.randrange(len(w))
            w[at:at] = [x.upper() + rng.choice([",", "", " --"]) for x in p[:n]]
        docs.append((d, " ".join(w)))
    docs += [(900, None), (901, ""), docs[1]]
    runs = {}
    for i, p in items:
        w = (p or "").split()
        for j in range(len(w) - 11):
            runs.setdefault(tuple(w[j : j + 12]), set()).add(i)
    import re

    exp = set()
    for d, t in docs:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        for j in range(len(w) - 11):
            exp |= {(d, i) for i in runs.get(tuple(w[j : j + 12]), ())}
    df = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, i int")
    it = spark.createDataFrame(items, "item_id long, prompt string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaked_items(df, "doc_id", "text", it, "item_id", "prompt").collect()}
    assert got == exp and exp
    assert leakage.leaked_items(df.limit(0), "doc_id", "text", it, "item_id", "prompt").count() == 0
    assert leakage.leaked_items(df, "doc_id", "text", it.limit(0), "item_id", "prompt").count() == 0


def test_many_passages_are_searched_in_groups(spark, monkeypatch):
    rng = random.Random(12)
    items = [(i, " ".join(words(rng, 20))) for i in range(30)]
    docs = [(i, "x " + items[i % 30][1] + " y") for i in range(60)]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, prompt string")
    monkeypatch.setattr(leakage, "MOST_PASSAGES", 50)
    got = {(r.doc_id, r.item_id) for r in leakage.leaked_items(df, "doc_id", "text", it, "item_id", "prompt").collect()}
    assert got == {(i, i % 30) for i in range(60)}


def test_hash_functions_suffice():
    for size, n in leakage.size_classes():
        assert size <= 8 or (1 - 8 / size) ** n <= leakage.MISS


@pytest.mark.parametrize("caps", [[np.inf] * 3, [1, np.inf, 2], [1, 1, 1], [0, np.inf, np.inf]])
def test_water_filling(caps):
    w, s, caps = np.array([0.5, 0.3, 0.2]), np.array([100.0, 1000.0, 50.0]), np.array(caps, dtype=float)
    got = mixing.water_fill(w, s, caps, 900)
    assert (got <= np.where(np.isfinite(caps), caps * s, np.inf) + 1e-9).all() and got.sum() <= 900 + 1e-6
    free = got < np.where(np.isfinite(caps), caps * s, np.inf) - 1e-9
    if free.any():
        assert got.sum() == pytest.approx(900) and np.ptp((got / w)[free]) < 1e-6
        assert (got[~free] / w[~free] <= (got / w)[free].min() + 1e-6).all()


def test_mixture(spark):
    rows = [(i, "word " * (5 + i % 7), ["a", "b", "c", "unlisted", None][i % 5]) for i in range(500)] + [(900, None, "a"), (901, "", "b")]
    targets = spark.createDataFrame([("a", 6.0, 3), ("b", 2.0, None), ("c", None, 2), ("zero", 0.0, 1), ("absent", 1.0, 1)], "source string, weight double, max_repeat int")
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, tokens int, epochs int")
    mixed, report = mixing.mixture(df, "doc_id", "text", "source", targets)
    got = {r.source: r for r in report.collect()}
    assert set(got) == {"a", "b"} and got["a"].actual_share == pytest.approx(0.75, abs=0.01)
    for r in got.values():
        assert abs(r.tokens - r.allotted) <= 12
    assert mixed.groupBy("doc_id").count().where("count > 1").count() == 0 and mixed.where("repeats > 3 AND source = 'a'").count() == 0
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mixture(df, "doc_id", "text", "source", targets)[0].collect()))
    assert mixing.mixture(df.limit(0), "doc_id", "text", "source", targets)[0].count() == 0


def test_garbled_text(spark):
    rng = random.Random(2)
    vocab = "für größer Straße schön Mädchen Übung après déjà élève garçon œuvre niño señal corazón ação pão лес город река книга школа зима plain text with many words".split()
    clean = [" ".join(rng.choice(vocab) for _ in range(30)) for _ in range(300)]
    bad = [(1000, "Das ist schön für Mädchen".encode().decode("cp1252")), (1001, clean[0].split(" ", 1)[0] + " déjà élève".encode().decode("mac_roman")), (1002, "la señal ".encode().decode("latin-1").encode().decode("latin-1") + "niño"), (1003, "город река книга школа зима лес".encode("cp1251").decode("cp1252")), (1004, "gr��er text")]
    sound = [(2000, "A page that was read wrongly shows Ã© where é was meant"), (2001, "½ cup at 180 °C"), (2002, "ΔΣ over Ω ≥ π"), (2003, None), (2004, ""), (2005, "ascii only"), (2006, "ÂNGULO, ÂMBAR")]
    df = spark.createDataFrame([(*r, "x") for r in [*enumerate(clean), *bad, *sound]], "doc_id long, text string, runs string")
    tables = encoding.train(df, "text")
    found = encoding.survey(df, "doc_id", "text", tables)
    margins = encoding.validated_margins(found)
    got = {r.doc_id: r for r in encoding.garbled(df, "doc_id", "text", tables, **margins, repair=True).collect()}
    assert sorted(encoding.garbled(df, "doc_id", "text", tables, **margins, repair=True, found=found).collect()) == sorted(got.values())
    assert found.where("kind = 'key'").count() < 30
    assert set(got) == {i for i, _ in bad}
    assert got[1000].repaired == "Das ist schön für Mädchen" and got[1001].repaired.endswith("déjà élève") and got[1002].repaired == "la señal niño" and got[1003].repaired == "город река книга школа зима лес"
    assert got[1004].lost == 1 and got[1004].runs == 0
    assert encoding.garbled(df.limit(0), "doc_id", "text", tables).count() == 0


def test_margin_counts_all_records_and_parts_garbled_ones(spark):
    rng = random.Random(26)
    vocab = "город река книга школа зима лес вода поле дорога письмо".split()
    line = lambda: " ".join(rng.choice(vocab) for _ in range(12))
    rows = [(i, line()) for i in range(600)] + [(1000 + i, line().encode(("koi8-r", "cp1251", "cp1251")[i % 3]).decode(("cp1251", "koi8-r", "cp1252")[i % 3])) for i in range(90)] + [(2000 + i, "only ascii") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tables = encoding.train(df, "text")
    found = encoding.survey(df, "doc_id", "text", tables)
    margins = encoding.validated_margins(found)
    assert margins["line_margin"] < 30 and found.where("kind = 'line'").groupBy().sum("n").first()[0] == 690
    for f in (found, None):
        assert {r.doc_id for r in encoding.garbled(df, "doc_id", "text", tables, **margins, found=f).collect()} == set(range(1000, 1090))
    assert encoding.validated_margins(encoding.survey(df.limit(0), "doc_id", "text", tables)) == {"margin": 4.0, "line_margin": 12.0}


def test_part_of_a_line_is_garbled(spark):
    rng = random.Random(27)
    vocab = "город река книга школа зима лес вода поле дорога письмо".split()
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(12))) for i in range(600)]
    bad = "письмо дорога".encode("koi8-r").decode("cp1251")
    rows += [(1000, f"город река {bad} школа лес"), (1001, f"plain words, then {bad}.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tables = encoding.train(df, "text")
    got = {r.doc_id: r.repaired for r in encoding.garbled(df, "doc_id", "text", tables, **encoding.validated_margins(encoding.survey(df, "doc_id", "text", tables)), repair=True).collect()}
    assert got == {1000: "город река письмо дорога школа лес", 1001: "plain words, then письмо дорога."}


def test_margins_lie_in_the_valley():
    gain = np.arange(-20, 60)
    n = np.where(gain < 1, 50, np.where(gain < 6, 0, 30))
    assert encoding.run_margin(gain, n) == 4 and encoding.run_margin(gain[:0], n[:0]) == 4 and encoding.run_margin(gain, np.where(gain < 5, 9, 0)) >= 7


def test_candidate_chains_round_trip():
    for wrong, right in encoding.CHAINS:
        for text in ("Größe déjà niño", "город река"):
            try:
                seen = text.encode(right).decode(wrong)
            except (UnicodeDecodeError, UnicodeEncodeError):
                continue
            assert any(t == text for _, t in encoding.candidates(seen)) or seen == text
