"""Language of documents and of their lines, with a confidence (problem 3): segmentation-marginalised unigrams.

Each language has probabilities of the pieces of a fixed public vocabulary. A word's probability is the sum over all its
segmentations into pieces, computed by a forward algorithm; a text's is the product over its words. Probabilities are
trained by expectation-maximisation (forward-backward counts) on known-language samples.

As words are independent, every worker scores each distinct word once, for all languages together, and sums rows of
that table per line. A line's language is the likeliest; a body's language is the one with most words in its lines. The
confidence is the posterior probability under equal priors.

Defined results: null, empty and wordless bodies have no language (null, confidence 0); ties go to the alphabetically
first language; lines under ``min_words`` words never count as foreign; repeated rows of one key count once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textharbor.llm.common import map_batches

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MIN_WORDS = 6
#: A line is foreign only if its language is so many nats likelier than the body's.
MARGIN = 6.0
#: Labelled documents that refine the model, and the nats by which a line of theirs is surely another language's.
SAMPLE = 3000
SURE = 40.0
#: Codes and names of languages in labels.
CODES = {
    "en": "en", "eng": "en", "english": "en", "de": "de", "deu": "de", "ger": "de", "german": "de", "deutsch": "de",
    "fr": "fr", "fra": "fr", "fre": "fr", "french": "fr", "es": "es", "spa": "es", "spanish": "es", "pt": "pt", "por": "pt", "portuguese": "pt",
    "it": "it", "ita": "it", "italian": "it", "nl": "nl", "nld": "nl", "dut": "nl", "dutch": "nl", "ru": "ru", "rus": "ru", "russian": "ru",
}
LETTERS = re.compile(r"[^\W\d_]+")
ANY = re.compile(r"[^\W_]+")


def label_code(label: str | None) -> str | None:
    """Two-letter code that a label names, whatever its region, case or form; null where it names none."""
    parts = re.split(r"[-_\s.@]", (label or "").strip().lower())
    return CODES.get(parts[0], parts[0] if re.fullmatch(r"[a-z]{2}", parts[0]) and parts[0] not in ("xx", "zz") else None)


def vocabulary(path: str = VOCABULARY) -> set[str]:
    """Pieces of a public tokenizer, lower case, word starts marked by U+2581; control and byte pieces left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
    return {p for p in pieces if (p == "▁" or all(c.isalpha() for c in p.lstrip("▁")))}


class Unigrams:
    """Piece probabilities of several languages; pieces that no sample uses share the floor."""

    def __init__(self, languages: list[str], pieces: set[str], table: dict[str, np.ndarray], floor: np.ndarray) -> None:
        self.languages, self.pieces, self.table, self.floor = languages, pieces, table, floor
        self.longest = max(map(len, pieces), default=1)

    def word(self, word: str) -> np.ndarray:
        """Natural log of the word's probability in each language, summed over all segmentations."""
        s = "▁" + word
        alpha = [np.ones(len(self.languages))]
        shift = 0.0
        for j in range(1, len(s) + 1):
            total = np.zeros(len(self.languages))
            for i in range(max(0, j - self.longest), j):
                piece = s[i:j]
                if (p := self.table.get(piece)) is not None:
                    total += alpha[i] * p
                elif j - i == 1:
                    total += alpha[i] * self.floor * 0.01
                elif piece in self.pieces:
                    total += alpha[i] * self.floor
            alpha.append(total)
            if (top := total.max()) < 1e-200:  # long words: rescale what later positions still read
                for i in range(max(0, j - self.longest), j + 1):
                    alpha[i] = alpha[i] / top
                shift += math.log(top)
        return np.log(np.maximum(alpha[-1], 1e-300)) + shift


def train(samples: list[tuple[str, str]], pieces: set[str], rounds: int = 4, smoothing: float = 0.1) -> Unigrams:
    """Expectation-maximisation on (language, sample) rows. The samples' number bounds the cost: it runs on the driver."""
    languages = sorted({lang for lang, _ in samples})
    words: dict[str, Counter] = {lang: Counter() for lang in languages}
    for lang, text in samples:
        words[lang].update(LETTERS.findall(text.lower()))
    chars = {c for w in words.values() for x in w for c in x} | {"▁"}
    table: dict[str, np.ndarray] = {}
    floor, longest = np.zeros(len(languages)), max(map(len, pieces), default=1)
    for at, lang in enumerate(languages):
        found: list[tuple[list[tuple[int, int, str]], int, int]] = []
        for w, n in words[lang].items():
            s = "▁" + w
            spans = [(i, j, s[i:j]) for j in range(1, len(s) + 1) for i in range(max(0, j - longest), j) if j - i == 1 or s[i:j] in pieces]
            found.append((spans, len(s), n))
        prob = Counter({p: 1.0 for spans, _, _ in found for _, _, p in spans})
        scale = sum(prob.values()) or 1.0
        prob = {p: v / scale for p, v in prob.items()}
        for _ in range(rounds):
            expected: Counter = Counter()
            for spans, n, times in found:
                alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
                alpha[0] = beta[n] = 1.0
                for i, j, p in spans:
                    alpha[j] += alpha[i] * prob[p]
                for i, j, p in reversed(spans):
                    beta[i] += beta[j] * prob[p]
                for i, j, p in spans:
                    expected[p] += times * alpha[i] * prob[p] * beta[j] / alpha[n]
            total = sum(expected.values()) + smoothing * (len(pieces) + len(chars))
            prob = {p: (v + smoothing) / total for p, v in expected.items()}
        floor[at] = smoothing / total if found else 1e-9
        for p, v in prob.items():
            table.setdefault(p, np.full(len(languages), -1.0))[at] = v
    for p, v in table.items():
        table[p] = np.where(v < 0, floor, v)
    return Unigrams(languages, pieces, table, floor)


def identify(docs: DataFrame, key: str, text: str, label: str | None, model: Unigrams, min_words: int = MIN_WORDS, margin: float = MARGIN) -> DataFrame:
    """(key, line_no, language, confidence, named): one row per document with line_no -1, and one per foreign line.

    named: the two-letter code that the document's label names (rows with line_no -1 only).
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.pieces, model.table, model.floor))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        model = Unigrams(*shared.value)
        names = model.languages
        index: dict[str, int] = {}
        scores = np.zeros((1 << 14, len(names)), np.float32)
        for b in batches:
            keys, texts, labels = b.column("k").to_pylist(), b.column("t").to_pylist(), b.column("l").to_pylist()
            for low in range(0, len(keys), 500):
                out: dict[str, list] = {k: [] for k in ("k", "line_no", "language", "confidence", "named")}
                if len(index) > 500_000:
                    index.clear()
                lines, of, number, size, count = [], [], [], [], []
                for d, body in enumerate(texts[low : low + 500]):
                    for i, line in enumerate((body or "").lower().split("\n")):
                        if w := LETTERS.findall(line):
                            lines += w
                            of.append(d)
                            number.append(i)
                            size.append(len(w))
                            count.append(len(w) if line.isalpha() else len(ANY.findall(line)))
                ids = np.empty(len(lines), np.int64)
                for i, w in enumerate(lines):
                    at = index.get(w)
                    if at is None:
                        at = index[w] = len(index)
                        if at >= len(scores):
                            scores = np.concatenate([scores, np.zeros_like(scores)])
                        scores[at] = model.word(w)
                    ids[i] = at
                of = np.array(of, dtype=np.int64)
                if len(lines):
                    line_score = np.add.reduceat(scores[ids].astype(np.float64), np.cumsum(size) - size, axis=0)
                    best = line_score.argmax(1)
                    n = len(texts[low : low + 500])
                    votes = np.zeros((n, len(names)))
                    np.add.at(votes, (of, best), size)
                    total = np.zeros((n, len(names)))
                    np.add.at(total, of, line_score)
                    begin = np.searchsorted(of, np.arange(n + 1))  # lines are in the order of documents
                for d, (key, mark) in enumerate(zip(keys[low : low + 500], labels[low : low + 500])):
                    if not len(lines) or not votes[d].any():
                        row = (key, -1, None, 0.0, label_code(mark))
                        main = None
                    else:
                        most = np.flatnonzero(votes[d] == votes[d].max())
                        main = most[total[d][most].argmax()]
                        mine = slice(begin[d], begin[d + 1])
                        own = line_score[mine][best[mine] == main].sum(0)
                        row = (key, -1, names[main], float(1 / np.exp(np.minimum(own - own[main], 700)).sum()), label_code(mark))
                        votes[d, 0] = main
                    for k, v in zip(out, row):
                        out[k].append(v)
                if len(lines):
                    main = votes[of, 0].astype(np.int64)
                    gap = line_score[np.arange(len(of)), best] - line_score[np.arange(len(of)), main]
                    for i in np.flatnonzero((best != main) & (np.array(count) >= min_words) & (gap >= margin)):
                        row = (keys[low + of[i]], number[i], names[best[i]], float(1 / np.exp(line_score[i] - line_score[i].max()).sum()), None)
                        for k, v in zip(out, row):
                            out[k].append(v)
                yield out

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), (F.col(label) if label else F.lit(None)).cast("string").alias("l")).where("k IS NOT NULL")
    found = map_batches(rows, work, "k long, line_no int, language string, confidence double, named string")
    return found.dropDuplicates(["k", "line_no"]).withColumnRenamed("k", key)


def wrong_labels(docs: DataFrame, key: str, text: str, label: str, model: Unigrams, **how) -> DataFrame:
    """(key, line_no, language, confidence): documents whose label names no or another language, and foreign lines."""
    found = identify(docs, key, text, label, model, **how)
    return found.where("language IS NOT NULL AND (line_no >= 0 OR named IS NULL OR named <> language)").drop("named")


def refine(model: Unigrams, docs: DataFrame, key: str, text: str, label: str, samples: list[tuple[str, str]], most: int = SAMPLE) -> Unigrams:
    """``model`` trained again on its samples and on at most ``most`` labelled documents, taken in the order of a hash of the key.

    Only documents whose label agrees with the model serve, without the lines that it surely gives to another language.
    """
    ids = docs.select(F.col(key).alias("__k"), F.col(label).alias("__l")).where("__k IS NOT NULL AND __l IS NOT NULL").dropDuplicates(["__k"])
    ids = ids.orderBy(F.xxhash64("__k"), "__k").limit(most).select("__k")
    held = docs.join(F.broadcast(ids), F.col(key) == F.col("__k")).where(F.col(text) != "").groupBy("__k").agg(F.min(F.struct(F.col(text).alias("t"), F.col(label).alias("l"))).alias("x"))
    rows = held.select("__k", "x.t", "x.l").orderBy("__k").collect()  # at most ``most`` rows
    known: dict[str, np.ndarray] = {}
    more = list(samples)
    for r in rows:
        if (named := label_code(r.l)) not in model.languages:
            continue
        at, lines, total = model.languages.index(named), [], np.zeros(len(model.languages))
        for line in r.t.lower().split("\n"):
            if words := LETTERS.findall(line):
                for w in words:
                    if w not in known:
                        known[w] = model.word(w)
                score = sum(known[w] for w in words)
                total += score
                lines.append((line, score))
        if lines and total.argmax() == at:
            more += [(named, line) for line, score in lines if score.max() - score[at] < SURE]
    return train(more, model.pieces)


def model_of(samples: DataFrame, docs: DataFrame | None = None, most: int = 20_000, path: str = VOCABULARY) -> Unigrams:
    """A model trained on at most ``most`` rows of (language, sample); more than that is an error, not a cut.

    docs(doc_id, body, language): labelled documents, of which a bounded sample refines the model.
    """
    rows = samples.where("language IS NOT NULL AND sample IS NOT NULL").select("language", "sample").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} samples; pass a bounded sample of labelled rows")
    known = [(r.language, r.sample) for r in rows]
    model = train(known, vocabulary(path))
    return model if docs is None else refine(model, docs, "doc_id", "body", "language", known)
