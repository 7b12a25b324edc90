"""Analysis of text to positioned terms, as columns and, for queries, in plain Python."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from textharbor.config import FieldAnalysis
from textharbor.functions.stemmer import porter, stem

# Fixed value: the stop words, tested in lower case before stemming.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()
TOKEN = r"[\p{IsAlphabetic}\p{N}]+"
_PLAIN = re.compile(r"[^\W_]+")


def tokenize(text: str) -> list[str]:
    """Maximal runs of letters and digits."""
    return _PLAIN.findall(text)


def analyze(text: str, how: FieldAnalysis) -> list[tuple[str, int]]:
    """(term, position) of a query's text. Positions count all tokens, so those left out leave gaps."""
    out = []
    for position, raw in enumerate(tokenize(text)):
        word = raw.lower()
        if how.stop_words and word in STOP_WORDS:
            continue
        term = stem(word, how.stemmer)
        if len(term) >= how.min_token_len:
            out.append((term, position))
    return out


@F.pandas_udf(ArrayType(StringType()))
def _stems(tokens: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Stems of token arrays; each worker stems a distinct word once."""
    known: dict[str, str] = {}
    for s in tokens:
        if len(known) > 1_000_000:
            known.clear()
        for ws in s:
            for w in ws if ws is not None else ():
                if w not in known:
                    known[w] = porter(w)
        yield s.map(lambda ws: None if ws is None else [known[w] for w in ws])


def analyzed(text: Column, how: FieldAnalysis) -> Column:
    """array<struct<position, term>> of a text column; null text has no terms."""
    words = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)
    terms = _stems(words) if how.stemmer == "porter" else words
    pairs = F.arrays_zip(words.alias("w"), terms.alias("t"))
    at = F.transform(pairs, lambda x, i: F.struct(i.alias("position"), x["t"].alias("term"), x["w"].alias("word")))
    keep = F.filter(at, lambda x: _kept(x, how))
    return F.transform(keep, lambda x: F.struct(x["position"].cast("int").alias("position"), x["term"].alias("term")))


def _kept(x: Column, how: FieldAnalysis) -> Column:
    kept = F.length(x["term"]) >= how.min_token_len
    return kept & ~x["word"].isin(STOP_WORDS) if how.stop_words else kept


def field_texts(docs: DataFrame) -> dict[int, Column]:
    """The text of each field: title, headings and anchors joined by line breaks, body."""
    return {
        0: F.coalesce(F.col("title"), F.lit("")),
        1: F.coalesce(F.array_join("headings", "\n"), F.lit("")),
        2: F.coalesce(F.col("body"), F.lit("")),
        3: F.coalesce(F.array_join("anchor_text", "\n"), F.lit("")),
    }


def normalize_text(text: Column) -> Column:
    """Lower case with runs of blanks collapsed, as content hashes take it."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
