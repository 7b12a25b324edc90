"""Snippets and escaping for result pages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textharbor.functions.stemmer import stem

BEFORE = 60
_WORD = re.compile(r"[^\W_]+")


def escape_html(text: Column) -> Column:
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def _escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def snippet_of(body: str | None, title: str | None, terms: frozenset[str], stemmer: str, size: int) -> str:
    """A window that starts 60 characters before the first match, matches marked; the title stands in for an empty body."""
    text = body or title or ""
    hits = [m.span() for m in _WORD.finditer(text) if stem(m.group().lower(), stemmer) in terms]
    low = max(0, (hits[0][0] if hits else 0) - BEFORE)
    high = min(len(text), low + size)
    out, at = ["…" if low else ""], low
    for start, end in hits:
        start, end = max(start, low), min(end, high)
        if start < end:
            # a word cut by the window's edge is marked only if what is left of it matches too
            if stem(text[start:end].lower(), stemmer) not in terms:
                continue
            out += [_escape(text[at:start]), "<mark>", _escape(text[start:end]), "</mark>"]
            at = end
    return "".join([*out, _escape(text[at:high]), "…" if high < len(text) else ""])


def snippet(body: Column, title: Column, terms: list[str], stemmer: str = "porter", size: int = 200) -> Column:
    """Snippets of result rows."""
    wanted = frozenset(terms)

    @F.pandas_udf(StringType())
    def made(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for bodies, titles in rows:
            yield pd.Series([snippet_of(b, t, wanted, stemmer, size) for b, t in zip(bodies, titles)], dtype=object)

    return made(body, title)
