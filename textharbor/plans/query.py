"""Queries: syntax tree and parser. Everything here runs on the driver."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from textharbor.config import FIELD_NAMES, Analysis
from textharbor.functions.analysis import analyze


class InvalidQuery(ValueError):
    """The query text cannot be parsed."""


class Query:
    """A node; ``leaves`` walks the nodes that look at documents, with whether a NOT stands above them."""

    def children(self) -> tuple[Query, ...]:
        return ()

    def leaves(self, negated: bool = False) -> Iterator[tuple[Query, bool]]:
        if not self.children():
            yield self, negated
        for child in self.children():
            yield from child.leaves(negated or isinstance(self, Not))

    def leaf_count(self) -> int:
        return sum(max(1, len(q.terms)) if isinstance(q, Phrase) else not isinstance(q, (MatchAll, MatchNothing)) for q, _ in self.leaves())


@dataclass(frozen=True)
class Term(Query):
    field: int | None
    term: str


@dataclass(frozen=True)
class Phrase(Query):
    field: int
    terms: tuple[str, ...]


@dataclass(frozen=True)
class Prefix(Query):
    field: int | None
    prefix: str


@dataclass(frozen=True)
class Fuzzy(Query):
    field: int | None
    term: str
    distance: int


@dataclass(frozen=True)
class Site(Query):
    needle: str


@dataclass(frozen=True)
class And(Query):
    arms: tuple[Query, ...]

    def children(self) -> tuple[Query, ...]:
        return self.arms


@dataclass(frozen=True)
class Or(Query):
    arms: tuple[Query, ...]

    def children(self) -> tuple[Query, ...]:
        return self.arms


@dataclass(frozen=True)
class Not(Query):
    arm: Query

    def children(self) -> tuple[Query, ...]:
        return (self.arm,)


@dataclass(frozen=True)
class MatchAll(Query):
    pass


@dataclass(frozen=True)
class MatchNothing(Query):
    pass


def _joined(kind: type, arms: list[Query]) -> Query:
    return arms[0] if len(arms) == 1 else kind(tuple(arms))


def words_query(analysis: Analysis, field: int | None, raw: str) -> Query:
    """All terms of a raw text, within one field or, unscoped, within any one of the fields by its own analysis."""
    arms = []
    for number in range(4) if field is None else (field,):
        if terms := sorted({t for t, _ in analyze(raw, analysis.of(number))}):
            arms.append(_joined(And, [Term(number, t) for t in terms]))
    return _joined(Or, arms) if arms else MatchNothing()


def phrase_query(analysis: Analysis, field: int, raw: str) -> Query:
    terms = tuple(t for t, _ in analyze(raw, analysis.of(field)))
    if len(terms) > 1:
        return Phrase(field, terms)
    return Term(field, terms[0]) if terms else MatchNothing()


_TOKENS = re.compile(r'(?P<open>\()|(?P<close>\))|(?:(?P<scope>[A-Za-z]+):)?"(?P<phrase>[^"]*)(?:"|$)|(?P<word>[^\s()"]+)')


class Parser:
    """Recursive descent: OR binds weakest, then AND or mere juxtaposition, then NOT.

    scoped_phrases: ``title:"a b"`` is a phrase of that field. Without, the field name stands alone and matches nothing.
    """

    def __init__(self, analysis: Analysis, text: str, scoped_phrases: bool = True) -> None:
        self.analysis = analysis
        self.tokens: list[tuple[str, str, int | None]] = []
        for m in _TOKENS.finditer(text):
            if m["phrase"] is not None:
                scope = FIELD_NAMES.get((m["scope"] or "").lower())
                if m["scope"] and (scope is None or not scoped_phrases):
                    self.tokens.append(("word", m["scope"] + ":", None))
                    scope = None
                self.tokens.append(("phrase", m["phrase"], scope))
            elif m["word"] is not None:
                upper = m["word"].upper()
                self.tokens.append((upper, "", None) if upper in ("AND", "OR", "NOT") else ("word", m["word"], None))
            else:
                self.tokens.append((m[0], "", None))
        self.at = 0

    def next_kind(self) -> str | None:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else None

    def take(self, kind: str) -> bool:
        if self.next_kind() == kind:
            self.at += 1
            return True
        return False

    def any_of(self) -> Query:
        arms = [self.all_of()]
        while self.take("OR"):
            arms.append(self.all_of())
        return _joined(Or, arms)

    def all_of(self) -> Query:
        arms = [self.negation()]
        while self.take("AND") or self.next_kind() in ("word", "phrase", "(", "NOT"):
            arms.append(self.negation())
        return _joined(And, arms)

    def negation(self) -> Query:
        return Not(self.negation()) if self.take("NOT") else self.primary()

    def primary(self) -> Query:
        if self.next_kind() is None:
            raise InvalidQuery("the query ends too early")
        kind, text, scope = self.tokens[self.at]
        self.at += 1
        if kind == "(":
            inner = self.any_of()
            if not self.take(")"):
                raise InvalidQuery("an opening bracket is not closed")
            return inner
        if kind == "phrase":
            return phrase_query(self.analysis, 2 if scope is None else scope, text)
        if kind == "word":
            return self.word(text)
        raise InvalidQuery(f"unexpected {kind}")

    def word(self, text: str) -> Query:
        if text.startswith("site:"):
            return Site(text[5:].strip().lower()) if text[5:].strip() else MatchNothing()
        name, colon, rest = text.partition(":")
        field = FIELD_NAMES.get(name.lower()) if colon else None
        if field is None:
            rest = text
        if not rest:
            return MatchNothing()
        if (m := re.fullmatch(r"(.+)~([12]?)", rest, re.S)) and "~" not in m[2]:
            term = self.first_term(field, m[1])
            return Fuzzy(field, term, int(m[2] or 1)) if term else MatchNothing()
        if rest.endswith("*"):
            term = self.first_term(field, rest[:-1])
            return Prefix(field, term) if term else MatchNothing()
        return words_query(self.analysis, field, rest)

    def first_term(self, field: int | None, raw: str) -> str | None:
        terms = analyze(raw, self.analysis.of(2 if field is None else field))
        return terms[0][0] if terms else None


def parse(text: str, analysis: Analysis, max_terms: int = 64, scoped_phrases: bool = True) -> Query:
    """Query of a text; blank text matches nothing."""
    if not text.strip():
        return MatchNothing()
    parser = Parser(analysis, text, scoped_phrases)
    query = parser.any_of()
    if parser.next_kind() is not None:
        raise InvalidQuery(f"unexpected {parser.next_kind()}")
    if query.leaf_count() > max_terms:
        raise InvalidQuery(f"the query has more than {max_terms} terms")
    return query
