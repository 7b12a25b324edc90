"""Typed configuration: defaults, validation, TOML."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, replace

FIELDS = ("title", "heading", "body", "anchor")
#: Names under which queries may scope a word to a field.
FIELD_NAMES = {"title": 0, "heading": 1, "headings": 1, "h": 1, "body": 2, "anchor": 3}


class ConfigError(ValueError):
    """A key is unknown or a value out of its range."""


def _within(name: str, value: float, low: float, high: float, open_low: bool = False) -> None:
    if not (low < value <= high if open_low else low <= value <= high):
        raise ConfigError(f"{name} = {value} is outside of {'(' if open_low else '['}{low}, {high}]")


@dataclass(frozen=True)
class FieldAnalysis:
    stop_words: bool = True
    stemmer: str = "porter"
    min_token_len: int = 1

    def __post_init__(self) -> None:
        if self.stemmer not in ("none", "porter"):
            raise ConfigError(f"stemmer = {self.stemmer!r} is neither none nor porter")
        _within("min_token_len", self.min_token_len, 1, 64)


@dataclass(frozen=True)
class Analysis:
    """Analyzer settings with overrides by field; a field inherits what it does not set."""

    base: FieldAnalysis = FieldAnalysis()
    overrides: dict[int, dict] = field(default_factory=dict)

    def of(self, number: int) -> FieldAnalysis:
        return replace(self.base, **self.overrides.get(number, {}))


PLAIN = Analysis(FieldAnalysis(stop_words=False, stemmer="none"))
UNSTEMMED = Analysis(FieldAnalysis(stop_words=True, stemmer="none"))


@dataclass(frozen=True)
class Ranking:
    scoring: str = "bm25"
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    title_weight: float = 4.0
    heading_weight: float = 2.0
    body_weight: float = 1.0
    anchor_weight: float = 1.5
    authority_weight: float = 0.0
    freshness_weight: float = 0.0
    freshness_halflife_days: float = 30.0

    def __post_init__(self) -> None:
        object.__setattr__(self, "scoring", "tfidf" if self.scoring == "tf-idf" else self.scoring)
        if self.scoring not in ("bm25", "tfidf"):
            raise ConfigError(f"scoring = {self.scoring!r} is neither bm25 nor tfidf")
        _within("bm25_k1", self.bm25_k1, 0, 10, open_low=True)
        _within("bm25_b", self.bm25_b, 0, 1)
        _within("authority_weight", self.authority_weight, 0, 10)
        _within("freshness_weight", self.freshness_weight, 0, 10)
        _within("freshness_halflife_days", self.freshness_halflife_days, 1, 3650)

    @property
    def weights(self) -> tuple[float, float, float, float]:
        return self.title_weight, self.heading_weight, self.body_weight, self.anchor_weight


@dataclass(frozen=True)
class QuerySettings:
    top_k: int = 20
    max_query_terms: int = 64

    def __post_init__(self) -> None:
        _within("top_k", self.top_k, 1, 10_000)


@dataclass(frozen=True)
class Crawler:
    delay_ms: int = 1000
    max_depth: int = 3
    max_pages: int = 10_000
    max_retries: int = 3
    backoff_ms: int = 2000
    timeout_s: int = 15
    max_body_bytes: int = 8 << 20
    max_redirects: int = 5
    max_connections: int = 16
    max_inflight_per_host: int = 1


@dataclass(frozen=True)
class IndexSettings:
    segment_target_mb: int = 64


@dataclass(frozen=True)
class Cluster:
    """Accepted and validated; Spark's scheduler does what it would configure."""

    shard_count: int = 4
    replication_factor: int = 1

    def __post_init__(self) -> None:
        _within("shard_count", self.shard_count, 1, 1024)
        _within("replication_factor", self.replication_factor, 1, 8)


@dataclass(frozen=True)
class Config:
    analysis: Analysis = Analysis()
    ranking: Ranking = Ranking()
    query: QuerySettings = QuerySettings()
    crawler: Crawler = Crawler()
    index: IndexSettings = IndexSettings()
    cluster: Cluster = Cluster()

    @staticmethod
    def from_toml(text: str) -> Config:
        """Configuration of a TOML text; unknown sections and keys are errors."""
        try:
            data = tomllib.loads(text)
        except tomllib.TOMLDecodeError as e:
            raise ConfigError(str(e)) from e
        parts: dict = {}
        for name, values in data.items():
            if name == "analysis":
                overrides = {}
                for key in [k for k, v in values.items() if isinstance(v, dict)]:
                    if key not in FIELDS:
                        raise ConfigError(f"unknown field [analysis.{key}]")
                    overrides[FIELDS.index(key)] = _known(FieldAnalysis, f"analysis.{key}", values.pop(key))
                parts[name] = Analysis(FieldAnalysis(**_known(FieldAnalysis, name, values)), overrides)
                for number in overrides:
                    parts[name].of(number)
            elif name in (sections := {f.name: f.default.__class__ for f in fields(Config)}):
                parts[name] = sections[name](**_known(sections[name], name, values))
            else:
                raise ConfigError(f"unknown section [{name}]")
        return Config(**parts)


def _known(kind: type, section: str, values: dict) -> dict:
    if unknown := set(values) - {f.name for f in fields(kind)}:
        raise ConfigError(f"unknown key {section}.{sorted(unknown)[0]}")
    return values
