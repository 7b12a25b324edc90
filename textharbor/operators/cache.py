"""Results of recent queries, kept on the driver."""

from __future__ import annotations

from collections import OrderedDict
from typing import Any

from textharbor.config import Ranking


class ResultCache:
    """Least recently used results; the key holds everything that decides a result, so a new generation misses."""

    def __init__(self, size: int = 256) -> None:
        self.size, self.hits, self.misses, self.evictions = size, 0, 0, 0
        self.kept: OrderedDict[tuple, Any] = OrderedDict()

    def get(self, query: str, k: int, ranking: Ranking, generation: int) -> Any | None:
        key = (query, k, ranking, generation)
        if key in self.kept:
            self.kept.move_to_end(key)
            self.hits += 1
            return self.kept[key]
        self.misses += 1
        return None

    def put(self, query: str, k: int, ranking: Ranking, generation: int, result: Any) -> None:
        self.kept[query, k, ranking, generation] = result
        self.kept.move_to_end((query, k, ranking, generation))
        while len(self.kept) > self.size:
            self.kept.popitem(last=False)
            self.evictions += 1

    @property
    def hit_rate(self) -> float:
        asked = self.hits + self.misses
        return self.hits / asked if asked else 0.0
