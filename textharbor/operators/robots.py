"""robots.txt: rules as rows, decisions by the longest match."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

PARSED = StructType(
    [
        StructField("rules", ArrayType(StructType([StructField("allow", BooleanType()), StructField("pattern", StringType()), StructField("size", IntegerType())]))),
        StructField("delay_ms", DoubleType()),
    ]
)


def parse(body: str | None, agent: str) -> tuple[list[tuple[bool, str, int]], float | None]:
    """(allow, regular expression, length) of the rules for an agent, and its crawl delay in ms. The agent's own group wins over ``*``."""
    groups: dict[str, tuple[list, list]] = {}
    names: list[str] = []
    open_ = False
    for line in (body or "").splitlines():
        key, colon, value = line.partition("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "user-agent":
            names = [*names, value.lower()] if open_ else [value.lower()]
            open_ = True
            for name in names:
                groups.setdefault(name, ([], []))
            continue
        open_ = False
        for name in names:
            rules, delays = groups[name]
            if key in ("allow", "disallow") and value:
                end = value.endswith("$")
                parts = (value[:-1] if end else value).split("*")
                rules.append((key == "allow", "^" + ".*".join(map(re.escape, parts)) + ("$" if end else ""), len(value)))
            elif key == "crawl-delay":
                try:
                    delays.append(float(value) * 1000)
                except ValueError:
                    pass
    own = next((groups[n] for n in sorted(groups, key=len, reverse=True) if n != "*" and n and n in agent.lower()), groups.get("*", ([], [])))
    return own[0], own[1][0] if own[1] else None


def rules_of(robots: DataFrame, agent: str) -> DataFrame:
    """(host, rules, delay_ms) of ``robots(host, body)``."""

    @F.pandas_udf(PARSED)
    def parsed(bodies: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in bodies:
            rows = [parse(b, agent) for b in s]
            yield pd.DataFrame({"rules": [[{"allow": a, "pattern": p, "size": n} for a, p, n in r] for r, _ in rows], "delay_ms": [d for _, d in rows]})

    return robots.select("host", parsed("body").alias("x")).select("host", "x.rules", "x.delay_ms")


def allowed(requests: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """``requests(host, path)`` with allowed and delay_ms. The longest matching rule decides, Allow wins ties; without rules all is allowed."""
    joined = requests.join(rules_of(robots, agent), "host", "left")
    hits = F.filter(F.coalesce("rules", F.array().cast("array<struct<allow:boolean,pattern:string,size:int>>")), lambda r: F.regexp_like(F.col("path"), r["pattern"]))
    best = F.array_max(F.transform(hits, lambda r: F.struct(r["size"].alias("size"), r["allow"].alias("allow"))))
    return joined.withColumn("allowed", F.coalesce(best["allow"], F.lit(True))).drop("rules")
