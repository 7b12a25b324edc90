"""Canonical URLs, hosts, links and the addresses that a crawler may fetch."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

PORTS = {"http": 80, "https": 443}
REFUSED = ("#", "javascript:", "mailto:", "data:")


def canonical(raw: str | None) -> str | None:
    """http, https or file URL with lower-case scheme and host, without default port, fragment and dot segments; else None."""
    try:
        parts = urlsplit((raw or "").strip())
        scheme, host, port = parts.scheme.lower(), parts.hostname or "", parts.port
    except ValueError:
        return None
    if scheme not in (*PORTS, "file") or (scheme != "file" and not host):
        return None
    keep: list[str] = []
    pieces = parts.path.split("/")
    for i, piece in enumerate(pieces):
        last = i == len(pieces) - 1
        if piece == "..":
            keep = keep[:-1] if len(keep) > 1 else keep
        elif piece != ".":
            keep.append(piece)
            continue
        if last:
            keep.append("")
    path = "/".join(keep)
    path = path if path.startswith("/") else "/" + path
    user = parts.netloc.rpartition("@")[0]
    place = (f"{user}@" if user else "") + (f"[{host}]" if ":" in host else host)
    if port is not None and port != PORTS.get(scheme):
        place += f":{port}"
    return urlunsplit((scheme, place, path, parts.query, ""))


def resolve(base: str, href: str | None) -> str | None:
    """Canonical URL of a link on a page; None for links that lead nowhere to fetch."""
    href = (href or "").strip()
    if not href or href.lower().startswith(REFUSED):
        return None
    try:
        return canonical(urljoin(base, href))
    except ValueError:
        return None


@F.pandas_udf(StringType())
def _canonical(urls: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in urls:
        yield s.map(canonical, na_action="ignore")


#: Addresses without user, dot segments or odd characters, whose canonical form takes no parser.
_PLAIN = r"^([Hh][Tt][Tt][Pp][Ss]?)://([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)(?::(80|443))?(/[A-Za-z0-9_~%+=&;,!$'()*:-]*(?:[./]+[A-Za-z0-9_~%+=&;,!$'()*:-]+)*/?)?(\?[^#\s\\\x00-\x1f]+)?$"


def canonical_url(url: Column | str) -> Column:
    """``canonical`` of a column: by expressions where the address is plain, by the parser elsewhere."""
    url = F.col(url) if isinstance(url, str) else url
    part = lambda i: F.regexp_extract(url, _PLAIN, i)
    scheme, port, path = F.lower(part(1)), part(3), part(4)
    simple = url.rlike(_PLAIN) & ~url.rlike(r"/\.|//.*//|\.\./") & ~((scheme == "http") & (port == "443") | (scheme == "https") & (port == "80"))
    plain = F.concat(scheme, F.lit("://"), F.lower(part(2)), F.when(path == "", "/").otherwise(path), part(5))
    return F.when(simple, plain).otherwise(_canonical(F.when(simple, F.lit(None)).otherwise(url)))


@F.pandas_udf(StringType())
def resolve_url(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for base, href in pairs:
        yield pd.Series([resolve(b, h) for b, h in zip(base, href)], dtype=object)


def host_of(url: Column) -> Column:
    """Host in lower case; null where the URL has none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def address_allowed(address: str) -> bool:
    """Whether an address is public: loopback, private, link-local, multicast and reserved ones are not fetched."""
    try:
        ip = ipaddress.ip_address(address)
    except ValueError:
        return False
    if getattr(ip, "ipv4_mapped", None):
        ip = ip.ipv4_mapped
    return ip.is_global and not ip.is_multicast


@F.pandas_udf(BooleanType())
def addresses_allowed(addresses: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``address_allowed`` of a column: each distinct address of a batch is judged once."""
    for s in addresses:
        yield s.map({a: address_allowed(a) for a in s.dropna().unique()}).astype("boolean")
