"""Hashes and integrity functions: FNV-1a, SimHash, Hamming distance, varints, deltas."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

# FNV-1a 64 offset and prime, the finalizer's addend and multipliers.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
MIX_0, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
MASK = (1 << 64) - 1


def fnv1a(data: bytes) -> int:
    h = FNV_OFFSET
    for byte in data:
        h = (h ^ byte) * FNV_PRIME & MASK
    return h


def fnv1a_many(values: list[bytes]) -> np.ndarray:
    """FNV-1a of many byte strings at once, column by column of equally long prefixes."""
    size = np.array([len(v) for v in values], dtype=np.int64)
    order = np.argsort(-size, kind="stable")
    flat = np.frombuffer(b"".join(values), dtype=np.uint8)
    start = np.cumsum(size) - size
    h = np.full(len(values), FNV_OFFSET, dtype=np.uint64)
    prime = np.uint64(FNV_PRIME)
    sorted_size = size[order]
    with np.errstate(over="ignore"):
        for i in range(int(size.max(initial=0))):
            active = order[: np.searchsorted(-sorted_size, -i, side="left")]
            h[active] = (h[active] ^ flat[start[active] + i].astype(np.uint64)) * prime
    return h


def _mix(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = z + np.uint64(MIX_0)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_1)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_2)
        return z ^ (z >> np.uint64(31))


def simhash_many(texts: list[str]) -> np.ndarray:
    """SimHash-64 over runs of five words, of many texts at once; one run where there are fewer words, 0 where there are none."""
    out = np.zeros(len(texts), dtype=np.uint64)
    for low in range(0, len(texts), 256):  # bits of all runs of a slice stay small
        runs, size = [], []
        for t in texts[low : low + 256]:
            words = t.split()
            own = [" ".join(words[i : i + 5]).encode("utf-8", "surrogatepass") for i in range(max(1, len(words) - 4))] if words else []
            runs += own
            size.append(len(own))
        size = np.array(size, dtype=np.int64)
        use = np.flatnonzero(size)
        if not len(use):
            continue
        h = _mix(fnv1a_many(runs))
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes = np.add.reduceat(bits, (np.cumsum(size) - size)[use], axis=0, dtype=np.int64) * 2 - size[use, None]
        out[low + use] = np.packbits(votes > 0, axis=1, bitorder="little").view("<u8").ravel()
    return out


def simhash_of(text: str) -> int:
    return int(simhash_many([text])[0])


@F.pandas_udf(StringType())
def fnv1a_hex(text: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """16 hex digits of FNV-1a 64 of the UTF-8 bytes."""
    for s in text:
        known = s.notna().to_numpy()
        out = np.full(len(s), None, dtype=object)
        if known.any():
            out[known] = [f"{int(h):016x}" for h in fnv1a_many([t.encode("utf-8", "surrogatepass") for t in s[known]])]
        yield pd.Series(out)


@F.pandas_udf(LongType())
def simhash(text: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """SimHash-64 of normalized text, as a signed number."""
    for s in text:
        known = s.notna()
        out = pd.Series(pd.NA, index=s.index, dtype="Int64")
        out[known] = simhash_many(s[known].tolist()).view(np.int64)
        yield out


@F.pandas_udf(LongType())
def shard_hash(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """FNV-1a 64 of the little-endian bytes of an id, as a signed number."""
    for s in ids:
        h = np.full(len(s), FNV_OFFSET, dtype=np.uint64)
        v = s.to_numpy(dtype=np.int64).view(np.uint64)
        with np.errstate(over="ignore"):
            for i in range(8):
                h = (h ^ ((v >> np.uint64(8 * i)) & np.uint64(255))) * np.uint64(FNV_PRIME)
        yield pd.Series(h.view(np.int64))


def shard_of(doc_id: Column, shards: int) -> Column:
    """Shard number: the unsigned hash modulo the number of shards."""
    h = shard_hash(doc_id)
    wrapped = F.when(h >= 0, h % shards).otherwise((h % shards + shards + (1 << 64) % shards) % shards)
    return wrapped.cast("int")


@F.pandas_udf(LongType())
def splitmix(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """SplitMix64's finalizer of a number, as a signed number."""
    for s in values:
        yield pd.Series(_mix(s.to_numpy(dtype=np.int64).view(np.uint64)).view(np.int64))


def shingles(words: Column, size: int = 5) -> Column:
    """All runs of so many words, joined by blanks; none where there are fewer words."""
    # bound as a lambda's variable, so that the words are made once and not for every run
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.array_join(F.slice(w, i, size), " "))
    none = F.array().cast("array<string>")
    return F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) >= size, runs(w)).otherwise(none)), F.lit(0))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def crc32(text: Column) -> Column:
    """CRC32 of the UTF-8 bytes."""
    return F.crc32(text.cast("binary"))


def encode_varint(value: int) -> bytes:
    out = bytearray()
    while value >= 128:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def decode_varint(data: bytes) -> tuple[int, int] | None:
    """(value, bytes read), or None where data is cut off or exceeds 64 bits."""
    value = 0
    for i, byte in enumerate(data):
        value |= (byte & 127) << 7 * i
        if value > MASK:
            return None
        if byte < 128:
            return value, i + 1
    return None


def varint_len(value: Column) -> Column:
    """Bytes that a value takes as a varint."""
    return F.ceil(F.length(F.bin(value)) / 7).cast("int")


def encode_deltas(values: Column) -> Column:
    """First value and differences of an increasing array."""
    return F.transform(values, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(values, i - 1)))


def decode_deltas(values: Column) -> Column:
    """Running sums of an array of differences."""
    zero = F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<bigint>").alias("out"))
    step = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"] + x)).alias("out"))
    return F.aggregate(values, zero, step, lambda acc: acc["out"])
