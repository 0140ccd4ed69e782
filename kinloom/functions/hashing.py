"""Hashes of tokens and grams: a native 60-bit one, and the 64-bit wrap-around family for equal fingerprints."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the wrap-around family.
TOKEN_OFFSET, STANDARD_OFFSET, PRIME, BASE = 1469598103934665603, 0xCBF29CE484222325, 1099511628211, 202602101053
TREE_MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def md5_60(text: Column) -> Column:
    """The first 60 bits of the MD5 digest as a non-negative number."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def fnv(text: str, offset: int = TOKEN_OFFSET) -> int:
    """Xor a UTF-16 unit, multiply by the prime, modulo 2**64."""
    h = offset
    for unit in np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16).tolist():
        h = ((h ^ unit) * PRIME) & _MASK
    return h


def subtree(label: str, kids: list[int]) -> int:
    """Hash of a tree node over its children's hashes, in order, modulo 2**64."""
    h = fnv(label, STANDARD_OFFSET)
    for k in kids:
        h = (h * TREE_MULTIPLIER & _MASK) ^ k
    return h


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of each k consecutive token hashes; none if there are fewer."""
    m = len(hashes) - k + 1
    if m <= 0 or k <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:m].copy()
    with np.errstate(over="ignore"):
        for i in range(1, k):
            out = out * np.uint64(BASE) + hashes[i : i + m]
    return out


def winnow(grams: np.ndarray, w: int) -> list[tuple[int, int]]:
    """(hash, position) of the rightmost unsigned minimum of each window of w, when it changes."""
    n = len(grams)
    if n == 0 or w <= 0:
        return []
    out, last = [], -1
    for i in range(max(1, n - w + 1)):
        part = grams[i : i + w]
        at = i + len(part) - 1 - int(part[::-1].argmin())
        if at != last:
            out.append((int(grams[at]), at))
            last = at
    return out


def fingerprints_column(tokens: Column, k: int, w: int) -> Column:
    """array<struct<hash, pos>> in the wrap-around family (hash as a signed long), by Arrow batches."""
    kind = T.ArrayType(T.StructType([T.StructField("hash", T.LongType()), T.StructField("pos", T.IntegerType())]))

    def run(lists: pa.Array) -> pa.Array:
        known: dict[str, int] = {}
        rows = []
        for x in lists:
            words = x.as_py() or []
            for t in words:
                if t not in known:
                    known[t] = fnv(t)
            grams = rolling(np.array([known[t] for t in words], np.uint64), k)
            rows.append([{"hash": h - (1 << 64) if h >> 63 else h, "pos": p} for h, p in winnow(grams, w)])
        return pa.array(rows, pa.list_(pa.struct([("hash", pa.int64()), ("pos", pa.int32())])))

    return F.arrow_udf(run, kind)(tokens)


def bucket(channel: Column, value: Column, buckets: int) -> Column:
    """crc32 of channel, NUL and value, modulo buckets."""
    return F.pmod(F.crc32(F.concat(channel, F.lit("\0"), value).cast("binary")), F.lit(buckets)).cast("int")


def mix(a: Column, b: Column) -> Column:
    """A native stand-in for the xorshift-multiply mix: 60 bits of a digest of both."""
    return md5_60(F.concat_ws("|", a.cast("string"), b.cast("string")))
