"""Words of many texts at once, on their UTF-8 bytes.

Words are runs of ``[^\\x20\\x09-\\x0D]``. A word's 64-bit hash is a polynomial in its bytes modulo
2**64, mixed afterwards; everything is numpy over the bytes of a batch, in slices of bounded size
(one very long text is a slice of its own).
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_R = 0x9E3779B97F4A7C15
_RI = pow(_R, -1, 1 << 64)
_POW: dict[str, np.ndarray] = {}


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


_KEPT: list[Callable[[], None]] = []


def kept(cached):
    """An lru_cache that workers keep between their operator's tasks, and that release() in another operator's task empties."""
    _KEPT.append(cached.cache_clear)
    return cached


def release() -> None:
    """Give memory back: Python workers wait for further tasks, and those of several stages share an executor."""
    for clear in _KEPT:
        clear()
    if _POW and len(_POW["p"]) > SLICE + (SLICE >> 3):
        _POW.clear()  # grown for a very long text
    pa.default_memory_pool().release_unused()
    _TRIM(0)


def trimmed(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f, and release() at a task's end."""

    @wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        release()

    return run


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every bit of the input reaches every bit of the output."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POW or len(_POW["p"]) < n:
        size = max(n, SLICE + (SLICE >> 3))
        with np.errstate(over="ignore"):
            for name, r in (("p", _R), ("i", _RI)):
                steps = np.full(size, r, np.uint64)
                steps[0] = 1
                _POW[name] = np.multiply.accumulate(steps)
    return _POW["p"], _POW["i"]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about SLICE bytes each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def segments_hash(data: np.ndarray, starts: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
    """Hash of each segment from one start to the next, of the bytes where keep holds."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    p, inv = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        v = (data.astype(np.uint64) + np.uint64(1)) * p[: len(data)]
        if keep is not None:
            v *= keep
        return mix(np.add.reduceat(v, starts) * inv[starts])


def words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, starts of words, index of the first word of each text and the end) of one slice; offsets from 0."""
    if lower:
        data = _LOWER[data]
    solid = ~_SPACE[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[heads] = solid[heads]
    starts = np.flatnonzero(begin)
    return segments_hash(data, starts, solid), starts, np.searchsorted(starts, offsets)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words (len(h) - n + 1 of them, across texts too)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = h[:m] + np.uint64(n)
        for k in range(1, n):
            out = out * np.uint64(0xD6E8FEB86659FD93) + h[k : k + m]
        return mix(out)
