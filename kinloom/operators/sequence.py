"""Sequence comparison: longest common subsequence, edit scripts, renames, tree edit distance."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a: Sequence, b: Sequence) -> int:
    """Bit-parallel longest common subsequence (Hyyro, 2004): one word operation for each element of b."""
    if not a or not b:
        return 0
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def lcs_similarity(a: Sequence, b: Sequence) -> float:
    """LCS length over the longer length; two empty sequences are alike."""
    return 1.0 if not a and not b else lcs_length(a, b) / max(len(a), len(b))


def _suffix_table(a: Sequence, b: Sequence) -> np.ndarray:
    """LCS lengths of all suffixes, row by row: codes compared at once, maxima by accumulation."""
    codes: dict = {}
    x, y = (np.array([codes.setdefault(t, len(codes)) for t in s], np.int64) for s in (a, b))
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a) - 1, -1, -1):
        best = np.where(y == x[i], table[i + 1, 1:] + 1, table[i + 1, :-1])
        table[i, :-1] = np.maximum.accumulate(best[::-1])[::-1]
    return table


def edit_script(left: Sequence[str], right: Sequence[str]) -> list[tuple[str, str, str]]:
    """(kind, left, right) changes: gaps between matches pair up as MODIFIED, what is over is DELETED or INSERTED.

    Of equally good ways the one that advances on the left first is taken.
    """
    table, out = _suffix_table(left, right), []
    i = j = from_i = from_j = 0

    def gap(to_i: int, to_j: int) -> None:
        gone, come = left[from_i:to_i], right[from_j:to_j]
        both = min(len(gone), len(come))
        out.extend(("MODIFIED", x, y) for x, y in zip(gone[:both], come[:both], strict=True))
        out.extend(("DELETED", x, "") for x in gone[both:])
        out.extend(("INSERTED", "", y) for y in come[both:])

    while i < len(left) and j < len(right):
        if left[i] == right[j]:
            gap(i, j)
            i, j = i + 1, j + 1
            from_i, from_j = i, j
        elif table[i + 1, j] >= table[i, j + 1]:
            i += 1
        else:
            j += 1
    gap(len(left), len(right))
    return out


def tree_distance(a: list[tuple[int, str]], b: list[tuple[int, str]]) -> int:
    """Unit-cost edit distance of ordered trees (Zhang and Shasha, 1989); nodes in postorder as (leftmost leaf, label)."""

    def roots(t: list[tuple[int, str]]) -> list[int]:
        last = {}
        for i, (leaf, _) in enumerate(t):
            last[leaf] = i
        return sorted(last.values())

    n, m = len(a), len(b)
    if not n or not m:
        return n + m
    d = np.zeros((n, m), np.int64)
    for i in roots(a):
        for j in roots(b):
            li, lj = a[i][0], b[j][0]
            f = np.zeros((i - li + 2, j - lj + 2), np.int64)
            f[:, 0], f[0, :] = np.arange(i - li + 2), np.arange(j - lj + 2)
            for x in range(li, i + 1):
                for y in range(lj, j + 1):
                    p, q = x - li + 1, y - lj + 1
                    least = min(f[p - 1, q], f[p, q - 1]) + 1
                    if a[x][0] == li and b[y][0] == lj:
                        f[p, q] = min(least, f[p - 1, q - 1] + (a[x][1] != b[y][1]))
                        d[x, y] = f[p, q]
                    else:
                        f[p, q] = min(least, f[a[x][0] - li, b[y][0] - lj] + d[x, y])
    return int(d[n - 1, m - 1])


def lcs_similarity_column(a: Column, b: Column) -> Column:
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([lcs_similarity(p or [], q or []) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.float64())

    return F.arrow_udf(run, T.DoubleType())(a, b)


EDIT = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "left", "right")]))


def edit_script_column(a: Column, b: Column) -> Column:
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        rows = [[{"kind": k, "left": u, "right": v} for k, u, v in edit_script(p or [], q or [])] for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)]
        return pa.array(rows, pa.list_(pa.struct([(n, pa.string()) for n in ("kind", "left", "right")])))

    return F.arrow_udf(run, EDIT)(a, b)


def tree_distance_column(a: Column, b: Column) -> Column:
    """Distance of two array<struct<leaf int, label string>> in postorder."""

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        plain = lambda t: [(n["leaf"], n["label"]) for n in t or []]
        return pa.array([tree_distance(plain(p), plain(q)) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.int32())

    return F.arrow_udf(run, T.IntegerType())(a, b)


def rename_map(left: Column, right: Column, normal_left: Column, normal_right: Column) -> Column:
    """struct(renames, conflict): raw tokens at positions where both sides are an ID; the first name of a token wins."""
    zipped = F.arrays_zip(left.alias("l"), right.alias("r"), normal_left.alias("nl"), normal_right.alias("nr"))
    same = F.filter(zipped, lambda z: (z["nl"] == "ID") & (z["nr"] == "ID") & (z["l"] != z["r"]))
    ids = F.filter(zipped, lambda z: (z["nl"] == "ID") & (z["nr"] == "ID"))
    names = F.array_distinct(F.transform(same, lambda z: z["l"]))
    first = F.transform(names, lambda n: F.struct(n.alias("key"), F.element_at(F.filter(same, lambda z: z["l"] == n), 1)["r"].alias("value")))
    targets = F.size(F.array_distinct(F.transform(ids, lambda z: F.struct(z["l"], z["r"]))))
    sources = F.size(F.array_distinct(F.transform(ids, lambda z: z["l"])))
    return F.struct(F.map_from_entries(first).alias("renames"), (targets > sources).alias("conflict"))
