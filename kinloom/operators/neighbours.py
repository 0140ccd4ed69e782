"""Standardised feature spaces and exact nearest neighbours over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from kinloom.runtime import ship
from kinloom.store import discard, materialize, release

#: Vectors of a cell, about; rows whose values place the cells' borders, at most; distances held at once.
CELL, SAMPLE, BLOCK = 1024, 100_000, 1 << 20


def standardise(long: DataFrame, item: str = "item_id") -> DataFrame:
    """(item, feature, value) to z-scores of log10(v + 1): population deviation, missing is 0, features without variance are left out.

    Absent values are not materialised for the statistics: they are zeros, so sums over present rows and the number of
    items suffice. The result is sparse too: what a missing value would be is ``missing`` beside each feature.
    ``long`` is read once, into a table that discard() of the result removes.
    """
    logged = materialize(long.groupBy(item, "feature").agg(F.sum("value").alias("value")).select(item, "feature", F.log10(F.col("value") + 1).alias("x")), "logged")
    n = logged.select(F.countDistinct(item).alias("n"))
    stats = logged.groupBy("feature").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q")).join(F.broadcast(n))
    mean = F.col("s") / F.col("n")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean))
    kept = stats.select("feature", mean.alias("mean"), F.when(spread > 1e-9, spread).alias("sd")).where("sd is not null")
    return logged.join(kept, "feature").select(item, "feature", ((F.col("x") - F.col("mean")) / F.col("sd")).alias("z"), (-F.col("mean") / F.col("sd")).alias("missing"))


def vectors(standard: DataFrame, features: list[str], item: str = "item_id") -> DataFrame:
    """Dense arrays in the order of ``features``; absent features take their missing value."""
    gaps = {r["feature"]: r["missing"] for r in standard.select("feature", "missing").distinct().collect()}
    wide = standard.groupBy(item).pivot("feature", features).agg(F.first("z"))
    return wide.select(item, F.array(*[F.coalesce(F.col(f"`{f}`"), F.lit(gaps.get(f, 0.0))) for f in features]).alias("v"))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _borders(rows: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """(dimension, border) of the inner nodes of a k-d tree in heap order: medians along the widest dimension."""
    tree, level = [], [rows]
    for _ in range(depth):
        below = []
        for part in level:
            finite = np.where(np.isfinite(part), part, 0.0)
            at = int(np.argmax(np.ptp(finite, axis=0))) if part.size else 0
            border = float(np.median(finite[:, at])) if part.size else 0.0
            tree.append((at, border))
            right = part[:, at] >= border if part.size else np.zeros(len(part), bool)
            below += [part[~right], part[right]]
        level = below
    return tree


def _cells(v: np.ndarray, tree: list[tuple[int, float]]) -> np.ndarray:
    """The leaf of each vector, by heap order."""
    at, size = np.zeros(len(v), np.int64), len(tree)
    dims, borders = np.array([d for d, _ in tree], np.int64), np.array([x for _, x in tree])
    while size and len(at) and at[0] < size:
        at = 2 * at + 1 + (v[np.arange(len(v)), dims[at]] >= borders[at])
    return at - size


def _matrix(column) -> np.ndarray:
    """Rows of a column of arrays of equal length."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def _closest(asked: np.ndarray, held: np.ndarray, k: int, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of asked, row of held, distance) of the k nearest that lie within reach, in order, ties to the earlier row of held."""
    found, n = [], len(held)
    for s in range(0, len(asked) if n else 0, step := max(1, BLOCK // max(n, 1))):
        part = asked[s : s + step]
        total = np.zeros((len(part), n))
        with np.errstate(invalid="ignore", over="ignore"):
            for f in range(held.shape[1]):
                total += (part[:, f, None] - held[None, :, f]) ** 2
            far = np.sqrt(total)
            scaled = far * 1e9
            far = np.where(scaled < 2.0**52, np.floor(scaled + 0.5) / 1e9, far)
        near = ~(far > reach[s : s + step, None])
        many = np.flatnonzero(near.sum(axis=1) > k)
        if len(many):
            last = np.partition(far[many], k - 1, axis=1)[:, k - 1 : k]
            near[many] &= ~(far[many] > last) | np.isnan(last)
        row, col = np.nonzero(near)
        d = far[row, col]
        order = np.lexsort((col, d, row))
        row, col, d = row[order], col[order], d[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        found.append((row[place < k] + s, col[place < k], d[place < k]))
    return tuple(np.concatenate([np.zeros(0, t), *[x[i] for x in found]]) for i, t in enumerate((np.int64, np.int64, np.float64)))


def _place(tree: list[tuple[int, float]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the cell as last column; the vector is the first one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_cells(_matrix(b.column(0)), tree), pa.int64())], [*b.schema.names, "cell"])

    return run


def _visit(leaves: int, boxes: dict[int, tuple[list[float], list[float]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (v, cell, reach) to (v, cell, reach) of each further cell whose box is within reach, down the tree."""
    dims = len(next(iter(boxes.values()))[0])
    low, high = np.full((2 * leaves - 1, dims), np.nan), np.full((2 * leaves - 1, dims), np.nan)
    empty = np.ones(2 * leaves - 1, bool)
    for cell, (a, b) in boxes.items():
        low[leaves - 1 + cell], high[leaves - 1 + cell], empty[leaves - 1 + cell] = a, b, False
    for i in range(leaves - 2, -1, -1):
        kids = [c for c in (2 * i + 1, 2 * i + 2) if not empty[c]]
        if kids:
            low[i], high[i], empty[i] = np.min(low[kids], axis=0), np.max(high[kids], axis=0), False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, home, reach = _matrix(b.column(0)), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
            waiting = [(0, np.arange(len(v)))]
            while waiting:
                node, rows = waiting.pop()
                if empty[node]:
                    continue
                with np.errstate(invalid="ignore", over="ignore"):
                    gap = np.maximum(np.maximum(low[node] - v[rows], v[rows] - high[node]), 0.0)
                    rows = rows[~(np.sqrt((gap * gap).sum(axis=1)) * (1 - 1e-12) - 1e-9 > reach[rows])]
                if node < leaves - 1:
                    waiting += [(c, rows) for c in (2 * node + 1, 2 * node + 2) if len(rows)]
                    continue
                rows = rows[home[rows] != node - leaves + 1]
                for s in range(0, len(rows), 10_000):
                    some = rows[s : s + 10_000]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some)), pa.array(np.full(len(some), node - leaves + 1), pa.int64()), pa.array(reach[some])], ["v", "cell", "reach"])

    return run


def _search(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """(v, cell, found) for the vectors that ask in a cell and the items in it; found: ids and distances in order, none beyond the vector's reach."""

    def run(asking: pa.Table, items: pa.Table) -> pa.Table:
        items = items.sort_by("id")
        asked, held = _matrix(asking["v"]), _matrix(items["v"])
        row, col, far = _closest(asked, held, k, asking["reach"].to_numpy())
        offsets = pa.array(np.searchsorted(row, np.arange(len(asked) + 1)), pa.int32())
        ids = items["id"].combine_chunks().take(pa.array(col))
        found = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(far), ids], ["distance", "id"]))
        return pa.table([asking["v"], asking["cell"], found], names=["v", "cell", "found"])

    return run


def _everywhere(queries: DataFrame, items: DataFrame, k: int, item: str, vector: str) -> DataFrame:
    """nearest() over all items: by cells of a k-d tree. Equal vectors ask once, and of equal items only those with the k + 1 smallest ids can be near."""
    spark = ship(items.sparkSession)
    kind, array = items.schema[item].dataType, T.ArrayType(T.DoubleType())
    full = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()) & F.col("id").isNotNull()
    whole = lambda df: df.select(F.col(vector).cast(array).alias("v"), F.col(item).alias("id")).where(full)
    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    held = materialize(whole(items).withColumn("_n", first).where(F.col("_n") <= k + 1).drop("_n"), "items")
    total = held.count()
    share = SAMPLE / max(total, 1)
    some = held if share >= 1 else held.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = np.array([r["v"] for r in some.select("v").limit(2 * SAMPLE).collect()], np.float64)
    depth = max(0, -(-total // CELL) - 1).bit_length()
    tree = _borders(rows, depth) if rows.size else []
    placed = lambda df: df.mapInArrow(_place(tree), T.StructType([*df.schema.fields, T.StructField("cell", T.LongType())]))
    dealt, held = held, materialize(placed(held), "cells")
    discard(dealt)
    asked = placed(whole(queries).select("v").distinct()).withColumn("reach", F.lit(float("inf")))
    found = T.ArrayType(T.StructType([T.StructField("distance", T.DoubleType()), T.StructField("id", kind)]))
    schema = T.StructType([T.StructField("v", array), T.StructField("cell", T.LongType()), T.StructField("found", found)])
    search = lambda asking: asking.groupBy("cell").cogroup(held.groupBy("cell")).applyInArrow(_search(k + 1), schema)
    home = materialize(search(asked), "home")
    release(spark)
    width = len(rows[0]) if len(rows) else 0
    bounds = [f(F.col("v")[i]).alias(f"{n}{i}") for i in range(width) for n, f in (("low", F.min), ("high", F.max))]
    boxes = {r["cell"]: ([r[f"low{i}"] for i in range(width)], [r[f"high{i}"] for i in range(width)]) for r in held.groupBy("cell").agg(F.count("*"), *bounds).collect()}
    if len(boxes) > 1 or (boxes and tree):
        last = F.when(F.size("found") > k, F.element_at("found", -1)["distance"])
        reach = F.when(last.isNull() | F.isnan(last), F.lit(float("inf"))).otherwise(last)
        visits = home.select("v", "cell", reach.alias("reach")).mapInArrow(_visit(len(tree) + 1, boxes), T.StructType([*schema.fields[:2], T.StructField("reach", T.DoubleType())]))
        home = home.unionByName(search(visits).where(F.size("found") > 0))
    near = home.groupBy("v").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    out = whole(queries).select("v", F.col("id").alias("query_id")).join(near, "v").select("query_id", F.posexplode(others).alias("at", "x"))
    return out.select("query_id", F.col("x.id").alias("item_id"), F.col("x.distance").alias("distance"), (F.col("at") + 1).alias("place"))


def nearest(queries: DataFrame, items: DataFrame, k: int, item: str = "item_id", vector: str = "v", within: str | None = None) -> DataFrame:
    """(query_id, item_id, distance, place): exact k nearest, the query itself left out, ties by id.

    ``within`` names a column that both must share (an equi-join). Without it items are dealt into cells of a k-d tree, whose borders come from
    a sample; a vector asks its own cell, then every cell whose box is no farther than what that gave. Only neighbours found are rows, never all pairs.
    With many dimensions boxes are near to everything: then vectors times cells are.
    """
    if within is None:
        return _everywhere(queries, items, k, item, vector)
    q = queries.select(F.col(item).alias("query_id"), F.col(vector).alias("_q"), within)
    c = items.select(F.col(item).alias("item_id"), F.col(vector).alias("_c"), within)
    met = c.join(q, within)
    far = F.round(F.sqrt(squared_distance(F.col("_q"), F.col("_c"))), 9)
    scored = met.where("item_id <> query_id").select("query_id", "item_id", far.alias("distance"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "item_id"))
    return scored.withColumn("place", place).where(F.col("place") <= k)


def closeness(found: DataFrame) -> DataFrame:
    """(left_method, right_method, score) from block neighbours (left_method, right_method, distance): 0.65 / (1 + mean) + 0.35 / (1 + least)."""
    return found.groupBy("left_method", "right_method").agg((0.65 / (1 + F.avg("distance")) + 0.35 / (1 + F.min("distance"))).alias("score"), F.count("*").alias("blocks"))


def weighted_l1(a: dict[str, Column], b: dict[str, Column], weights: dict[str, float]) -> Column:
    """Sum of weighted differences over the sum of weighted maxima; 0 where both are 0."""
    add = lambda xs: reduce(lambda x, y: x + y, xs)
    top = add([F.abs(a[f] - b[f]) * w for f, w in weights.items()])
    base = add([F.greatest(a[f], b[f]) * w for f, w in weights.items()])
    return F.when(base == 0, F.lit(0.0)).otherwise(top / base)


# Weights of the block features in the weighted distance.
BLOCK_WEIGHTS = {"arithmetic": 56.658, "calls": 87.423, "instructions": 40.423, "logic": 76.694, "transfers": 6.841, "strings": 11.998, "numbers": 15.382}


def mean_relative_difference(names: list[str], left: str = "l_", right: str = "r_") -> Column:
    """Mean over features of the difference over the larger value (0 where both are 0)."""
    each = [F.when(F.greatest(F.abs(F.col(left + n)), F.abs(F.col(right + n))) == 0, F.lit(0.0)).otherwise(F.abs(F.col(left + n) - F.col(right + n)) / F.greatest(F.abs(F.col(left + n)), F.abs(F.col(right + n)))) for n in names]
    return reduce(lambda a, b: a + b, each) / len(each)
