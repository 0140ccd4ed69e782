"""k-gram fingerprints, winnowing and set-similarity joins over fingerprints."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from kinloom.functions.hashing import md5_60
from kinloom.store import discard, materialize

#: Rows of shared fingerprints that a tile of containment_pairs() holds on its indexed side, about; cells it counts in at once.
TILE, CELLS = 2_000_000, 1 << 22


def explode_tokens(docs: DataFrame, tokens: Column, key: str = "doc_id") -> DataFrame:
    """(key, pos, tok), a row a token."""
    return docs.select(key, F.posexplode(tokens).alias("pos", "tok"))


def kgrams(tokens: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """(key, pos, hash) of each k consecutive tokens. One sort by key and position; winnow() reuses it."""
    order = Window.partitionBy(key).orderBy("pos")
    gram = F.concat_ws(" ", "tok", *[F.lead("tok", i).over(order) for i in range(1, k)])
    whole = F.lead("tok", k - 1).over(order).isNotNull() if k > 1 else F.lit(True)
    return tokens.select(key, "pos", F.when(whole, md5_60(gram)).alias("hash")).where("hash is not null")


def winnow(grams: DataFrame, w: int, key: str = "doc_id") -> DataFrame:
    """(key, hash, pos): the rightmost minimum of every window of w grams, once each; all grams form one window if there are fewer."""
    frame = Window.partitionBy(key).orderBy("pos")
    low = F.min(F.struct("hash", (-F.col("pos")).alias("neg"))).over(frame.rowsBetween(0, w - 1))
    full = F.lead("pos", w - 1).over(frame).isNotNull() if w > 1 else F.lit(True)
    first = F.row_number().over(frame) == 1
    picked = grams.select(key, F.when(full | first, low).alias("m")).where("m is not null")
    return picked.select(key, F.col("m.hash").alias("hash"), (-F.col("m.neg")).alias("pos")).distinct()


def fingerprint_pairs(prints: DataFrame, key: str = "doc_id", most: int | None = None, least: float = 0.0) -> DataFrame:
    """(left_id, right_id, inter, n_left, n_right, jaccard, cont_left, cont_right) of documents that share a fingerprint.

    An equi-join on the hash; counts aggregate before the second shuffle. ``most`` leaves out hashes in more
    documents (their pairs alone would be quadratic); ``least`` is a Jaccard threshold whose length filter
    is part of the join.
    """
    # Distinct and counted by document: winnowing has dealt the rows by document already, so neither moves them again.
    sets = prints.select(key, "hash").distinct()
    sets = sets.select(key, "hash", F.count("*").over(Window.partitionBy(key)).alias("n"))
    if most is not None:
        rare = sets.groupBy("hash").agg(F.count("*").alias("df")).where(F.col("df").between(2, most)).select("hash")
        sets = sets.join(rare, "hash")
    a, b = (sets.select("hash", F.col(key).alias(f"{s}_id"), F.col("n").alias(f"n_{s}")) for s in ("left", "right"))
    fits = (F.col("left_id") < F.col("right_id")) & (F.least("n_left", "n_right") >= F.greatest("n_left", "n_right") * least)
    shared = a.join(b, "hash").where(fits).groupBy("left_id", "right_id", "n_left", "n_right").agg(F.count("*").alias("inter"))
    return shared.select(
        "left_id", "right_id", "inter", "n_left", "n_right", jaccard(F.col("inter"), F.col("n_left"), F.col("n_right")).alias("jaccard"),
        (F.col("inter") / F.col("n_left")).alias("cont_left"), (F.col("inter") / F.col("n_right")).alias("cont_right"),
    ).where(F.col("jaccard") >= least)


def selected(text: str | None, k: int, w: int) -> np.ndarray:
    """The distinct hashes that winnow(kgrams()) selects from the words (runs of other characters than the space) of one text."""
    words = [x for x in (text or "").encode().split(b" ") if x]
    if len(words) < k:
        return np.zeros(0, np.int64)
    whole, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digests = b"".join([md5(whole[a:b], usedforsecurity=False).digest() for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)])
    grams = (np.frombuffer(digests, ">u8")[::2] >> np.uint64(4)).astype(np.int64)
    return np.unique(np.lib.stride_tricks.sliding_window_view(grams, min(w, len(grams))).min(axis=1))


def fingerprint_sets(docs: DataFrame, k: int, w: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, hashes): winnowed fingerprints of each text as a set. A text is one row, so no word or gram is shuffled. Rows that repeat a key are one set; rows without a key go."""
    kind = to_arrow_type(docs.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                sets = [selected(x.as_py(), k, w) for x in part.column(1)]
                offsets = np.cumsum([0, *map(len, sets)])
                yield pa.RecordBatch.from_arrays([part.column(0).cast(kind), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))], ["key", "hashes"])

    shown = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    sets = shown.select("key", "text").mapInArrow(run, T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("hashes", T.ArrayType(T.LongType()))]))
    if not shown.groupBy("key").count().where("count > 1").isEmpty():
        sets = sets.select("key", F.explode("hashes").alias("hash")).groupBy("key").agg(F.collect_set("hash").alias("hashes"))
    return sets.select(F.col("key").alias(key), "hashes")


def _tile(least: float, kind: pa.DataType) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy()
        mark, key, size = (table[c].to_numpy() for c in ("hash", "key", "n"))
        a_key, a_first, a_at = np.unique(key[asks], return_index=True, return_inverse=True)
        b_key, b_first, b_at = np.unique(key[~asks], return_index=True, return_inverse=True)
        a_n, b_n, width = size[asks][a_first], size[~asks][b_first], len(b_key)
        by_hash, by_key = np.argsort(mark[~asks], kind="stable"), np.argsort(a_at, kind="stable")
        posts, owner = mark[~asks][by_hash], b_at[by_hash]
        rows, of = mark[asks][by_key], a_at[by_key]
        low = np.searchsorted(posts, rows)
        many = np.searchsorted(posts, rows, side="right") - low
        upto = np.concatenate([[0], np.cumsum(many)])
        found = []
        step = max(1, CELLS // max(width, 1))
        for s in range(0, len(a_key), step):
            cells = np.zeros(min(step, len(a_key) - s) * width, np.int64)
            i, end = np.searchsorted(of, [s, s + step])
            while i < end:
                j = min(end, max(i + 1, int(np.searchsorted(upto, upto[i] + CELLS, side="right")) - 1))
                at = np.arange(upto[i], upto[j]) + np.repeat(low[i:j] - upto[i:j], many[i:j])
                cells += np.bincount(np.repeat((of[i:j] - s) * width, many[i:j]) + owner[at], minlength=len(cells))
                i = j
            hit = np.flatnonzero(cells)
            x, y, inter = s + hit // max(width, 1), hit % max(width, 1), cells[hit]
            fits = ((a_n[x] < b_n[y]) | (a_n[x] == b_n[y]) & (a_key[x] < b_key[y])) & (inter / a_n[x] >= least)
            found.append((x[fits], y[fits], inter[fits]))
        x, y, inter = (np.concatenate([np.zeros(0, np.int64), *[f[i] for f in found]]) for i in range(3))
        ordered = (a_key[x] < b_key[y]).astype(bool)
        ends = [np.where(ordered, a, b) for a, b in ((a_key[x], b_key[y]), (b_key[y], a_key[x]), (a_n[x], b_n[y]), (b_n[y], a_n[x]))]
        return pa.table([pa.array(ends[0], kind), pa.array(ends[1], kind), *[pa.array(v, pa.int64()) for v in (ends[2], ends[3], inter)]], names=["left_id", "right_id", "n_left", "n_right", "inter"])

    return run


def containment_pairs(sets: DataFrame, least: float, key: str = "doc_id") -> DataFrame:
    """(left_id, right_id, inter, cont_left, cont_right) of all pairs in which one set (key, hashes) holds the share ``least`` (above 0) of the other, or more.

    That share is highest for the smaller set, so only sets whose hashes that any other set has make up ``least`` of them ask; most don't.
    Askers and the sets they may be part of are dealt into tiles; a tile gets the hashes that both its sides have, counts whole
    intersections in memory and returns only pairs that reach ``least``. Pairs below it are never rows, and no pair is shuffled.
    """
    kind = sets.schema[key].dataType
    spread = sets.select(F.col(key).alias("key"), F.size("hashes").alias("n"), F.explode("hashes").alias("hash"))
    shared = spread.withColumn("df", F.count("*").over(Window.partitionBy("hash"))).where("df > 1").drop("df")
    shared = materialize(shared, "shared")
    asking = shared.groupBy("key", "n").agg(F.count("*").alias("m")).where(F.col("m") / F.col("n") >= least).select("key", F.lit(True).alias("asks"))
    marked = materialize(shared.join(asking, "key", "left").withColumn("asks", F.coalesce("asks", F.lit(False))), "marked")
    discard(shared)
    across = max(1, -(-marked.count() // TILE))
    down = max(4, -(-int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")) // across))
    sides = marked.withColumn("i", F.pmod(F.xxhash64("key", F.lit("i")), F.lit(down)).cast("int")).withColumn("j", F.pmod(F.xxhash64("key", F.lit("j")), F.lit(across)).cast("int"))
    ask = sides.where("asks").drop("j").join(sides.select("hash", "j").distinct(), "hash")
    hold = sides.drop("i").withColumn("asks", F.lit(False)).join(sides.where("asks").select("hash", "i").distinct(), "hash")
    columns = ["i", "j", "asks", "hash", "key", "n"]
    ends = [T.StructField(c, kind) for c in ("left_id", "right_id")] + [T.StructField(c, T.LongType()) for c in ("n_left", "n_right", "inter")]
    pairs = ask.select(*columns).unionByName(hold.select(*columns)).groupBy("i", "j").applyInArrow(_tile(least, to_arrow_type(kind)), T.StructType(ends))
    return pairs.select("left_id", "right_id", "inter", (F.col("inter") / F.col("n_left")).alias("cont_left"), (F.col("inter") / F.col("n_right")).alias("cont_right"))


def jaccard(inter: Column, left: Column, right: Column, empty: float = 1.0) -> Column:
    """Jaccard similarity from counts; two empty sets are ``empty``."""
    union = left + right - inter
    return F.when(union == 0, F.lit(empty)).otherwise(inter / union)


def set_jaccard(a: Column, b: Column, empty: float = 1.0) -> Column:
    """Jaccard similarity of two arrays as sets."""
    return jaccard(F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)), F.size(F.array_distinct(b)), empty)


def containment(inter: Column, own: Column) -> Column:
    """The share of own elements that are shared; 0 for an empty set."""
    return F.when(own == 0, F.lit(0.0)).otherwise(inter / own)
