"""Exact top-k inner products by a score-at-a-time index ordered by impact.

Vectors are integers after quantisation. A block of candidates is indexed by postings (dimension,
candidate, value), kept in segments of one impact (the bit length of the value's size) and dimension.
Segments are processed by descending impact for a block of queries at once, adding to accumulators (candidate by
query); after each impact, Cauchy-Schwarz over the postings left bounds every score from both sides. Processing stops
only when all but few candidates are proved to be out of every query's top k, or when nothing is left;
possible members are then rescored in integers.

Candidate blocks are dealt over salts and move once; query blocks, the small side, are copied to each salt, whose number is that of
shuffle partitions. Each meeting yields k rows a query, and a last ranking merges them. Any number of equal vectors or scores is handled: ties go
to the smaller id.

Defined results: null vectors and those with null or non-finite components take no part;
vectors of another length than the query's are no candidates of it; rows with the query's
id are its own; repeated query rows count once; an empty table gives an empty result. Components beyond 64 bits
after quantisation, and a score among the results beyond 64 bits, are errors (ArithmeticException, OverflowError); all else is exact, with Python's
integers where products could pass 62 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom.llm._store import materialize
from kinloom.runtime import ship

K, SCALE, EVERY = 5, 256, 50
QUERY_BLOCK, CANDIDATE_BLOCK = 512, 4096
#: Possible members that are rescored without looking at further segments, as a share of the block.
FEW = 0.02

_PACKED = T.StructType([T.StructField(n, t) for n, t in (("dims", T.IntegerType()), ("salt", T.IntegerType()), ("ids", T.BinaryType()), ("matrix", T.BinaryType()))])
_TOP = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])


def quantise(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null where a component is null or not finite, or the vector is null. An error where 64 bits don't hold it."""
    whole = lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))
    limit = F.lit(2.0**63)
    inside = lambda x: (F.lit(float(scale)) * x.cast("double") >= -limit) & (F.lit(float(scale)) * x.cast("double") < limit)
    wrong = F.raise_error(F.lit("a quantised component is beyond 64 bits")).cast("long")
    ints = F.transform(vector, lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))), F.lit(None).cast("long")).when(inside(x), whole(x).cast("long")).otherwise(wrong))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return F.when(~F.coalesce(bad, F.lit(True)), ints)


def _packer(block: int, salts: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}

        def row(dims: int, rows: list) -> pa.RecordBatch:
            nonlocal made
            salt = (part * 7919 + made) % salts
            made += 1
            ids = np.concatenate([a for a, _ in rows])
            matrix = np.concatenate([b for _, b in rows])
            return pa.RecordBatch.from_pydict({"dims": pa.array([dims], pa.int32()), "salt": pa.array([salt], pa.int32()), "ids": [ids.tobytes()], "matrix": [matrix.tobytes()]}, pa.schema([("dims", pa.int32()), ("salt", pa.int32()), ("ids", pa.binary()), ("matrix", pa.binary())]))

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.concatenate(([0], np.cumsum(sizes)))
            for dims in np.unique(sizes):
                at = np.flatnonzero(sizes == dims)
                for i in range(0, len(at), block):
                    some = at[i : i + block]
                    held.setdefault(int(dims), []).append((ids[some], values[starts[some][:, None] + np.arange(dims)].reshape(len(some), int(dims))))
                    if sum(len(a) for a, _ in held[int(dims)]) >= block:
                        yield row(int(dims), held.pop(int(dims)))
        for dims, rows in held.items():
            yield row(dims, rows)

    return pack


class Postings:
    """The index of a block of candidates: by falling impact, segments (dimension, candidates, values), and what is left after each impact."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        self.ids, self.matrix = ids, matrix
        size = np.abs(matrix).view(np.uint64)  # right for the smallest integer too
        self.largest = int(size.max(initial=0))
        at = np.flatnonzero(size)
        impact = np.frexp(size.ravel()[at].astype(np.float64))[1]
        dims = max(1, matrix.shape[1])
        owner, dim = at // dims, at % dims
        order = np.lexsort((owner, dim, -impact))
        self.owner, dim, impact = owner[order], dim[order], impact[order]
        self.value = matrix[self.owner, dim]
        cuts = np.flatnonzero(np.concatenate(([True], (dim[1:] != dim[:-1]) | (impact[1:] != impact[:-1])))) if len(dim) else np.zeros(0, np.int64)
        ends = np.append(cuts[1:], len(dim))
        self.levels: list[tuple[list[tuple[int, int, int]], np.ndarray]] = []
        left = (matrix.astype(np.float64) ** 2).sum(1)
        for level in sorted(set(impact.tolist()), reverse=True):
            segments = [(int(dim[i]), int(i), int(j)) for i, j in zip(cuts, ends, strict=True) if impact[i] == level]
            i, j = segments[0][1], segments[-1][2]
            left = left - np.bincount(self.owner[i:j], self.value[i:j].astype(np.float64) ** 2, len(ids))
            last = j == len(dim)
            # Rounding in the sums of squares is far below a millionth of the whole.
            rest = np.zeros(len(ids)) if last else np.sqrt(np.maximum(left, 0.0) + 1e-9 * (matrix.astype(np.float64) ** 2).sum(1))
            self.levels.append((segments, rest))


def _products(q: np.ndarray, c: np.ndarray, safe: bool) -> np.ndarray:
    """Exact inner products, row by row."""
    if safe:
        return np.einsum("ij,ij->i", q, c)
    return np.array([sum(x * y for x, y in zip(a, b, strict=True)) for a, b in zip(q.tolist(), c.tolist(), strict=True)], object)


def search_block(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray | Postings, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score): each query's top k of the block, exactly."""
    index = c if isinstance(c, Postings) else Postings(cid, np.ascontiguousarray(c))
    c, n = index.matrix, len(index.ids)
    bound = float(np.abs(q).view(np.uint64).max(initial=0)) * float(index.largest) * max(1, q.shape[1])
    real = np.float32 if bound < 2**23 else np.float64
    slack = 0.0 if bound < 2**50 else bound * 2.0**-40
    columns = np.ascontiguousarray(q.T.astype(real))
    value = index.value.astype(real)
    own = index.ids[:, None] == qid[None, :]
    norm = np.sqrt((q.astype(np.float64) ** 2).sum(1))
    score = np.zeros((n, len(q)), real)
    few = max(4 * k * len(q), int(FEW * score.size))
    alive = ~own
    for segments, rest in index.levels:
        for dim, i, j in segments:
            score[index.owner[i:j]] += value[i:j, None] * columns[dim]
        slip = (norm[None, :] * rest[:, None] * 1.000001 + slack + (rest.max(initial=0) > 0)).astype(real)
        if n > k:
            least = np.partition(np.where(own, -np.inf, score - slip), n - k, axis=0)[n - k]
            alive = ~own & (score + slip >= least)
        if alive.sum() <= few:
            break
    qi, ci = np.nonzero(alive.T)
    safe = bound < 2**62
    exact = np.empty(len(qi), np.int64 if safe else object)
    for i in range(0, len(qi), 1 << 17):
        a, b = qi[i : i + (1 << 17)], ci[i : i + (1 << 17)]
        exact[i : i + (1 << 17)] = _products(q[a], c[b], safe)
    order = np.lexsort((index.ids[ci], -exact, qi)) if safe else np.array(sorted(range(len(qi)), key=lambda i: (qi[i], -exact[i], index.ids[ci[i]])), np.int64)
    qi, ci, exact = qi[order], ci[order], exact[order]
    keep = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
    if not safe and any(abs(x) >= 2**63 for x in exact[keep]):
        raise OverflowError("a score is beyond 64 bits")
    return qi[keep], ci[keep], exact[keep].astype(np.int64)


def _searcher(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(batch, r: int, ids: str, matrix: str) -> tuple[np.ndarray, np.ndarray]:
            names = np.frombuffer(batch.column(ids)[r].as_py(), np.int64)
            return names, np.frombuffer(batch.column(matrix)[r].as_py(), np.int64).reshape(len(names), batch.column("dims")[r].as_py())

        held, index = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                qid, q = block(batch, r, "q_ids", "q_matrix")
                cid, c = block(batch, r, "ids", "matrix")
                if held is None or not (np.array_equal(held[0], cid) and np.array_equal(held[1], c)):  # a block meets all query blocks in a row
                    held, index = (cid, c), Postings(cid, c)
                for i in range(0, len(qid), QUERY_BLOCK):
                    qi, ci, score = search_block(qid[i : i + QUERY_BLOCK], q[i : i + QUERY_BLOCK], cid, index, k)
                    yield pa.RecordBatch.from_arrays([pa.array(qid[i : i + QUERY_BLOCK][qi]), pa.array(cid[ci]), pa.array(score)], ["query_id", "vec_id", "score"])

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, vec_id: str = "vec_id", vector: str = "vector") -> DataFrame:
    """query_id, rank, vec_id, score. Both inputs: id and array<bigint> without nulls."""
    base = lambda df: df.select(F.col(vec_id).cast("long").alias("i"), F.col(vector).alias("v")).where("i is not null and v is not null")
    salts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = base(vectors).mapInArrow(_packer(CANDIDATE_BLOCK, salts), _PACKED)
    asked = materialize(base(queries).distinct().mapInArrow(_packer(QUERY_BLOCK, 1), _PACKED), "queries")
    right = asked.select("dims", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    # A merge join on purpose: packed blocks look small to the planner, and a broadcast of them would grow with the queries.
    met = left.join(right.hint("merge"), ["salt", "dims"]).select("dims", "q_ids", "q_matrix", "ids", "matrix")
    found = met.mapInArrow(_searcher(k), _TOP)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ship(spark).read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = rows.select("vec_id", quantise(F.col("embedding")).alias("vector")).where("vector is not null")
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * x::DOUBLE) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, q FROM v WHERE vec_id % {EVERY} = 0) a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM p
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {K}
"""
