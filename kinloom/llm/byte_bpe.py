"""Byte-level BPE with a hierarchical-bitmap rank queue, and its decoding.

Within a pre-token, symbols form a linked list over byte positions. Each pair that has
a rank waits in the bucket of that rank; a three-level bitmap over ranks marks
buckets in use, so find-first-set yields the lowest rank in three steps whatever the
length; within a bucket the leftmost position goes first. A pair that a merge has changed
stays behind and is skipped as stale when it comes up. Work is near linear in the
length, so pre-tokens of megabytes are no special case.

Pre-tokens repeat, so a worker keeps two generations of a bounded cache.

Defined results: null and empty texts have no tokens; any bytes decode; an id out of the
vocabulary raises. Work is by row; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from heapq import heappop, heappush
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom.llm import _words
from kinloom.runtime import ship

#: Pre-tokens in a cache generation (a text may exceed it by its own ones); two generations at most, some 250 bytes an entry.
CACHE = 450_000


class Codec:
    """Encodes and decodes with the ranks of a vocabulary file (base64 token and rank a line)."""

    def __init__(self, vocabulary: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.names = {v: str(v) for v in self.tokens}
        self.longest = max(map(len, self.ranks))
        # The pattern's \s is White_Space; this engine's own \s has four control characters more.
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        # The rank queue: buckets of positions by rank, under a bitmap of three levels of 64-bit words (the top one is local to merge).
        words = (max(self.tokens) >> 6) + 1
        self.low, self.mid = [0] * words, [0] * ((words >> 6) + 1)
        self.buckets: dict[int, list[int]] = {}
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token. The queue's steps are written out: a call would cost as much as a step."""
        rank_of, longest, n = self.ranks.get, self.longest, len(piece)
        whole = rank_of(piece) if n <= longest else None
        if whole is not None:
            return [whole]
        low, mid, top, buckets = self.low, self.mid, 0, self.buckets  # all empty between calls
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [-1] * n  # the rank under which the pair that starts here waits now
        for i in range(n - 1):
            rank = rank_of(piece[i : i + 2])
            if rank is not None:
                waiting[i] = rank
                if rank in buckets:
                    buckets[rank].append(i)  # positions rise here
                else:
                    buckets[rank] = [i]
                    word = rank >> 6
                    low[word] |= 1 << (rank & 63)
                    mid[word >> 6] |= 1 << (word & 63)
                    top |= 1 << (word >> 6)
        while top:
            # find first set, three times
            over = (top & -top).bit_length() - 1
            bits = mid[over]
            word = (over << 6) + (bits & -bits).bit_length() - 1
            bits = low[word]
            rank = (word << 6) + (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                bits &= bits - 1
                low[word] = bits
                if not bits:
                    mid[over] &= mid[over] - 1
                    if not mid[over]:
                        top &= top - 1
            if waiting[i] != rank:
                continue  # stale
            second = after[i]
            end = after[second]
            waiting[second] = waiting[i] = -1
            after[i] = end
            left = before[i]
            changed = []
            if end < n:
                before[end] = i
                if after[end] - i <= longest:
                    changed.append((i, rank_of(piece[i : after[end]])))
            if left >= 0:
                waiting[left] = -1
                if end - left <= longest:
                    changed.append((left, rank_of(piece[left:end])))
            for at, rank in changed:
                if rank is not None:
                    waiting[at] = rank
                    if rank in buckets:
                        heappush(buckets[rank], at)
                    else:
                        buckets[rank] = [at]
                        word = rank >> 6
                        low[word] |= 1 << (rank & 63)
                        mid[word >> 6] |= 1 << (word & 63)
                        top |= 1 << (word >> 6)
        out, i, ranks = [], 0, self.ranks
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def _miss(self, piece: str) -> tuple[int, ...]:
        ids = self.old.get(piece)
        if ids is None:
            ids = tuple(self.merge(piece.encode()))
        if len(piece) <= 64:
            self.young[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if len(self.young) >= CACHE:
            self.old, self.young = self.young, {}
        out: list[int] = []
        known, miss = self.young.get, self._miss
        for piece in self.split(text):
            out += known(piece) or miss(piece)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@_words.kept
@lru_cache(maxsize=2)
def _codec(vocabulary: bytes, pattern: str) -> Codec:
    return Codec(vocabulary, pattern)


def load_vocabulary(path: str) -> bytes:
    """Read on the driver; the bytes travel with the function (about 1 MB for 50,000 ranks)."""
    return Path(path).read_bytes()


def encode_column(text: Column, vocabulary: bytes, pattern: str) -> Column:
    """array<int> of ids."""

    def encode(texts: pa.Array) -> pa.Array:
        codec = _codec(vocabulary, pattern)
        return pa.array([codec.encode(x.as_py() or "") for x in texts], pa.list_(pa.int32()))

    return F.arrow_udf(encode, T.ArrayType(T.IntegerType()))(text)


def decode_column(ids: Column, vocabulary: bytes, pattern: str) -> Column:
    """Bytes of an array of ids; null is no ids."""

    def decode(lists: pa.Array) -> pa.Array:
        codec = _codec(vocabulary, pattern)
        return pa.array([codec.decode(x.as_py() or []) for x in lists], pa.binary())

    return F.arrow_udf(decode, T.BinaryType())(ids)


_DIGESTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def digest_column(text: Column, vocabulary: bytes, pattern: str) -> Column:
    """Both directions at once without moving the ids: struct(n_tokens, ids_sha256, decoded_sha256)."""

    def digest(texts: pa.Array) -> pa.Array:
        codec = _codec(vocabulary, pattern)
        counts, of_ids, of_bytes = [], [], []
        for x in texts:
            ids = codec.encode(x.as_py() or "")
            counts.append(len(ids))
            of_ids.append(hashlib.sha256(" ".join(map(codec.names.__getitem__, ids)).encode()).hexdigest())
            of_bytes.append(hashlib.sha256(codec.decode(ids)).hexdigest())
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return F.arrow_udf(digest, _DIGESTS)(text)


def tokenize(docs: DataFrame, vocabulary: bytes, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    out = docs.select(F.col(doc_id).alias("doc_id"), digest_column(F.col(text), vocabulary, pattern).alias("_t"))
    return out.select("doc_id", "_t.n_tokens", "_t.ids_sha256", "_t.decoded_sha256")


def op7_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    return tokenize(docs, load_vocabulary(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
