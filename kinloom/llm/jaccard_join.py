"""Near duplicates by word-shingle Jaccard similarity: an exact universe-partition join.

A document's set holds the hashes of its distinct n-word shingles. Sets fall into size bands
[L, U] with U = floor(L / t), so links stay within a band or between neighbours; scheme j
serves bands j - 1 and j. It hashes the universe into m segments. Two linked sets differ in at
most H = floor((a + b)(1 - t) / (1 + t)) elements, so of any H + 1 segments one is equal in both
(pigeonhole). A set allocates to its segments:

* skip, to empty segments and (by leaving them out of the universe) very frequent shingles;
* exact match, to all other segments: one signature each. m exceeds H + 1, so most sets
  have H + 1 of them and need no more;
* one deletion, where a set has too few: its segments' one-deletion neighbourhoods are
  indexed too, and a segment of two elements or more then counts twice;
* where even that is too little (small sets of frequent shingles), the prefix of the set in order
  of frequency, which any linked set must meet.

Any pair of linked sets thus shares a signature. Equal sets are one class from the start; classes go by a 64-bit name, and
a second 64-bit hash tells two sets of one name apart (names are then drawn anew).
Signatures are dealt into buckets in packed form, one copy of a class for each batch. In a
bucket, each class is linked with its signature group's smallest one; the likeliest such pairs
are verified exactly on the sets, and components are formed. Then every group that still spans components
is looked at again, once however many signatures made it: all its pairs of two components are tested on 16-bit
shortenings of the sets, which never understate an intersection, and a spanning tree of those that
pass is verified exactly. Where a link of a tree fails, all passing pairs of that place are verified.
So each pair is in one component or has been tested, no link is lost, and listed pairs grow with members, not with their squares.
Places with more than TILE members are cut into parts, and tasks get pairs of parts.

Defined results: null, empty and wordless texts have no shingles and link with nothing (their component is
their own id); with fewer than n words the whole sequence is the one shingle; repeated rows are
copies of a class; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom.llm import _words
from kinloom.llm._graph import connected_components
from kinloom.llm._store import discard, materialize
from kinloom.runtime import ship

WORDS, PERCENT = 5, 75
#: Shingles seen in so many documents are left out of segments: the most frequent MAX_FREQUENT (8 MB) at most. Any choice is right, this one is cheap.
FREQUENT, MAX_FREQUENT = 24, 1_000_000
#: Segments for each one that the pigeonhole needs.
SPARE = 1.15
#: Signatures in a bucket, about.
BUCKET = 2_000_000
#: Pivots of a class that the first verification tries.
FIRST = 2
#: Members and shingles of a part of a large place; a task holds two parts.
TILE, TILE_SHINGLES = 4096, 2_000_000
#: Larger groups are tested by products of incidence matrices, smaller ones pair by pair.
SMALL, BLOCK = 12, 256
#: Bits of a class's first name, and of a shortening.
NAME_BITS, SHORT_BITS = 64, 16
#: Shingles of sets that leave a worker at once.
HELD = 1 << 18
#: Ids of documents to verify that are broadcast; more are joined by shuffling.
BROADCAST_IDS = 500_000

_U = np.uint64
_SEGMENT, _DELETION, _PREFIX = _U(0xA24BAED4963EE407), _U(0x9FB21C651E98DF25), _U(0xC3A5C85C97CB3127)


def shingle_sets(texts: pa.Array, n: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    data, offsets = _words.buffers(texts)
    for i, j in _words.slices(offsets):
        base = offsets[i]
        h, _, first = _words.words(data[base : offsets[j]], offsets[i : j + 1] - base, lower=True)
        grams = _words.windows(h, n)
        for k in range(j - i):
            a, b = int(first[k]), int(first[k + 1])
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                yield _words.windows(h[a:b], b - a)
            else:
                yield np.zeros(0, np.uint64)


def set_key(s: np.ndarray, naming: tuple[int, int] = (0, 64)) -> int:
    """A signed 64-bit name of a set; naming: a seed, and how many bits are used."""
    if not len(s):
        return 0
    both = np.array([np.add.reduce(_words.mix(s ^ (_PREFIX + _U(naming[0])))), _U(len(s))], np.uint64)
    return int((_words.windows(both, 2) >> _U(64 - naming[1])).view(np.int64)[0])


def set_check(s: np.ndarray) -> int:
    """Another one, independent of the name."""
    return int(np.bitwise_xor.reduce(_words.mix(s * _SEGMENT + _DELETION)).view(np.int64)) if len(s) else 0


def need(n: int, top: int, percent: int) -> int:
    """Segments that a set of n must have matched or skipped against sets of up to top elements."""
    most = min(top, n * 100 // percent)
    return (n + most) * (100 - percent) // (100 + percent) + 1


@dataclass(frozen=True)
class Bands:
    """Size bands of a threshold: tops[k] is the largest size of band k."""

    percent: int = PERCENT

    def of(self, n: int) -> tuple[int, int, int]:
        """(band, its largest size, the next band's largest size) of a size."""
        k, low = 0, 1
        while True:
            top = low * 100 // self.percent
            if n <= top:
                return k, top, (top + 1) * 100 // self.percent
            k, low = k + 1, top + 1


def signatures(s: np.ndarray, percent: int, frequent: np.ndarray, counts: np.ndarray, bands: Bands) -> np.ndarray:
    """All signatures of a set: equal for linked sets in one place at least."""
    n = len(s)
    if not n:
        return np.zeros(0, np.uint64)
    k, top, next_top = bands.of(n)
    token = _words.mix(s ^ _SEGMENT)
    own = s
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        often = frequent[at] == s
        rare, weight = token[~often], np.where(often, counts[at], 0)
    else:
        rare, weight = token, np.zeros(n, np.int64)
    out, lacking = [], False
    for scheme, limit in ((k, top), (k + 1, next_top)):
        if scheme > k and n * 100 < percent * (top + 1):
            continue
        segments = int(SPARE * (2 * limit * (100 - percent) // (100 + percent) + 1)) + 2
        seg = ((rare >> _U(32)) * _U(segments)) >> _U(32)
        order = np.argsort(seg, kind="stable")
        seg, tok = seg[order], rare[order]
        starts = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1]))) if len(seg) else np.zeros(0, np.int64)
        total = np.add.reduceat(tok, starts) if len(starts) else np.zeros(0, np.uint64)
        place = (seg[starts] << _U(12)) + _U(scheme)
        out.append(_words.mix(total * _DELETION + place * _PREFIX + _SEGMENT))
        wanted = need(n, limit, percent)
        if len(starts) < wanted:
            sizes = np.diff(np.append(starts, len(seg)))
            out.append(_words.mix(total * _DELETION + place * _PREFIX + _DELETION))
            many = np.repeat(sizes >= 2, sizes)
            less = (np.repeat(total, sizes) - tok)[many]
            out.append(_words.mix(less * _DELETION + np.repeat(place, sizes)[many] * _PREFIX + _DELETION))
            lacking |= len(starts) + int((sizes >= 2).sum()) < wanted
    if lacking:
        head = np.lexsort((own, weight))[: n - -(-n * percent // 100) + 1]
        out.append(_words.mix(own[head] + _PREFIX))
    return np.unique(np.concatenate(out))


_SCAN = T.StructType([T.StructField(x, T.LongType()) for x in ("doc_id", "key", "check", "n", "shingle", "seen")])
_SCAN_PA = pa.schema([(x, pa.int64()) for x in ("doc_id", "key", "check", "n", "shingle", "seen")])


def _scan(words: int, naming: tuple[int, int]):
    @_words.trimmed
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), words))
            keys, checks, sizes = [set_key(s, naming) for s in sets], [set_check(s) for s in sets], [len(s) for s in sets]
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (keys, checks, sizes)), none, none], schema=_SCAN_PA)
            # Shingles that repeat over the batch's distinct sets: those that are frequent in all repeat here.
            first = {k: s for k, s in zip(keys, sets, strict=True)}
            every = np.sort(np.concatenate([*first.values(), np.zeros(0, np.uint64)]))
            runs = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1], [True]))) if len(every) else np.zeros(1, np.int64)
            count = np.diff(runs)
            hot = count >= 2
            if hot.any():
                none = pa.nulls(int(hot.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(every[runs[:-1]][hot].view(np.int64)), pa.array(count[hot].astype(np.int64))], schema=_SCAN_PA)

    return scan


_DEALT = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("names", T.BinaryType()), T.StructField("which", T.BinaryType()), T.StructField("sigs", T.BinaryType())])
_DEALT_PA = pa.schema([("bucket", pa.int32()), ("names", pa.binary()), ("which", pa.binary()), ("sigs", pa.binary())])


def _deal(words: int, percent: int, naming: tuple[int, int], places: list[int], frequent, counts):
    @_words.trimmed
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, often, weight, buckets = Bands(percent), frequent.value, counts.value, len(places)
        for batch in batches:
            names, found, seen = [], [], set()
            for s in shingle_sets(batch.column(0), words):
                name = set_key(s, naming)
                if len(s) and name not in seen:
                    seen.add(name)
                    names.append(name)
                    found.append(signatures(s, percent, often, weight, bands))
            if not names:
                continue
            sig = np.concatenate(found)
            which = np.repeat(np.arange(len(names), dtype=np.uint32), [len(x) for x in found])
            bucket = (sig & _U(0xFFFFFFFF)) % _U(buckets)
            order = np.argsort(bucket, kind="stable")
            bucket, which, short = bucket[order], which[order], (sig >> _U(32)).astype(np.uint32)[order]
            cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
            name = np.array(names, np.int64)
            for b in range(buckets):
                i, j = cuts[b], cuts[b + 1]
                if j > i:
                    used, local = np.unique(which[i:j], return_inverse=True)
                    kind = np.uint16 if len(used) <= 65536 else np.uint32
                    row = [pa.array([places[b]], pa.int32()), pa.array([name[used].tobytes()]), pa.array([local.astype(kind).tobytes()]), pa.array([short[i:j].tobytes()])]
                    yield pa.RecordBatch.from_arrays(row, schema=_DEALT_PA)

    return deal


_MET = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("pivots", T.BinaryType()), T.StructField("members", T.BinaryType()), T.StructField("times", T.BinaryType()), T.StructField("runs", T.BinaryType()), T.StructField("inside", T.BinaryType())])
_MET_PA = pa.schema([("bucket", pa.int32()), *((x, pa.binary()) for x in ("pivots", "members", "times", "runs", "inside"))])


def bucket_groups(sig: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each run, names): distinct groups of two classes or more that share a signature, names in order."""
    order = np.lexsort((name, sig))
    sig, name = sig[order], name[order]
    fresh = np.concatenate(([True], (sig[1:] != sig[:-1]) | (name[1:] != name[:-1]))) if len(sig) else np.zeros(0, bool)
    sig, name = sig[fresh], name[fresh]
    if not len(sig):
        return np.zeros(0, np.int64), name
    starts = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
    sizes = np.diff(np.append(starts, len(sig)))
    keep = np.repeat(sizes > 1, sizes)
    name, sizes = name[keep], sizes[sizes > 1]
    if not len(sizes):
        return np.zeros(0, np.int64), name
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    # Groups of the same classes need to be looked at once.
    content = np.add.reduceat(_words.mix(name.view(np.uint64)), starts) + sizes.astype(np.uint64)
    _, one = np.unique(content, return_index=True)
    one.sort()
    pick = np.zeros(len(sizes), bool)
    pick[one] = True
    return np.concatenate(([0], np.cumsum(sizes[pick])[:-1])), name[np.repeat(pick, sizes)]


@_words.trimmed
def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket to one row a bucket: pivot links, and the groups."""

    def row(bucket: int, sigs: list, names: list) -> pa.RecordBatch | None:
        starts, inside = bucket_groups(np.concatenate(sigs), np.concatenate(names))
        if not len(starts):
            return None
        sizes = np.diff(np.append(starts, len(inside)))
        pivots = np.repeat(inside[starts], sizes)
        other = pivots != inside
        links, times = np.unique(np.stack([inside[other], pivots[other]]), axis=1, return_counts=True)
        best = np.lexsort((links[1], -times, links[0]))  # a member's most frequent pivot in this bucket
        best = best[np.concatenate(([True], links[0][best][1:] != links[0][best][:-1]))] if len(best) else best
        links, times = links[::-1, best], times[best]
        cells = [links[0], links[1], times.astype(np.int64), starts.astype(np.int64), inside]
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *(pa.array([np.ascontiguousarray(x).tobytes()]) for x in cells)], schema=_MET_PA)

    at, sigs, names = None, [], []
    for batch in batches:
        for r in range(batch.num_rows):
            bucket = batch.column(0)[r].as_py()
            if bucket != at:
                if sigs and (out := row(at, sigs, names)) is not None:
                    yield out
                at, sigs, names = bucket, [], []
            name = np.frombuffer(batch.column(1)[r].as_py(), np.int64)
            sig = np.frombuffer(batch.column(3)[r].as_py(), np.uint32)
            which = batch.column(2)[r].as_py()
            names.append(name[np.frombuffer(which, np.uint16 if len(which) == 2 * len(sig) else np.uint32)])
            sigs.append(sig)
    if sigs and (out := row(at, sigs, names)) is not None:
        yield out


_LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("times", T.LongType())])
_MEMBERS = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("run", T.IntegerType()), T.StructField("key", T.LongType())])
_RUNS = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("run", T.IntegerType()), *(T.StructField(x, T.LongType()) for x in ("home", "size", "content", "content2"))])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            cells = [pa.array(np.frombuffer(batch.column(c)[r].as_py(), np.int64)) for c in range(3)]
            yield pa.RecordBatch.from_arrays(cells, ["a", "b", "times"])


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, starts of runs, their sizes, names)."""
    for batch in batches:
        for r in range(batch.num_rows):
            starts, inside = (np.frombuffer(batch.column(c)[r].as_py(), np.int64) for c in (1, 2))
            yield batch.column(0)[r].as_py(), starts, np.diff(np.append(starts, len(inside))), inside


@_words.trimmed
def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a run: its smallest name, size and two hashes of its content."""
    for bucket, starts, sizes, inside in _opened(batches):
        own = inside.view(np.uint64)
        content = [np.add.reduceat(_words.mix(own ^ x), starts).view(np.int64) for x in (_SEGMENT, _DELETION)]
        run = np.arange(len(starts), dtype=np.int32)
        cells = [np.full(len(starts), bucket, np.int32), run, inside[starts], sizes.astype(np.int64), *content]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in cells], _RUNS.names)


@_words.trimmed
def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, starts, sizes, inside in _opened(batches):
        run = np.repeat(np.arange(len(starts), dtype=np.int32), sizes)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(inside), bucket, np.int32)), pa.array(run), pa.array(inside)], ["bucket", "run", "key"])


def numbered(short: np.ndarray) -> np.ndarray:
    """A sorted multiset of shortenings as a sorted set: equal values are told apart by number, so intersections are those of multisets."""
    start = np.flatnonzero(np.concatenate(([True], short[1:] != short[:-1]))) if len(short) else np.zeros(0, np.int64)
    nth = np.arange(len(short)) - np.repeat(start, np.diff(np.append(start, len(short))))
    return (short.astype(_U) << _U(32)) + nth.astype(_U)


def fits(common, total, percent: int):
    """Whether sets of so many elements in all may be linked."""
    return 100 * common >= percent * (total - common)


def likely_blocks(sets: list[np.ndarray], percent: int) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Blocks (rows, columns, whether the pair's shortenings allow a link) of all pairs of numbered sets in order of size, once each."""
    sizes = np.array([len(x) for x in sets], np.int64)
    value, column = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(column, minlength=len(value)) > 1
    column = np.where(often[column], np.cumsum(often)[column] - 1, -1)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    spans = [slice(i, min(i + BLOCK, len(sets))) for i in range(0, len(sets), BLOCK)]
    cells = []
    for x in spans:
        c = column[ends[x.start] : ends[x.stop]]
        owner = np.repeat(np.arange(x.stop - x.start), sizes[x])
        cells.append((owner[c >= 0], c[c >= 0], np.unique(c[c >= 0])))

    def matrix(k: int, shared: np.ndarray) -> np.ndarray:
        owner, c, _ = cells[k]
        at = np.minimum(np.searchsorted(shared, c), max(len(shared) - 1, 0))
        out = np.zeros((spans[k].stop - spans[k].start, len(shared)), np.float32)
        if len(shared):
            own = shared[at] == c
            out[owner[own], at[own]] = 1
        return out

    for i, x in enumerate(spans):
        for j in range(i, len(spans)):
            y = spans[j]
            if sizes[x.stop - 1] * 100 < percent * sizes[y.start]:
                break
            shared = np.intersect1d(cells[i][2], cells[j][2], assume_unique=True)
            common = matrix(i, shared) @ matrix(j, shared).T
            good = fits(common, sizes[x, None] + sizes[None, y], percent)
            yield x, y, np.triu(good, 1) if i == j else good


class Place:
    """The groups of one tile: names with labels, tested once for each pair; a forest joins labels as it goes."""

    def __init__(self, percent: int, forest: bool, cross: bool) -> None:
        self.percent, self.forest, self.cross = percent, forest, cross
        self.known: dict[int, np.ndarray] = {}
        self.up: dict[int, int] = {}
        self.tested: set[tuple[int, int]] = set()
        self.found: list[tuple[int, int]] = []

    def root(self, label: int) -> int:
        up = self.up
        while (above := up.get(label, label)) != label:
            up[label] = up.get(above, above)
            label = above
        return label

    def take(self, a: int, b: int, x: int, y: int) -> None:
        """A pair that may be linked, with its labels."""
        if self.forest:
            x, y = self.root(x), self.root(y)
            if x == y:
                return
            self.up[max(x, y)] = min(x, y)
        self.found.append((min(a, b), max(a, b)))

    def group(self, keys: list[int], labels: list[int], parts: list[int]) -> None:
        if self.forest:
            labels = [self.root(x) for x in labels]
        if len(set(labels)) < 2 or self.cross and len(set(parts)) < 2:
            return
        if len(keys) <= SMALL:
            for i, a in enumerate(keys):
                for j in range(i):
                    b = keys[j]
                    if labels[i] == labels[j] or self.cross and parts[i] == parts[j] or (pair := (min(a, b), max(a, b))) in self.tested:
                        continue
                    self.tested.add(pair)
                    x, y = self.known[a], self.known[b]
                    if fits(min(len(x), len(y)), len(x) + len(y), self.percent):
                        both = np.concatenate((x, y))
                        both.sort()
                        if fits(int(np.count_nonzero(both[1:] == both[:-1])), len(both), self.percent):
                            self.take(a, b, labels[i], labels[j])
            if len(self.tested) > 1 << 18:  # a saving only
                self.tested.clear()
            return
        order = sorted(range(len(keys)), key=lambda i: (len(self.known[keys[i]]), keys[i]))
        key, part = (np.array([x[i] for i in order], np.int64) for x in (keys, parts))
        label = np.array([labels[i] for i in order], np.int64)
        for x, y, good in likely_blocks([self.known[keys[i]] for i in order], self.percent):
            if self.cross:
                good = good & (part[x, None] != part[None, y])
            while True:
                a, b = np.nonzero(good & (label[x, None] != label[None, y]))
                if not len(a):
                    break
                if self.forest:  # one for each row, then what that left apart
                    a, at = np.unique(a, return_index=True)
                    b = b[at]
                for i, j in zip(a + x.start, b + y.start, strict=True):
                    self.take(int(key[i]), int(key[j]), int(label[i]), int(label[j]))
                if not self.forest:
                    break
                names, back = np.unique(label, return_inverse=True)
                label = np.array([self.root(int(n)) for n in names], np.int64)[back]


def _spanning(percent: int, forest: bool):
    """Rows (home, i, j, bucket, run, key, label, part, short) in order, a tile's shortenings (bucket null) first, to (home, a, b): pairs of two labels that may be linked, a spanning forest of them or all."""

    @_words.trimmed
    def spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(home: int, place: Place) -> Iterator[pa.RecordBatch]:
            if place.found:
                both = np.unique(np.array(place.found, np.int64), axis=0)
                place.found = []
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(both), home)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], _PAIRS.names)

        place = group = tile = None
        keys, labels, parts = [], [], []
        for batch in batches:
            for home, i, j, b, r, key, label, part, short in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (home, i, j) != tile or (b, r) != group:
                    if keys:
                        place.group(keys, labels, parts)
                        keys, labels, parts = [], [], []
                    if place and ((home, i, j) != tile or len(place.found) > 1 << 18):
                        yield from rows(tile[0], place)
                    if (home, i, j) != tile:
                        tile, place = (home, i, j), Place(percent, forest, i != j)
                    group = (b, r)
                if b is None:
                    place.known[key] = numbered(np.frombuffer(short, np.uint16))
                else:
                    keys.append(key)
                    labels.append(label)
                    parts.append(part)
        if keys:
            place.group(keys, labels, parts)
        if place:
            yield from rows(tile[0], place)

    return spanning


_PAIRS = T.StructType([T.StructField("home", T.LongType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
_SETS = T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("shingles", T.BinaryType()), T.StructField("short", T.BinaryType())])


def _sets(words: int, bits: int):
    @_words.trimmed
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(keys: pa.Array, found: list[np.ndarray]) -> pa.RecordBatch:
            short = [np.sort((s >> _U(64 - bits)).astype(np.uint16)).tobytes() for s in found]
            return pa.RecordBatch.from_arrays([keys, pa.array([len(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary()), pa.array(short, pa.binary())], _SETS.names)

        for batch in batches:
            found, held, start = [], 0, 0
            for s in shingle_sets(batch.column(1), words):
                found.append(s)
                held += len(s)
                if held >= HELD:
                    yield rows(batch.column(0).slice(start, len(found)), found)
                    found, held, start = [], 0, start + len(found)
            yield rows(batch.column(0).slice(start), found)

    return sets


def _verify(percent: int, whole: bool):
    """Pairs (home, a, b, set of a, set of b) that are linked, or for shortenings may be."""

    @_words.trimmed
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for r in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(c)[r].as_py(), _U if whole else np.uint16) for c in (3, 4))
                if not whole:
                    a, b = numbered(a), numbered(b)
                if fits(min(len(a), len(b)), len(a) + len(b), percent) and fits(len(np.intersect1d(a, b, assume_unique=True)), len(a) + len(b), percent):
                    good.append(r)
            keep = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c).take(keep) for c in range(3)], _PAIRS.names)

    return verify


def _places(spark: SparkSession, n: int) -> list[int]:
    """Numbers of n buckets that hash partitioning deals to n partitions, one each."""
    number = F.col("id").cast("int")
    found = {r["p"]: r["i"] for r in spark.range(32 * n).groupBy(F.pmod(F.hash(number), F.lit(n)).alias("p")).agg(F.min(number).alias("i")).collect()}
    return [found.get(p, 32 * n + p) for p in range(n)]


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """doc_id, n_shingles, component_id for every row: component_id is the smallest id that links reach."""
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    naming = (seed, 64 if seed else NAME_BITS)
    scan = materialize(base.mapInArrow(_scan(words, naming), _SCAN), "sets")
    member = scan.where("key is not null").select("doc_id", "key", "n")
    classes = scan.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("check").alias("x"), F.max("check").alias("y"), F.first("n").alias("n"))
    classes = materialize(classes, "classes")
    sized = classes.agg(F.sum("n").alias("n"), F.count_if(F.col("x") != F.col("y")).alias("twice")).first()
    if sized["twice"]:
        return jaccard_components(docs, words, percent, doc_id, text, seed + 1)
    hot = scan.where("shingle is not null").groupBy("shingle").agg(F.sum("seen").alias("c")).where(F.col("c") >= FREQUENT)
    hot = hot.orderBy(F.desc("c"), "shingle").limit(MAX_FREQUENT).toArrow()
    often, times = (hot[c].to_numpy() for c in ("shingle", "c"))
    order = np.argsort(often.view(_U))
    frequent, counts = (spark.sparkContext.broadcast(x) for x in (often.view(_U)[order], times[order]))
    places = _places(spark, max(8, int((sized["n"] or 0) * 1.2 / BUCKET) + 1))
    dealt = base.select("text").mapInArrow(_deal(words, percent, naming, places, frequent, counts), _DEALT)
    met = materialize(dealt.repartition(len(places), "bucket").sortWithinPartitions("bucket").mapInArrow(_meet, _MET), "groups")

    links = met.select("pivots", "members", "times").mapInArrow(_links, _LINKS).groupBy("a", "b").agg(F.sum("times").alias("times"))
    best = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("times"), "a"))
    first = materialize(links.withColumn("_r", best).where(F.col("_r") <= FIRST).select(F.lit(None).cast("long").alias("home"), "a", "b"), "first")
    packed = met.select("bucket", "runs", "inside")
    # Groups of the same classes, whatever signatures made them, are looked at once.
    groups = packed.mapInArrow(_runs, _RUNS).groupBy("home", "size", "content", "content2").agg(F.min(F.struct("bucket", "run")).alias("_g"))
    groups = groups.select("home", "_g.bucket", "_g.run")
    inside = materialize(packed.mapInArrow(_members, _MEMBERS).join(groups, ["bucket", "run"]).select("home", "bucket", "run", "key"), "members")
    discard(met)
    # Only classes in some group are verified: one document of each stands for it.
    stand = materialize(classes.select("key", "doc_id").join(inside.select("key").distinct(), "key"), "stand")
    few = stand.count() <= BROADCAST_IDS
    wanted = base.join(F.broadcast(stand) if few else stand, "doc_id").select("key", "text")
    sets = wanted.mapInArrow(_sets(words, SHORT_BITS), _SETS)
    twice = member.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").join(stand, "doc_id", "left_semi")
    sets = materialize(sets if twice.isEmpty() else sets.dropDuplicates(["key"]), "shingles")
    side = lambda name, kind: sets.select(F.col("key").alias(name), F.col(kind).alias(f"of_{name}"))

    def verified(pairs: DataFrame, kind: str = "shingles") -> DataFrame:
        met = pairs.join(side("a", kind), "a").join(side("b", kind), "b").select("home", "a", "b", "of_a", "of_b")
        return materialize(met.mapInArrow(_verify(percent, kind == "shingles"), _PAIRS), "links" if kind == "shingles" else "hopeful")

    def labelled(linked: DataFrame) -> DataFrame:
        return materialize(connected_components(linked, "a", "b"), "labels")

    def torn(labels: DataFrame, homes: DataFrame | None) -> DataFrame:
        """Members of groups that labels keep apart, with the number of parts of their place."""
        some = inside if homes is None else inside.join(homes, "home")
        named = some.join(labels.select(F.col("node").alias("key"), "component"), "key", "left").select("home", "bucket", "run", "key", F.coalesce("component", "key").alias("label"))
        named = materialize(named, "named")
        apart = named.groupBy("bucket", "run").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("bucket", "run")
        found = materialize(named.join(apart, ["bucket", "run"]).join(sets.select("key", "n"), "key"), "apart")
        discard(named)
        return found

    def parts_of(apart: DataFrame) -> DataFrame:
        """Places that need more than one part, and how many."""
        weight = apart.select("home", "key", "n").distinct().groupBy("home").agg(F.count("*").alias("rows"), F.sum("n").alias("all"))
        cut = weight.select("home", F.ceil(F.greatest(F.col("rows") / TILE, F.col("all") / TILE_SHINGLES)).cast("int").alias("k"))
        return materialize(cut.where("k > 1"), "parts")

    def across(apart: DataFrame, cut: DataFrame, forest: bool, thin: bool) -> DataFrame:
        """Pairs of two labels in a group that may be linked; thin: each part of a place with itself and the first part only."""
        part = F.pmod(F.xxhash64("key"), F.col("k")).cast("int")
        every = F.sequence(F.lit(0), F.col("k") - 1)
        beside = F.when(F.col("part") == 0, every).otherwise(F.array(F.lit(0), F.col("part"))) if thin else every
        none = lambda kind, name: F.lit(None).cast(kind).alias(name)
        brief = apart.select("home", "key").distinct().join(sets.select("key", "short"), "key").select("home", none("int", "bucket"), none("int", "run"), "key", none("long", "label"), "short")
        rows = apart.select("home", "bucket", "run", "key", "label", none("binary", "short")).unionByName(brief)
        rows = rows.join(cut, "home", "left").withColumn("k", F.coalesce("k", F.lit(1))).withColumn("part", part).withColumn("_o", F.explode(beside))
        tiled = rows.select("home", F.least("part", "_o").alias("i"), F.greatest("part", "_o").alias("j"), "bucket", "run", "key", "label", "part", "short")
        order = ["home", "i", "j", F.asc_nulls_first("bucket"), F.asc_nulls_first("run")]
        return materialize(tiled.repartition("home", "i", "j").sortWithinPartitions(*order).mapInArrow(_spanning(percent, forest), _PAIRS).dropDuplicates(["home", "a", "b"]), "likely")

    # Whole sets travel for pairs that their shortenings, a quarter of the size, can't rule out.
    hopeful = verified(first, "short")
    discard(first)
    linked = verified(hopeful)
    discard(hopeful)
    labels, homes, forest, fresh = labelled(linked), None, True, True
    # Large places are thinned out by few tiles first. A forest whose links all hold leaves nothing to test; where some fail, all pairs are listed.
    while True:
        apart = torn(labels, homes)
        if apart.isEmpty():
            break
        cut = parts_of(apart)
        thin = fresh and (cut.agg(F.max("k")).first()[0] or 0) > 2
        likely = across(apart, cut, forest, thin)
        more = verified(likely)
        failed = materialize(likely.join(more, ["home", "a", "b"], "left_anti").select("home").distinct(), "failed")
        if not more.isEmpty():
            stars = labels.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
            discard(linked)
            linked = materialize(stars.unionByName(more.select("a", "b")), "links")
            labels = labelled(linked)
        for done in (apart, cut, likely, more):
            discard(done)
        if not thin:
            if not forest or failed.isEmpty():
                break
            homes, forest = failed, False
        fresh = False
    placed = member.join(labels.select(F.col("node").alias("key"), "component"), "key", "left").select(
        "doc_id", "n", F.when(F.col("n") > 0, F.coalesce("component", "key")).alias("part")
    )
    placed = materialize(placed, "placed")
    for done in (scan, classes, inside, stand, sets, linked, labels):
        discard(done)  # all that the result rests on is in placed
    low = placed.where("part is not null").groupBy("part").agg(F.min("doc_id").alias("low"))
    return placed.join(low, "part", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("low", "doc_id").alias("component_id"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(ship(spark).read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' '))) END AS s FROM w),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs WHERE 100 * c >= 75 * (na + nb - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x)
SELECT s.doc_id, len(s.s) AS n_shingles, m.component_id
FROM sets s JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) m ON s.doc_id = m.x
"""
