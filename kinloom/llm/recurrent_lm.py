"""Document log-likelihood under a gated recurrent language model with a class-factored softmax.

Vocabulary statistics come from every training document: token counts, their total N and number V,
and the mass of each class. The WORDS most frequent tokens stand in frequency classes of equal mass and have
word weights within their class; a class without a word has no probability. All other tokens, unseen ones too, stand in classes told by their
spelling; there a token's share is its smoothed count. So
P(token | history) = P(class | state) * P(token | class, state) sums to one over known tokens and
one unseen token a class.

The recurrent part is a minimal gated unit in numpy: h = h + z * (c - h), where the gate z and the candidate c are told by the input token, so a step is
two table look-ups. It is fitted by truncated backpropagation: documents side by side, windows of STEPS tokens, state carried
across windows. One task fits a first network on about FIT_DOCS documents chosen by a hash. From it each partition
then makes a pass over all its training documents, WIDE side by side, and the networks are averaged by their tokens;
so the fitted weights, not the counts, depend on how the input is split. Scoring runs documents side by side,
sorted by length, window by window with state carried to the end of every document.

Counts of at most HEAD tokens travel to the workers; the rest are looked up by a join.

Defined results: null and empty texts are the end token alone; repeated rows are scored one by one; a
null id is never held out; without training documents every token is unseen; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom.llm._store import materialize
from kinloom.runtime import ship

HEAD, WORDS, WORD_CLASSES, TAIL_CLASSES = 262_144, 2000, 40, 16
HIDDEN, EMBED = 24, 16
FIT_DOCS, LANES, STEPS, EPOCHS, RATE = 1200, 64, 32, 2, 0.012
WIDE, MERGED, LEVELS = 256, 8, 3
SIDE = 1024
END = b""


def tokens_of(text: str | None) -> list[bytes]:
    """Words of the text with A-Z in lower case, then the end token."""
    out = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out.append(END)
    return out


def tail_class(token: bytes) -> int:
    """The class of a token by its spelling: by its first letter beyond ASCII, else by its last two bytes."""
    if not token.isascii():
        at = next(i for i, b in enumerate(token) if b > 127)
        return TAIL_CLASSES // 2 + crc32(token[at : at + 2]) % (TAIL_CLASSES // 2)
    return crc32(token[-2:]) % (TAIL_CLASSES // 2)


@dataclass
class Vocabulary:
    """The most frequent tokens with counts in falling order, and the mass of classes."""

    tokens: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    tail_mass: np.ndarray
    index: dict[bytes, int] = field(init=False)

    def __post_init__(self) -> None:
        self.index = {t: i for i, t in enumerate(self.tokens)}
        self.words = min(WORDS, len(self.tokens))
        own = self.counts[: self.words].astype(np.float64)
        share = (np.cumsum(own) - own) / max(own.sum(), 1.0)
        self.word_class = np.minimum((share * WORD_CLASSES).astype(np.int64), WORD_CLASSES - 1)
        self.starts = np.searchsorted(self.word_class, np.arange(WORD_CLASSES + 1))
        self.spelled = np.array([tail_class(t) for t in self.tokens], np.int64) + WORD_CLASSES
        self.spelled[: self.words] = self.word_class
        self.log_count = np.log(self.counts + 0.5)
        self.log_base = float(np.log(self.total + 0.5 * (self.distinct + 1)))


@dataclass
class Net:
    """A minimal gated unit (Feng et al., 2024): update gate and candidate are told by the input token, so both are rows of tables."""

    gate: np.ndarray  # input row -> HIDDEN, before the sigmoid
    candidate: np.ndarray  # input row -> HIDDEN, before the hyperbolic tangent
    class_w: np.ndarray
    class_b: np.ndarray  # -inf where a class holds no word
    word_w: np.ndarray
    word_b: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [self.gate, self.candidate, self.class_w, self.class_b, self.word_w, self.word_b]

    def activated(self, rows: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """(gates, candidates) of input rows."""
        return 1 / (1 + np.exp(-self.gate[rows])), np.tanh(self.candidate[rows])


def _shifted(w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, bool]:
    """(weights with the bias as a last column, less a bound of all logits; whether that keeps the largest logit of any state from underflow). States lie in [-1, 1]."""
    reach = np.abs(w).sum(1)
    top = (b + reach).max()
    return np.concatenate((w, (b - top)[:, None]), 1), bool((b - reach).max() > top - 60)


def _exps(x: np.ndarray, w: np.ndarray, safe: bool) -> np.ndarray:
    """exp of the logits of states (with a last column of ones), each row to its own scale."""
    out = x @ w.T
    if not safe:
        out -= out.max(1, keepdims=True)
    return np.exp(out, out=out)


def new_net(v: Vocabulary) -> Net:
    rng = np.random.default_rng(7)
    real = np.float32
    mass = np.zeros(WORD_CLASSES + TAIL_CLASSES)
    np.add.at(mass, v.word_class, v.counts[: v.words])
    mass[WORD_CLASSES:] = v.tail_mass
    bias = np.full(len(mass), -np.inf)
    bias[mass > 0] = np.log(np.maximum(mass[mass > 0], 0.5))
    words = v.log_count[: v.words] if v.words else np.zeros(0)
    inputs = v.words + TAIL_CLASSES + 1
    return Net(
        (rng.standard_normal((inputs, HIDDEN)) * 0.3 + np.linspace(-2, 2, HIDDEN)).astype(real),
        (rng.standard_normal((inputs, HIDDEN)) * 0.3).astype(real),
        np.zeros((len(mass), HIDDEN), real), bias.astype(real),
        np.zeros((v.words, HIDDEN), real), words.astype(real),
    )


def _runs(y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by class, start of each class in it); 16-bit keys sort in linear time."""
    order = np.argsort(y.astype(np.int16), kind="stable")
    return order, np.concatenate(([0], np.cumsum(np.bincount(y, minlength=classes))))


def gradients(net: Net, v: Vocabulary, h: np.ndarray, row: np.ndarray, cls: np.ndarray, word: np.ndarray) -> tuple[list, int, np.ndarray]:
    """Summed gradients over a window (steps by lanes; class -1 where a lane has ended), its live tokens, and the state after it.

    The first two gradients are (input rows, gradient) of the rows that occur."""
    width, lanes = row.shape
    H = h.shape[1]
    seen = np.zeros(len(net.gate), bool)
    seen[row] = True
    at = np.flatnonzero(seen)
    place = (np.cumsum(seen) - 1)[row]
    z_at, c_at = net.activated(at)
    z, c = z_at.take(place, 0), c_at.take(place, 0)
    moved = np.empty((width, lanes, H), np.float32)  # candidate less state before
    states = np.empty((width, lanes, H), np.float32)
    for t in range(width):
        np.subtract(c[t], h, out=moved[t])
        np.multiply(z[t], moved[t], out=states[t])
        states[t] += h
        h = states[t]
    live = np.flatnonzero(cls.ravel() >= 0)
    by, cuts = _runs(cls.ravel()[live], WORD_CLASSES + TAIL_CLASSES)
    live = live[by]
    y, w = cls.ravel()[live], word.ravel()[live]
    x = np.ones((len(y), H + 1), np.float32)
    x[:, :H] = states.reshape(-1, H).take(live, 0)
    weights, safe = _shifted(net.class_w, net.class_b)
    p = _exps(x, weights, safe)
    p /= (p @ np.ones(p.shape[1], np.float32))[:, None]
    p[np.arange(len(y)), y] -= 1
    dx = p @ net.class_w
    class_g = p.T @ x
    word_g = np.zeros((len(net.word_w), H + 1), np.float32)
    for k in np.flatnonzero(np.diff(cuts[: WORD_CLASSES + 1])):
        mine, words = slice(cuts[k], cuts[k + 1]), slice(v.starts[k], v.starts[k + 1])
        if words.stop - words.start > 1:
            weights, safe = _shifted(net.word_w[words], net.word_b[words])
            q = _exps(x[mine], weights, safe)
            q /= (q @ np.ones(q.shape[1], np.float32))[:, None]
            q[np.arange(len(q)), w[mine] - words.start] -= 1
            dx[mine] += q @ net.word_w[words]
            word_g[words] = q.T @ x[mine]
    back = np.zeros((width, lanes, H), np.float32)
    back.reshape(-1, H)[live] = dx
    dz, keep = moved, np.subtract(1, z)
    dh = np.zeros((lanes, H), np.float32)
    for t in range(width - 1, -1, -1):
        dh += back[t]
        dz[t] *= dh
        np.multiply(dh, z[t], out=back[t])  # now the candidate's
        dh *= keep[t]
    flat = place.ravel()
    dz, dc = (np.stack([np.bincount(flat, c, len(at)) for c in np.ascontiguousarray(d.reshape(-1, H).T)], 1).astype(np.float32) for d in (dz, back))
    return [(at, dz * z_at * (1 - z_at)), (at, dc * (1 - c_at * c_at)), class_g[:, :H], class_g[:, H], word_g[:, :H], word_g[:, H]], len(y), h


class Descent:
    """Adam with a clipped norm and a short rise of the rate; changes the network in place, of the tables the rows that occur."""

    def __init__(self, net: Net) -> None:
        self.params = net.params()
        self.first, self.second = [np.zeros_like(p) for p in self.params], [np.zeros_like(p) for p in self.params]
        self.steps = 0

    def step(self, grads: list, tokens: int) -> None:
        scale = np.float32(1 / tokens)
        self.steps += 1
        plain = [g[1] if isinstance(g, tuple) else g for g in grads]
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in plain)) * float(scale)
        clip = scale * np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
        rate = np.float32(RATE * min(1.0, self.steps / 20) / (1 - 0.9**self.steps))
        even = np.float32(1 / np.sqrt(1 - 0.99**self.steps))
        for p, told, g, m, s in zip(self.params, grads, plain, self.first, self.second, strict=True):
            at = told[0] if isinstance(told, tuple) else slice(None)
            g = g * clip
            first = m[at] * np.float32(0.9) + g * np.float32(0.1)
            second = s[at] * np.float32(0.99) + g * g * np.float32(0.01)
            m[at], s[at] = first, second
            p[at] -= rate * first / (np.sqrt(second) * even + np.float32(1e-6))


def fit(v: Vocabulary, streams: list[tuple[np.ndarray, np.ndarray]]) -> Net:
    """A new network after EPOCHS passes over documents given as (classes, words); word -1 where the class is spelled."""
    net = new_net(v)
    descent = Descent(net)
    for _ in range(EPOCHS):
        fit_more(net, v, descent, streams, LANES)
    return net


def _window(starts: np.ndarray, sizes: np.ndarray, begin: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (steps by lanes) in documents laid end to end, and which lie after the documents' ends."""
    step = begin + np.arange(width)[:, None]
    over = step >= sizes
    return np.where(over, 0, starts + step), over


def _inputs(row: np.ndarray, at: np.ndarray, begin: int, start: int) -> np.ndarray:
    """The tokens before those places; start for the first of a document."""
    out = row.take(np.maximum(at - 1, 0))
    if begin == 0:
        out[0] = start
    return out


def fit_more(net: Net, v: Vocabulary, descent: Descent, streams: list[tuple[np.ndarray, np.ndarray]], wide: int) -> None:
    """One pass of truncated backpropagation over all the documents, those of like length side by side; state is carried from window to window."""
    order = sorted(range(len(streams)), key=lambda i: -len(streams[i][0]))
    groups = [order[i : i + wide] for i in range(0, len(order), wide)]
    for g in np.random.default_rng(len(streams)).permutation(len(groups)):
        docs = [streams[i] for i in groups[g]]
        sizes = np.array([len(c) for c, _ in docs])
        starts = np.cumsum(sizes) - sizes
        cls, word = (np.concatenate([d[k] for d in docs]) for k in (0, 1))
        row = np.where(word >= 0, word, v.words + cls - WORD_CLASSES)
        h = np.zeros((len(docs), HIDDEN), np.float32)
        for begin in range(0, int(sizes[0]), STEPS):
            active, width = int((sizes > begin).sum()), min(STEPS, int(sizes[0]) - begin)
            at, over = _window(starts[:active], sizes[:active], begin, width)
            y = cls.take(at)
            y[over] = -1
            grads, tokens, h = gradients(net, v, h[:active], _inputs(row, at, begin, v.words + TAIL_CLASSES), y, word.take(at))
            descent.step(grads, tokens)


def classes_of(v: Vocabulary, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(index in the head or -1, class) of each token."""
    index = np.fromiter(map(v.index.get, tokens, repeat(-1)), np.int64, len(tokens))
    cls = v.spelled[index] if len(v.spelled) else np.zeros(len(index), np.int64)
    for i in np.flatnonzero(index < 0):
        cls[i] = WORD_CLASSES + tail_class(tokens[i])
    return index, cls


def score_documents(net: Net, v: Vocabulary, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Natural log-likelihood of each document given as (index, class); a spelled token's own count is left out where it isn't in the head."""
    out = np.zeros(len(docs))
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i][0]))
    log_mass = np.log(np.maximum(v.tail_mass, 0.5))
    gate, candidate = net.activated()
    class_w = _shifted(net.class_w, net.class_b)
    word_w = [_shifted(net.word_w[i:j], net.word_b[i:j]) if j > i else None for i, j in zip(v.starts, v.starts[1:])]
    for group in (order[i : i + SIDE] for i in range(0, len(order), SIDE)):
        sizes = np.array([len(docs[i][0]) for i in group])
        starts = np.cumsum(sizes) - sizes
        index, cls = (np.concatenate([docs[i][k] for i in group]) for k in (0, 1))
        row = np.where((index >= 0) & (index < v.words), index, v.words + cls - WORD_CLASSES)
        h = np.zeros((len(group), HIDDEN), np.float32)
        for begin in range(0, int(sizes[0]), STEPS):
            active, width = int((sizes > begin).sum()), min(STEPS, int(sizes[0]) - begin)
            at, over = _window(starts[:active], sizes[:active], begin, width)
            rows = _inputs(row, at, begin, v.words + TAIL_CLASSES)
            z, states = gate.take(rows, 0), candidate.take(rows, 0)
            h = h[:active]
            for t in range(width):
                states[t] -= h
                states[t] *= z[t]
                states[t] += h
                h = states[t]
            live = np.flatnonzero(~over.ravel())
            by, cuts = _runs(cls.take(at.ravel()[live]), WORD_CLASSES + TAIL_CLASSES)
            live = live[by]
            y, w = cls.take(at.ravel()[live]), index.take(at.ravel()[live])
            x = np.ones((len(y), HIDDEN + 1), np.float32)
            x[:, :HIDDEN] = states.reshape(-1, HIDDEN).take(live, 0)
            q = _exps(x, *class_w)
            logs = np.log(q[np.arange(len(y)), y].astype(np.float64) / (q @ np.ones(q.shape[1], np.float32)))
            spelled = slice(cuts[WORD_CLASSES], None)
            logs[spelled] += np.where(w[spelled] >= 0, v.log_count[w[spelled]], 0.0) - log_mass[y[spelled] - WORD_CLASSES]
            for k in np.flatnonzero(np.diff(cuts[: WORD_CLASSES + 1])):
                mine = slice(cuts[k], cuts[k + 1])
                q = _exps(x[mine], *word_w[k])
                logs[mine] += np.log(q[np.arange(len(q)), w[mine] - v.starts[k]].astype(np.float64) / (q @ np.ones(q.shape[1], np.float32)))
            out[group[:active]] += np.bincount(live % active, logs, active)
    return out


_COUNTED = T.StructType([T.StructField("token", T.BinaryType()), T.StructField("spelled", T.IntegerType()), T.StructField("c", T.LongType())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(map(tail_class, held)), pa.int32()), pa.array(list(held.values()), pa.int64())], ["token", "spelled", "c"])

    held: Counter = Counter()
    for batch in batches:
        for x in batch.column(0):
            held.update(tokens_of(x.as_py()))
            if len(held) > 300_000:
                yield flush(held)
                held = Counter()
    if held:
        yield flush(held)


def held_out(doc_id: Column, parts: int = 5, part: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def read_vocabulary(counts: DataFrame) -> Vocabulary:
    """counts: (token, spelled, c), a row a token. At most HEAD of them reach the driver: all from the count on where that many are left."""
    n = F.least("c", F.lit(1_000_000))
    levels = sorted(((r["n"], r["k"]) for r in counts.groupBy(n.alias("n")).agg(F.count("*").alias("k")).collect()), reverse=True)
    least, room = 1 << 62, HEAD
    for level, k in levels:
        if k > room:
            break
        least, room = level, room - k
    head = counts.where(F.col("c") >= least).toArrow()
    rows = sorted(zip(head["token"].to_pylist(), head["c"].to_pylist(), strict=True), key=lambda r: (-r[1], r[0]))
    tokens, many = [r[0] for r in rows], np.array([r[1] for r in rows], np.int64)
    mass, total, distinct = np.full(TAIL_CLASSES, 0.5), 0, 0
    for r in counts.groupBy("spelled").agg(F.sum("c").alias("c"), F.count("*").alias("k")).collect():
        mass[r["spelled"]] += r["c"] + 0.5 * r["k"]
        total, distinct = total + r["c"], distinct + r["k"]
    for token, c in rows[:WORDS]:
        mass[tail_class(token)] -= c + 0.5
    return Vocabulary(tokens, many, total, distinct, np.maximum(mass, 0.5))


@lru_cache(maxsize=1)
def _loaded(packed: bytes) -> tuple[Net, Vocabulary]:
    return pickle.loads(packed)


_SCORED = T.StructType([
    T.StructField("uid", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
    T.StructField("base", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("rest", T.ArrayType(T.BinaryType())),
])


def _score(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, v = _loaded(shared.value)
        uid = TaskContext.get().partitionId() << 36
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                docs, known, base, rest = [], [], [], []
                for x in part.column(2):
                    tokens = tokens_of(x.as_py())
                    index, cls = classes_of(v, tokens)
                    head = index >= 0
                    docs.append((index, cls))
                    known.append(int(head.sum()))
                    base.append(float(v.log_count[index[head]].sum()) - len(tokens) * v.log_base)
                    rest.append([tokens[i] for i in np.flatnonzero(~head)])
                model = score_documents(net, v, docs)
                n = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(uid, uid + n)), part.column(0), part.column(1), pa.array([len(d[0]) for d in docs], pa.int64()), pa.array(known, pa.int64()),
                        pa.array(base, pa.float64()), pa.array(model), pa.array(rest, pa.list_(pa.binary())),
                    ],
                    ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rest"],
                )
                uid += n

    return score


_FITTED = T.StructType([T.StructField("part", T.LongType()), T.StructField("tokens", T.LongType()), T.StructField("weights", T.BinaryType())])


def _fitted_row(part: int, tokens: int, weights: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([tokens], pa.int64()), pa.array([weights.tobytes()], pa.binary())], ["part", "tokens", "weights"])


def _fit_partition(shared, wide: int, passes: int = 1):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = v = descent = None
        seen = 0
        for batch in batches:
            if net is None and batch.num_rows:
                net, v = pickle.loads(shared.value)
                descent = Descent(net)
            for start in range(0, batch.num_rows, 2048):
                streams = []
                for x in batch.column(0).slice(start, 2048):
                    index, cls = classes_of(v, tokens_of(x.as_py()))
                    streams.append((cls, np.where(index < v.words, index, -1)))
                    seen += len(cls)
                for _ in range(passes):
                    fit_more(net, v, descent, streams, wide)
        if seen:
            yield _fitted_row(TaskContext.get().partitionId(), seen, np.concatenate([p.ravel() for p in net.params()]).astype(np.float64))

    return run


def _mean(rows: list[tuple[int, int, bytes]]) -> tuple[int, np.ndarray]:
    """Tokens and mean weights, by tokens, of (part, tokens, weights)."""
    tokens, total = 0, 0.0
    for _, n, weights in sorted(rows):
        tokens, total = tokens + n, total + np.frombuffer(weights) * n
    return tokens, total / tokens


def _merge(table: pa.Table) -> pa.Table:
    rows = list(zip(*(table[c].to_pylist() for c in ("part", "tokens", "weights")), strict=True))
    return pa.Table.from_batches([_fitted_row(min(r[0] for r in rows), *_mean(rows))])


def _net_of(net: Net, weights: np.ndarray) -> Net:
    params, at = [], 0
    for p in net.params():
        params.append(weights[at : at + p.size].reshape(p.shape).astype(np.float32))
        at += p.size
    return Net(*params)


def fit_first(net: Net, v: Vocabulary, sample: DataFrame) -> Net:
    """The network after EPOCHS passes over the sample (text), in one task."""
    shared = sample.sparkSession.sparkContext.broadcast(pickle.dumps((net, v)))
    found = sample.repartition(1).sortWithinPartitions("text").mapInArrow(_fit_partition(shared, LANES, EPOCHS), _FITTED).collect()
    return _net_of(net, np.frombuffer(found[0]["weights"])) if found else net


def fit_all(net: Net, v: Vocabulary, docs: DataFrame, text: str = "text") -> Net:
    """The network after a pass over all rows of docs from net: one a partition, averaged, MERGED of them in a task, LEVELS times before the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps((net, v)))
    fitted = docs.select(F.col(text)).mapInArrow(_fit_partition(shared, WIDE), _FITTED)
    for level in range(1, LEVELS + 1):
        fitted = fitted.groupBy(F.floor(F.col("part") / MERGED**level).alias("g")).applyInArrow(_merge, _FITTED)
    rows = [(r["part"], r["tokens"], bytes(r["weights"])) for r in fitted.collect()]
    return _net_of(net, _mean(rows)[1]) if rows else net


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[Net, Vocabulary, DataFrame]:
    """(network, vocabulary, counts) from all rows of docs; counts is a written table."""
    counted = docs.select(F.col(text)).mapInArrow(_count, _COUNTED).groupBy("token", "spelled").agg(F.sum("c").alias("c"))
    counts = materialize(counted, "counts")
    v = read_vocabulary(counts)
    share = F.lit(min(1.0, FIT_DOCS / max(docs.count(), 1)) * float(1 << 30))
    sample = docs.where(F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.lit("fit")), F.lit(1 << 30)) < share).select(F.col(text).alias("text"))
    return fit_all(fit_first(new_net(v), v, sample), v, docs, text), v, counts


def score_likelihood(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The contract's columns for every row of docs, learning from those not held out."""
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    net, v, counts = train(base.where(~F.col("held_out")))
    shared = spark.sparkContext.broadcast(pickle.dumps((net, v)))
    scored = materialize(base.mapInArrow(_score(shared), _SCORED), "scored")
    # Tokens beyond the head: their counts come by a join, and meet the documents' sums again by row.
    rest = scored.select("uid", F.explode("rest").alias("token")).groupBy("uid", "token").agg(F.count("*").alias("f"))
    found = rest.join(counts.select("token", "c"), "token", "left").select(
        "uid", (F.col("f") * F.when(F.col("c") > 0, 1).otherwise(0)).alias("n_known"), (F.col("f") * F.log(F.coalesce("c", F.lit(0)) + F.lit(0.5))).alias("more")
    )
    none = lambda kind: F.lit(None).cast(kind)
    whole = scored.select("uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", F.lit(0.0).alias("more"))
    parts = found.select("uid", none("long").alias("doc_id"), none("boolean").alias("held_out"), none("long").alias("n_tokens"), "n_known", none("double").alias("base"), none("double").alias("score"), "more")
    both = whole.unionByName(parts).groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.max("base").alias("b"), F.max("score").alias("s"), F.sum("more").alias("more")
    )
    ten = F.lit(float(np.log(10.0)))
    return both.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(v.total).cast("long").alias("train_tokens"),
        ((F.col("b") + F.col("more")) / ten).alias("base_score"), ((F.col("s") + F.col("more")) / ten).alias("score"),
    )


def op5_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_likelihood(ship(spark).read.parquet(f"{sf_dir}/documents.parquet"))
