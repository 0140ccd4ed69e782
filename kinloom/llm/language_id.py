"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams (1 to 3 characters of lower-cased text, runs of non-letters as one blank),
weighted by log(1 + tf) * idf and scaled to unit length. Document frequencies cover every learnable
document. Weights are fitted by follow-the-regularised-leader with per-coordinate rates and elastic-net
penalties (McMahan et al., 2013) on a bounded sample: about PER_LANGUAGE documents of each language,
chosen by a hash of their ids; one in CALIBRATE of them is set aside to fit the temperature that
turns scores into calibrated probabilities.

Memory: document frequencies and weights have 2**BITS rows whatever the corpus; the sample is bounded by
PER_LANGUAGE times the number of languages. Every language of a learnable document is learned.

Defined results: null texts and texts without a letter get ``und`` and score 0; a corpus without a
learnable document gives ``und`` for all; repeated rows get equal results; an empty table an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom.llm import _words
from kinloom.runtime import ship

BITS, PER_LANGUAGE, CALIBRATE = 14, 600, 5
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 0.2, 0.02, 3
UNKNOWN = "und"
#: Below this probability the pipeline rejects a document.
REJECT = 0.3


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def ngram_counts(text: str, bits: int = BITS) -> np.ndarray:
    """Counts of hashed n-grams of one text, 2**bits of them."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # a run of non-letters leaves one blank
    c = np.where(letter, points, 32)[keep].astype(np.uint64)
    c = np.concatenate(([np.uint64(32)], c, [np.uint64(32)])) if len(c) else c
    out = np.zeros(1 << bits, np.int64)
    h = np.zeros(len(c), np.uint64)
    for n in range(1, 4):
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * np.uint64(0x100000001B3) + c[n - 1 :]
        spread = (h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        out += np.bincount((spread >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return out


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def features(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(counts)
        x = np.log1p(counts[at]) * self.idf[at]
        return at, (x / max(float(np.sqrt((x * x).sum())), 1e-12)).astype(np.float32)

    def logits(self, counts: np.ndarray) -> np.ndarray:
        at, x = self.features(counts)
        return x @ self.weights[at]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(ngram_counts(text)).astype(np.float64) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, size: int) -> np.ndarray:
    """Weights (size, classes) after PASSES over (indices, values, class); most stay 0."""
    z, n = np.zeros((size, classes)), np.zeros((size, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        za, na = z[at], n[at]
        return np.where(np.abs(za) <= L1, 0.0, -(za - np.sign(za) * L1) / ((BETA + np.sqrt(na)) / ALPHA + L2))

    for _ in range(PASSES):
        for at, x, y in rows:
            w = weights(at)
            error = softmax(x @ w)
            error[y] -= 1
            g = x[:, None] * error[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(size)).astype(np.float32)


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood, by golden-section search over its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-300)).mean()
    low, high, g = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _frequencies(bits: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += ngram_counts(x.as_py() or "", bits) > 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["feature", "df"])

    return count


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", bits: int = BITS, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on all rows of docs: statistics on every one, weights on the sample."""
    base = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.col(key).cast("string"), F.lit("sample")).alias("h"))
    base = base.where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in base.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros(1 << bits), np.zeros((1 << bits, 0), np.float32))
    df = np.zeros(1 << bits)
    schema = T.StructType([T.StructField("feature", T.IntegerType()), T.StructField("df", T.LongType())])
    for r in base.select("text").mapInArrow(_frequencies(bits), schema).groupBy("feature").agg(F.sum("df").alias("df")).collect():
        df[r["feature"]] = r["df"]
    idf = np.log((1 + sum(sizes.values())) / (1 + df)) + 1
    languages = sorted(sizes)
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_language / n))])
    chosen = base.where(F.pmod(F.col("h"), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * float(1 << 30))
    counts_type = T.StructType([T.StructField("h", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("at", T.BinaryType()), T.StructField("count", T.BinaryType())])

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ngram_counts(x.as_py(), bits) for x in batch.column(0)]
            at = [np.flatnonzero(c) for c in found]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array([a.astype(np.int32).tobytes() for a in at], pa.binary()), pa.array([c[a].astype(np.int32).tobytes() for c, a in zip(found, at, strict=True)], pa.binary())], ["h", "lang", "at", "count"])

    sample = chosen.mapInArrow(featurize, counts_type).collect()
    sample.sort(key=lambda r: (r["h"] ^ 0x5555555555555555, r["lang"], r["at"]))
    model = Model(languages, idf, np.zeros((1 << bits, len(languages)), np.float32))
    learn, check = [], []
    for r in sample:
        counts = np.zeros(1 << bits, np.int64)
        counts[np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["count"], np.int32)
        (check if r["h"] % CALIBRATE == 0 else learn).append((*model.features(counts), languages.index(r["lang"])))
    model.weights = fit_ftrl(learn or check, len(languages), 1 << bits)
    logits = np.array([x @ model.weights[at] for at, x, _ in check]).reshape(-1, len(languages)).astype(np.float64)
    model.temperature = fit_temperature(logits, np.array([y for *_, y in check], np.int64))
    return model


_PREDICTED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def predict_column(text: Column, model: Model) -> Column:
    """struct(lang_pred, score); the model travels as a broadcast of bounded size."""
    spark = SparkSession.active()
    shared = spark.sparkContext.broadcast(pickle.dumps((model.languages, model.idf, model.weights, model.temperature)))

    def predict(texts: pa.Array) -> pa.Array:
        own = _loaded(shared.value)
        found = [own.predict(x.as_py()) for x in texts]
        return pa.StructArray.from_arrays([pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], ["lang_pred", "score"])

    return F.arrow_udf(predict, _PREDICTED)(text)


@_words.kept
@lru_cache(maxsize=2)
def _loaded(packed: bytes) -> Model:
    return Model(*pickle.loads(packed))


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    model = train(docs.where(~held_out(F.col(doc_id))), text, lang, doc_id)
    out = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), predict_column(F.col(text), model).alias("_p"))
    return out.select("doc_id", "held_out", "_p.lang_pred", "_p.score")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(ship(spark).read.parquet(f"{sf_dir}/documents.parquet"))
