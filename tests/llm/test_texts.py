"""Operators on single texts: quality rules, BPE, language identification, language model."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from common import documents, frame
from hypothesis import given, settings
from hypothesis import strategies as st

from kinloom.llm import byte_bpe, language_id, quality_rules, recurrent_lm


def rows_of(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def duck(rows):
    import pandas as pd

    c = duckdb.connect()
    table = pd.DataFrame([(r[0], r[1], r[3]) for r in rows], columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    c.register("t", table)
    c.execute("create table documents as select * from t")
    return c


def test_quality_like_sql(spark):
    rows = documents()
    found = quality_rules.judge_documents(frame(spark, rows))
    names = found.columns
    theirs = duck(rows).execute(quality_rules.SQL)
    at = [x[0] for x in theirs.description]
    assert rows_of(found, *names) == Counter(tuple(r[at.index(n)] for n in names) for r in theirs.fetchall())
    assert quality_rules.judge_documents(frame(spark, [])).collect() == []


def test_line_rules(spark):
    assert quality_rules.line_fails("Home | About | Contact", 5)
    assert quality_rules.line_fails("Please read our Privacy Policy.", 5)
    assert quality_rules.line_fails("no end mark in this line of ten words or more", 11)
    assert not quality_rules.line_fails("A short title", 3)
    assert not quality_rules.line_fails("A sentence of ten words or more is kept, of course.", 11)
    df = frame(spark, [(1, "Home | About\nA good line.", None, None, 1, 1, "", 1, b"")])
    assert df.select(quality_rules.clean_lines(df["text"])).first()[0] == "A good line."


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(byte_bpe.load_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=80))
def test_bpe_is_the_library(codec, library, text):
    ids = codec.encode(text)
    assert ids == library.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 30_000, "ab" * 9000, "\x1c\x1d \x85 　", "日本語" * 3000, "", "'s 'll  x"])
def test_bpe_long_pretokens(codec, library, text):
    assert codec.encode(text) == library.encode_ordinary(text)
    assert not codec.buckets and not any(codec.low) and not any(codec.mid)


def test_bpe_columns(spark, codec):
    vocabulary = byte_bpe.load_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    df = frame(spark)
    out = byte_bpe.tokenize(df, vocabulary, public_tokenizers.PATTERN)
    assert rows_of(out, "doc_id", "n_tokens") == Counter((r[0], len(codec.encode(r[1] or ""))) for r in documents())
    ids = df.withColumn("ids", byte_bpe.encode_column(df["text"], vocabulary, public_tokenizers.PATTERN))
    back = ids.select("text", byte_bpe.decode_column(ids["ids"], vocabulary, public_tokenizers.PATTERN).alias("b")).collect()
    assert all(bytes(r["b"]) == (r["text"] or "").encode() for r in back)
    assert byte_bpe.tokenize(frame(spark, []), vocabulary, public_tokenizers.PATTERN).collect() == []


def test_language(spark):
    rows = []
    for i in range(240):
        lang = ("en", "de", "xx")[i % 3]
        body = {"en": "the with that this and have", "de": "der die und nicht über schön", "xx": "zq qz zzq qqz qzq"}[lang].split()
        rows.append((i, " ".join(body[(i + k * k) % len(body)] for k in range(25)), lang, None, 1, 1, "", 1, b""))
    rows += [(1000, None, "en", None, 1, 1, "", 1, b""), (1001, "12 34 !", "en", None, 1, 1, "", 1, b""), (1002, "", None, None, 1, 1, "", 1, b""), rows[0], (None, "und die nicht", None, None, 1, 1, "", 1, b"")]
    got = language_id.identify(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = {r[0]: r[2] for r in rows}
    for r in got:
        if r["doc_id"] in (1000, 1001, 1002):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
            assert r["lang_pred"] == want[r["doc_id"]] and 0.5 < r["score"] <= 1
    assert {r["lang_pred"] for r in language_id.identify(frame(spark, [(1, "text", None, None, 1, 1, "", 1, b"")])).collect()} == {"und"}
    assert language_id.identify(frame(spark, [])).collect() == []


def test_calibration():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 4000)
    z = np.zeros((4000, 2))
    z[np.arange(4000), np.where(rng.random(4000) < 0.8, y, 1 - y)] = 10.0
    t = language_id.fit_temperature(z, y)
    assert abs(language_id.softmax(z[:1] / t).max() - 0.8) < 0.03


@pytest.mark.parametrize("head", [recurrent_lm.HEAD, 40])
def test_language_model(spark, monkeypatch, head):
    monkeypatch.setattr(recurrent_lm, "HEAD", head)
    monkeypatch.setattr(recurrent_lm, "WORDS", 20)
    rows = [r for r in documents(n=40) if len(r[1] or "") < 10_000]
    got = recurrent_lm.score_likelihood(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    counts = Counter(w for r in rows if not held(r[0]) for w in tokens(r[1]))
    total, distinct = sum(counts.values()), len(counts)
    want = Counter()
    for r in rows:
        t = tokens(r[1])
        base = sum(np.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in t)
        want[r[0], held(r[0]), len(t), sum(counts[w] > 0 for w in t), total, round(float(base), 6)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert recurrent_lm.score_likelihood(frame(spark, [])).collect() == []


def test_model_is_a_distribution(monkeypatch):
    """After any history, known tokens and one unseen token a class share probability one; windows don't matter."""
    monkeypatch.setattr(recurrent_lm, "WORDS", 12)
    tokens = [b""] + [f"w{i}".encode() for i in range(30)] + ["é1".encode(), "ü2".encode()]
    counts = np.arange(len(tokens), 0, -1) * 3
    mass = np.full(recurrent_lm.TAIL_CLASSES, 0.5)
    for t, c in list(zip(tokens, counts, strict=True))[12:]:
        mass[recurrent_lm.tail_class(t)] += c + 0.5
    v = recurrent_lm.Vocabulary(tokens, counts, int(counts.sum()), len(tokens), mass)
    streams = []
    rng = np.random.default_rng(0)
    for _ in range(30):
        index, cls = recurrent_lm.classes_of(v, [tokens[i] for i in rng.integers(0, len(tokens), 40)] + [b""])
        streams.append((cls, np.where(index < v.words, index, -1)))
    net = recurrent_lm.fit(v, streams)
    history = [tokens[5], tokens[20], tokens[31]] * 30
    docs = [recurrent_lm.classes_of(v, history + [t]) for t in tokens]
    before = recurrent_lm.score_documents(net, v, [recurrent_lm.classes_of(v, history)])[0]
    known = np.exp(recurrent_lm.score_documents(net, v, docs) - before).sum()
    unseen = 0.0
    for k in range(recurrent_lm.TAIL_CLASSES):
        index, cls = recurrent_lm.classes_of(v, history)
        one = (np.append(index, -1), np.append(cls, recurrent_lm.WORD_CLASSES + k))
        unseen += np.exp(recurrent_lm.score_documents(net, v, [one])[0] - before) * 0.5
    assert abs(known + unseen - 1) < 1e-3


def test_network_learns_from_all_training_documents(spark, monkeypatch):
    """Words repeat in a cycle that counts can't tell; with no first sample, only the pass over all documents can learn it."""
    monkeypatch.setattr(recurrent_lm, "WORDS", 20)
    monkeypatch.setattr(recurrent_lm, "FIT_DOCS", 0)
    monkeypatch.setattr(recurrent_lm, "WIDE", 16)
    monkeypatch.setattr(recurrent_lm, "MERGED", 2)
    cycle = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(cycle[(i + k) % 12] for k in range(60 + i % 30)), "en", None, 1, 1, "", 1, b"") for i in range(1200)]
    got = recurrent_lm.score_likelihood(frame(spark, rows)).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 1200 and len(held) > 100
    assert sum(r["score"] for r in held) > 0.6 * sum(r["base_score"] for r in held)


def test_averaged_weights():
    rows = [(2, 30, np.array([1.0, 5.0]).tobytes()), (0, 10, np.array([5.0, 1.0]).tobytes())]
    tokens, mean = recurrent_lm._mean(rows)
    assert tokens == 40 and mean.tolist() == [2.0, 4.0]


def test_scores_are_brute_force(monkeypatch):
    """Against a plain step-by-step version; whatever the window, the lane and the number of documents beside."""
    monkeypatch.setattr(recurrent_lm, "WORDS", 9)
    monkeypatch.setattr(recurrent_lm, "STEPS", 5)
    tokens = [b""] + [f"w{i}".encode() for i in range(20)]
    counts = np.arange(len(tokens), 0, -1) ** 2
    mass = np.full(recurrent_lm.TAIL_CLASSES, 0.5)
    for t, c in zip(tokens[9:], counts[9:], strict=True):
        mass[recurrent_lm.tail_class(t)] += c + 0.5
    v = recurrent_lm.Vocabulary(tokens, counts, int(counts.sum()), len(tokens), mass)
    rng = np.random.default_rng(3)
    texts = [[tokens[i] for i in rng.integers(0, 21, n)] + [b""] for n in (0, 1, 4, 5, 6, 40, 17)]
    docs = [recurrent_lm.classes_of(v, t) for t in texts]
    net = recurrent_lm.fit(v, [(c, np.where(i < v.words, i, -1)) for i, c in docs])

    def plain(index, cls):
        h, total, row = np.zeros(recurrent_lm.HIDDEN), 0.0, v.words + recurrent_lm.TAIL_CLASSES
        for i, c in zip(index, cls, strict=True):
            z = 1 / (1 + np.exp(-net.gate[row].astype(float)))
            h = h + z * (np.tanh(net.candidate[row].astype(float)) - h)
            p = np.exp(net.class_w @ h + net.class_b)
            total += np.log(p[c] / p.sum())
            if c < recurrent_lm.WORD_CLASSES:
                own = slice(v.starts[c], v.starts[c + 1])
                q = np.exp(net.word_w[own] @ h + net.word_b[own])
                total += np.log(q[i - own.start] / q.sum())
                row = i
            else:
                total += np.log((counts[i] + 0.5) / mass[c - recurrent_lm.WORD_CLASSES])
                row = v.words + c - recurrent_lm.WORD_CLASSES
        return total

    assert np.allclose(recurrent_lm.score_documents(net, v, docs), [plain(*d) for d in docs], rtol=1e-4)


def test_gradients_are_numeric(monkeypatch):
    """Backpropagation through a window against finite differences of the scores."""
    monkeypatch.setattr(recurrent_lm, "WORDS", 6)
    tokens = [b""] + [f"w{i}".encode() for i in range(9)]
    counts = np.arange(len(tokens), 0, -1) * 2
    mass = np.full(recurrent_lm.TAIL_CLASSES, 0.5)
    for t, c in zip(tokens[6:], counts[6:], strict=True):
        mass[recurrent_lm.tail_class(t)] += c + 0.5
    v = recurrent_lm.Vocabulary(tokens, counts, int(counts.sum()), len(tokens), mass)
    learnt = recurrent_lm.classes_of(v, [tokens[i % 10] for i in range(30)])
    net = recurrent_lm.fit(v, [(learnt[1], np.where(learnt[0] < v.words, learnt[0], -1))])
    index, cls = recurrent_lm.classes_of(v, [tokens[i] for i in (3, 1, 7, 2, 2, 0)])
    word = np.where(index < v.words, index, -1)
    row = np.concatenate(([v.words + recurrent_lm.TAIL_CLASSES], np.where(word >= 0, word, v.words + cls - recurrent_lm.WORD_CLASSES)[:-1]))
    grads, n, _ = recurrent_lm.gradients(net, v, np.zeros((1, recurrent_lm.HIDDEN), np.float32), row[:, None], cls[:, None], word[:, None])
    assert n == 6
    rng = np.random.default_rng(0)
    for p, g in zip(net.params(), grads, strict=True):
        whole = np.zeros_like(p)
        if isinstance(g, tuple):
            whole[g[0]] = g[1]
        else:
            whole = g
        for at in rng.permutation(np.argwhere(np.abs(whole) > 1e-2))[:5]:
            at = tuple(at)
            keep, loss = p[at], []
            for d in (-0.02, 0.02):
                p[at] = keep + d
                loss.append(-recurrent_lm.score_documents(net, v, [(index, cls)])[0])
            p[at] = keep
            assert abs((loss[1] - loss[0]) / 0.04 - whole[at]) < 2e-2 * max(1, abs(whole[at]))


def test_model_beats_counts_on_held_out_documents(spark):
    """On the small table, the model's held-out score is better than the base's in all."""
    got = recurrent_lm.op5_recurrent_lm(spark, "/root/testdata/sf0.01").where("held_out").selectExpr("sum(score) AS s", "sum(base_score) AS b").first()
    assert got["s"] > got["b"]


def test_languages_of_held_out_documents(spark):
    """On the small table: accuracy by held-out documents with a letter, and how far scores are from shares that are right."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = language_id.op2_language_id(spark, "/root/testdata/sf0.01").where("held_out AND lang_pred <> 'und'").join(docs, "doc_id").where("lang is not null").collect()
    right = np.array([r["lang_pred"] == r["lang"] for r in rows])
    score = np.array([r["score"] for r in rows])
    assert len(rows) > 150 and right.mean() >= 0.9
    error = sum(abs(right[own].mean() - score[own].mean()) * own.mean() for k in range(10) if (own := (score >= k / 10) & (score < (k + 1) / 10 + (k == 9))).any())
    assert error < 0.1


def test_release_empties_other_operators_caches():
    from functools import lru_cache

    from kinloom.llm import _words

    calls = []
    held = _words.kept(lru_cache(maxsize=1)(lambda: calls.append(1)))
    held(), held()
    _words._powers(_words.SLICE * 2)
    _words.release()
    held()
    assert len(calls) == 2 and not _words._POW
    assert len(_words._powers(10)[0]) == _words.SLICE + (_words.SLICE >> 3)
    _words._KEPT.pop()


def test_stages_give_heap_back(spark, monkeypatch):
    """A stage that needs memory outside the heap first lets executors collect: one collection at least (local mode has one executor)."""
    import corpus_pipeline
    from kinloom import runtime

    beans = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = beans()
    assert runtime.settle(spark) is spark and beans() > before
    called = []
    monkeypatch.setattr(corpus_pipeline, "settle", lambda s: called.append(1) or s)
    docs = spark.createDataFrame([(1, "a b c", "en", "x")], "doc_id long, text string, lang string, source string")
    assert corpus_pipeline.tokenize(spark, docs, "").count() == 1 and called
