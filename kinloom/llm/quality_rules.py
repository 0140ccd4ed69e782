"""Line-first cleaning and document rules.

Each line (text between newlines) with a word is judged. Navigation: a menu separator
for every four words or more. Boilerplate: one of fixed phrases. Punctuation: ten words or
more without a sentence mark, or a run of symbols (``***``, ``!!``) for every four words or more. Failing lines are removed; a document that loses more than MAX_LOSS
of its word characters is rejected. Base statistics come from the whole text.

Defined results: null and wordless texts have zero counts and fail; repeated rows are
judged one by one; an empty table gives an empty result; any further columns are left
alone. Work is by row, so no group is ever gathered.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom.llm import _words
from kinloom.runtime import ship

MIN_WORDS, MAX_REPEAT, MAX_LOSS = 50, 50, 50
#: Phrases of boilerplate lines, in lower case.
BOILERPLATE = (
    "accept cookies", "all rights reserved", "cookie policy", "enable javascript", "javascript is disabled", "log in to continue",
    "lorem ipsum", "privacy policy", "share this page", "sign up for our newsletter", "subscribe to our newsletter", "terms of service", "terms of use",
)
#: A line of so many words needs a sentence mark somewhere.
LONG_LINE = 10
SENTENCE = r"[.!?;:…。！？]"
SEPARATOR = r"[|»«›‹•·¦>]"
NOISE = r"[#*$%&]{2,}|!{2,}"
_NOISE = re.compile(NOISE)
_BOILER = re.compile("|".join(BOILERPLATE))
_SENTENCE = re.compile(SENTENCE)
_SEPARATOR = re.compile(SEPARATOR)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "bad_lines", "bad_chars")
RESULT = T.StructType([T.StructField(k, T.LongType()) for k in FIELDS])


def line_fails(line: str, n_words: int) -> bool:
    """Whether a line with n_words > 0 words is removed."""
    if len(_SEPARATOR.findall(line)) * 4 >= n_words and _SEPARATOR.search(line):
        return True
    if n_words >= LONG_LINE and not _SENTENCE.search(line):
        return True
    if _NOISE.search(line) and len(_NOISE.findall(line)) * 4 >= n_words:
        return True
    return bool(_BOILER.search(line.lower()))


def _of_slice(data: np.ndarray, offsets: np.ndarray, texts: list[str]) -> dict[str, np.ndarray]:
    h, starts, first = _words.words(data, offsets, lower=False)
    n = np.diff(first)
    solid = ~_words._SPACE[data]
    lead = solid & ((data & 0xC0) != 0x80)
    total = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[offsets])
    out = {"n_words": n, "word_chars": total(lead), "n_symbols": total(_SYMBOL[data])}
    w3 = _words.windows(h, 3)
    repeat, dup, lines, bad, bad_chars = (np.zeros(len(n), np.int64) for _ in range(5))
    for k in range(len(n)):
        a, b = int(first[k]), int(first[k + 1])
        if b - a > 3:
            own = w3[a : b - 2]
            _, where, count = np.unique(own, return_inverse=True, return_counts=True)
            hit = np.flatnonzero(count[where] > 1)
            if len(hit):
                mark = np.zeros(b - a, bool)
                mark[hit] = mark[hit + 1] = mark[hit + 2] = True
                repeat[k] = mark.sum()
        if b > a:
            seen = set()
            for line in texts[k].split("\n"):
                size = len(line.encode().split())
                if not size:
                    continue
                lines[k] += 1
                if line in seen:
                    dup[k] += 1
                seen.add(line)
                if line_fails(line, size):
                    bad[k] += 1
                    bad_chars[k] += sum(map(len, re.findall(r"[^\x20\x09-\x0D]+", line)))
    return out | {"n_dup_lines": dup, "n_repeat_words": repeat, "lines": lines, "bad_lines": bad, "bad_chars": bad_chars}


@F.arrow_udf(RESULT)
def _judge(texts: pa.Array) -> pa.Array:
    data, offsets = _words.buffers(texts)
    parts: dict[str, list] = {}
    for i, j in _words.slices(offsets):
        base = offsets[i]
        found = _of_slice(data[base : offsets[j]], offsets[i : j + 1] - base, [x or "" for x in texts[i : i + (j - i)].to_pylist()])
        for k, v in found.items():
            parts.setdefault(k, []).append(v)
    return pa.StructArray.from_arrays([pa.array(np.concatenate(parts[k]).astype(np.int64) if parts else np.zeros(0, np.int64)) for k in FIELDS], list(FIELDS))


def quality(text: Column) -> Column:
    """Statistics and line verdicts of a text, as a struct; FIELDS names them."""
    return _judge(text)


def base_failed(q: Column) -> Column:
    return (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEAT * q["n_words"])


def kept(q: Column) -> Column:
    return ~base_failed(q) & (100 * q["bad_chars"] <= MAX_LOSS * q["word_chars"])


def cleaned(text: str | None) -> str | None:
    """The text without the lines that fail; null stays null."""
    if text is None:
        return None
    return "\n".join(x for x in text.split("\n") if not (n := len(x.encode().split())) or not line_fails(x, n))


@F.arrow_udf(T.StructType([*RESULT.fields, T.StructField("cleaned", T.StringType())]))
def _judge_and_clean(texts: pa.Array) -> pa.Array:
    data, offsets = _words.buffers(texts)
    parts: dict[str, list] = {k: [np.zeros(0, np.int64)] for k in FIELDS}
    left: list[str | None] = []
    for i, j in _words.slices(offsets):
        base, own = offsets[i], texts[i : i + (j - i)].to_pylist()
        for k, v in _of_slice(data[base : offsets[j]], offsets[i : j + 1] - base, [x or "" for x in own]).items():
            parts[k].append(v)
        left.extend(map(cleaned, own))
    out = pa.StructArray.from_arrays([*(pa.array(np.concatenate(parts[k]).astype(np.int64)) for k in FIELDS), pa.array(left, pa.string())], [*FIELDS, "cleaned"])
    _words.release()
    return out


def quality_and_text(text: Column) -> Column:
    """quality() with the text that clean_lines() leaves as one more field, ``cleaned``: one pass in Python for both.

    Declared nondeterministic, which it isn't, so that a filter on it doesn't run it a second time.
    """
    return _judge_and_clean.asNondeterministic()(text)


@F.arrow_udf(returnType=T.StringType())
def _clean(texts: pa.Array) -> pa.Array:
    return pa.array(map(cleaned, texts.to_pylist()), pa.string(), size=len(texts))


def clean_lines(text: Column) -> Column:
    """cleaned() as a column."""
    return _clean(text)


def judge_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    judged = docs.select(F.col(doc_id).alias("doc_id"), quality(F.col(text)).alias("_q"))
    q = F.col("_q")
    return judged.select(
        "doc_id", *[q[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed(q).alias("base_failed"), kept(q).alias("kept"), q["lines"].alias("n_lines"), q["bad_lines"].alias("n_bad_lines"), q["bad_chars"].alias("bad_chars"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(ship(spark).read.parquet(f"{sf_dir}/documents.parquet"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS u, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
grams AS (
  SELECT u, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] AS g
  FROM (SELECT u, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
twice AS (SELECT u, i FROM (SELECT *, count(*) OVER (PARTITION BY u, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT u, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY u),
lines AS (SELECT u, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM d),
judged AS (
  SELECT u, line, p, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw, len(regexp_extract_all(line, '{SEPARATOR}')) AS seps,
    len(regexp_extract_all(line, '{NOISE}')) AS noise FROM lines),
marked AS (
  SELECT *, (seps > 0 AND seps * 4 >= len(lw)) OR (noise > 0 AND noise * 4 >= len(lw)) OR (len(lw) >= {LONG_LINE} AND NOT regexp_matches(line, '{SENTENCE}'))
    OR regexp_matches(lower(line), '{"|".join(BOILERPLATE)}') AS bad, row_number() OVER (PARTITION BY u, line ORDER BY p) AS nth
  FROM judged WHERE len(lw) > 0),
by_doc AS (
  SELECT u, count(*) AS n_lines, count(*) FILTER (WHERE nth > 1) AS dup, count(*) FILTER (WHERE bad) AS n_bad,
    coalesce(sum(list_sum(list_transform(lw, lambda x: length(x)))) FILTER (WHERE bad), 0) AS bad_chars
  FROM marked GROUP BY u),
s AS (
  SELECT w.doc_id, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_bad, 0) AS n_bad_lines, CAST(coalesce(bad_chars, 0) AS BIGINT) AS bad_chars
  FROM w LEFT JOIN covered c ON w.u = c.u LEFT JOIN by_doc b ON w.u = b.u)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words) AND 100 * bad_chars <= {MAX_LOSS} * word_chars AS kept FROM s
"""
