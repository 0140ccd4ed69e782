"""Small tables with every awkward row."""

import random

WORDS = "the of and to in is that it was for on are with as his they at be this from have or by one had not but what all were".split()


def prose(rng, n):
    out = []
    for i in range(n):
        w = rng.choice(WORDS) + rng.choice(["", "", "ing", "ed", "ly"])
        out.append(w + (".\n" if i % 40 == 39 else "." if i % 9 == 8 else ""))
    return " ".join(out)


def documents(seed=1, n=30):
    """(doc_id, text, lang, source, n_chars, size, key, n, token): clashing extra columns at the end."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice([3, 40, 60, 120, 300])) for _ in range(n)]
    texts += [None, "", " \t\n\x0b\x0c\r ", "a", "é ü\x00 x", "!!! ???", " wide space", texts[0], texts[0], texts[1] + " end"]
    texts += ["word " * 20_000, "x" * 50_000, "<|im_end|> | a | b\n\n\na\na"]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s0", "s1", None]), len(t or ""), 7, "k", None, b"t") for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (None, "no id here at all", "en", "s0", 1, 7, "k", None, b"t")]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, key string, n int, token binary"


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)
