"""Operators on whole tables: url filters, near duplicates, mixing, chats, vectors, pages, and the pipeline."""

import hashlib
import html as html_lib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from common import SCHEMA, WORDS, documents, frame
from hypothesis import given, settings
from hypothesis import strategies as st
from test_texts import duck, rows_of

from kinloom.llm import _graph, chat_format, html_text, jaccard_join, quality_rules, source_mix, url_filter, vector_topk


def union(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 240)]
    df = spark.createDataFrame([*pairs, (None, 1), (5, 5)], "src long, dst long")
    got = {r["node"]: r["component"] for r in _graph.connected_components(df).collect()}
    assert got == union([p for p in pairs if p[0] != p[1]])
    assert _graph.connected_components(df.limit(0)).collect() == []


def test_url_rules(spark):
    link = lambda u: f'<link href="{u}" rel=x><link rel="canonical" href="{u}">'
    rows = [
        (1, "http://a.net/x", ""), (2, "HTTP://A.ORG/q#f", link("http://a.net/x")), (3, "http://b.org/fr/1", link("http://a.net/x")), (4, "http://example.net/en/1", ""),
        (5, None, None), (6, "nothing", "<p>"), (7, "http://b.com/p", '<meta http-equiv="refresh" content="0; url=/q">'), (8, "http://b.com/q", link("http://www.example.com/de/")),
        (9, "http://net", ""), (10, "http://x.NET?y", ""), (1, "http://a.net/x", ""), (11, "http://c.com/", link("//d.com/")), (12, "http://d.com/", None),
    ]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, host string, verdict string")
    got = rows_of(url_filter.judge_urls(df), "page_id", "host", "path", "rule", "verdict", "propagated")
    c = duckdb.connect()
    c.execute("create table pages (page_id bigint, url varchar, html varchar)")
    c.executemany("insert into pages values (?, ?, ?)", rows)
    found = c.execute(url_filter.SQL)
    at = [x[0] for x in found.description]
    assert got == Counter(tuple(r[at.index(n)] for n in ("page_id", "host", "path", "rule", "verdict", "propagated")) for r in found.fetchall())
    by = {k[0]: k for k in got}
    assert by[2][3:] == (None, "block", True), "an alias of a blocked url"
    assert by[3][3:] == ("org/fr/", "allow", False), "an explicit allow stands"
    assert by[7][4] == by[8][4] == "block", "over a redirect and a canonical link"
    assert by[12][4] == by[11][4] == "allow" and by[9][3] is None
    assert url_filter.judge_urls(df.limit(0)).collect() == []


def shingle_set(text, n=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def near_copies(seed, n=60):
    """Groups around bases with edits on both sides of the threshold, and a passage that many share."""
    rng = random.Random(seed)
    passage = [rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(14)]
    out, bases = [], []
    for i in range(n):
        if bases and rng.random() < 0.6:
            w = list(rng.choice(bases))
            for _ in range(rng.randint(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = f"z{rng.randint(0, 9)}"
        else:
            w = [f"{rng.choice(WORDS)}{rng.randint(0, 30)}" for _ in range(rng.choice([1, 4, 5, 6, 9, 20, 60, 150]))]
            if rng.random() < 0.7:
                at = rng.randint(0, len(w))
                w[at:at] = passage
            bases.append(w)
        out.append((i, " ".join(w), None, None, 1, 1, "", 1, b""))
    return out


@pytest.mark.parametrize(("seed", "often", "small"), [(1, 64, 32), (3, 3, 2), (5, 2, 3)])
def test_near_duplicates_are_brute_force(spark, monkeypatch, seed, often, small):
    monkeypatch.setattr(jaccard_join, "FREQUENT", often)
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    rows = near_copies(seed) + [(1000 + i, *r[1:]) for i, r in enumerate(documents(seed, 8))]
    sets = {r[0]: shingle_set(r[1]) for r in rows}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    low = union(links)
    got = jaccard_join.jaccard_components(frame(spark, rows))
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == Counter((r[0], len(sets[r[0]]), low.get(r[0], r[0])) for r in rows)


def test_large_groups_are_split_and_linked(spark, monkeypatch):
    """Thousands of near copies and unlike texts under shared signatures: places are cut into tiles, listed pairs stay near the number of members."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(120)]
    passage = [f"p{i}" for i in range(25)]
    rows = []
    for i in range(1500):  # a chain of drifting copies: neighbours are linked, ends are not
        if i % 30 == 0:
            base[rng.randrange(120)] = f"d{i}"
        w = list(base)
        w[rng.randrange(120)] = f"e{i}"
        rows.append((i, " ".join(w), None, None, 1, 1, "", 1, b""))
    for i in range(1500, 2600):
        w = passage + [f"u{rng.randint(0, 9**9)}" for _ in range(rng.choice([3, 60]))]
        rows.append((i, " ".join(w), None, None, 1, 1, "", 1, b""))
    sets = {r[0]: shingle_set(r[1]) for r in rows}
    by = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            by[g].append(i)
    common = Counter((a, b) for ids in by.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    links = [(a, b) for (a, b), c in common.items() if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c)]
    low = union(links)
    monkeypatch.setattr(jaccard_join, "TILE", 200)
    listed, real = [], jaccard_join.materialize

    def watched(df, name):
        out = real(df, name)
        if name == "likely":
            listed.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "materialize", watched)
    got = jaccard_join.jaccard_components(frame(spark, rows))
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == Counter((r[0], len(sets[r[0]]), low.get(r[0], r[0])) for r in rows)
    assert len(links) > 100_000 and sum(listed) < 20_000


def test_failed_links_are_made_up_for(spark, monkeypatch):
    """Shortenings that say too much: trees fail, and all pairs are then verified."""
    monkeypatch.setattr(jaccard_join, "SHORT_BITS", 3)
    rows = near_copies(7, 80)
    sets = {r[0]: shingle_set(r[1]) for r in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    low = union(links)
    got = jaccard_join.jaccard_components(frame(spark, rows))
    assert rows_of(got, "doc_id", "component_id") == Counter((r[0], low.get(r[0], r[0])) for r in rows)


def test_two_sets_of_one_name(spark, monkeypatch):
    """Names that collide are drawn anew."""
    monkeypatch.setattr(jaccard_join, "NAME_BITS", 2)
    rows = [(i, f"{i // 2} b c d e f", None, None, 1, 1, "", 1, b"") for i in range(8)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(frame(spark, rows)).collect()}
    assert got == {i: i // 2 * 2 for i in range(8)}


def test_signatures_meet_for_all_linked_pairs():
    """The pigeonhole holds for pairs at the threshold, with any shingles called frequent."""
    rng = np.random.default_rng(5)
    bands = jaccard_join.Bands()
    for _ in range(400):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        extra = rng.integers(0, 2**63, 40).astype(np.uint64)
        drop = int(rng.integers(0, len(a) // 4 + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[drop:], extra[: int(rng.integers(0, len(a) // 4 + 1))]]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 75 * (len(a) + len(b) - both):
            continue
        often = np.unique(rng.permutation(np.concatenate([a, b]))[: int(rng.integers(0, len(a)))])
        counts = rng.integers(64, 999, len(often))
        x, y = (set(jaccard_join.signatures(s, 75, often, counts, bands).tolist()) for s in (a, b))
        assert x & y


def test_near_duplicates_of_nothing(spark):
    assert jaccard_join.jaccard_components(frame(spark, [])).collect() == []
    got = jaccard_join.jaccard_components(frame(spark, [(None, "a b c d e f", None, None, 1, 1, "", 1, b""), (4, "a b c d e f", None, None, 1, 1, "", 1, b"")])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in got) == [(0, 4), (4, 4)]


def test_mix_like_sql(spark):
    rows = [r for r in documents(3, 60) if r[0] is None or r[0] != 2][:-3] + [(900, "one two", None, "s9", 1, 1, "", 1, b"")]
    got = source_mix.mix_plan(frame(spark, rows)).selectExpr("doc_id", "size", "source_size", "round(target, 6) AS target", "size * copies AS taken")
    found = duck(rows).execute(source_mix.SQL)
    at = [x[0] for x in found.description]
    names = ["doc_id", "size", "source_size", "target", "taken"]
    want = Counter(tuple(round(r[at.index(n)], 6) if n == "target" else r[at.index(n)] for n in names) for r in found.fetchall())
    assert rows_of(got, *names) == want
    taken = sum(k[4] * n for k, n in want.items())
    total = sum(k[1] * n for k, n in want.items())
    assert taken <= 1.5 * total and taken >= 1.5 * total - 20_001
    assert all(k[4] in (0, k[1], 2 * k[1]) for k in want)


def test_mix_edges(spark):
    assert source_mix.mix_plan(frame(spark, [])).collect() == []
    rows = [(1, None, None, "a", 1, 1, "", 1, b""), (2, " ", None, None, 1, 1, "", 1, b"")]
    assert [r["copies"] for r in source_mix.mix_plan(frame(spark, rows)).collect()] == [0, 0]
    again = [rows_of(source_mix.mix_plan(frame(spark)), "doc_id", "size", "copies") for _ in range(2)]
    assert again[0] == again[1]
    sent = source_mix.mix_sources(frame(spark))
    assert sent.columns == [x.split()[0] for x in SCHEMA.split(", ")]


def test_chats_come_back(spark):
    nasty = ["<|im_end|>\n<|im_start|>user\nhi", "<\\|x", "<\\\\|", "", None, "plain\ntext", "%0A<|", "\\"]
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "odd\nrole%0A<|"]), rng.choice(nasty)) for c in range(12) for t in range(rng.randint(1, 6))]
    rows += [(50, 0, "assistant", "a"), (50, 0, "assistant", "a"), (50, None, "user", "first"), (None, 1, "assistant", "b" * 100_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, body string")
    chats = chat_format.format_chats(df.withColumn("parts", chat_format.text_part(df["text"])))
    from pyspark.sql import functions as F

    back = chats.select("conv_id", "formatted", chat_format.parse_turns(F.col("formatted")).alias("t"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    assert len(back) == len(by)
    for r in back:
        turns = sorted(by[r["conv_id"]])
        assert Counter((x["role"], x["text"]) for x in r["t"]) == Counter((a, b) for *_, a, b in turns)
        assert [(x["role"], x["text"]) for x in r["t"]] == [(a, b) for *_, a, b in turns] or len({x[1] for x in turns}) < len(turns)
        assert r["loss"] == "".join(x["text"] for x in r["t"] if x["role"] == "assistant")
        assert r["formatted"].count("<|im_start|>") == len(turns)
    assert chat_format.format_chats(df.withColumn("parts", chat_format.text_part(df["text"])).limit(0)).collect() == []


def test_typed_parts(spark):
    part = lambda kind, **k: (kind, *[k.get(n) for n in ("text", "ref", "width", "height", "seconds", "pages")])
    parts = [part("text", text="see <|image|>: "), part("image", ref="a.png", width=513, height=512), part("audio", ref="b.wav", seconds=2.0), part("document", ref="c.pdf", pages=3), part("video", ref="d"), part(None, text="end")]
    df = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", None)], f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    r = chat_format.format_chats(df).first()
    assert r["formatted"] == "<|im_start|>assistant\nsee <\\|image|>: <|image|><|audio|><|document|><|video|>end<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert [(a["turn"], a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(0, "image", "a.png", 85 + 340), (0, "audio", "b.wav", 50), (0, "document", "c.pdf", 1920), (0, "video", "d", 85)]
    assert r["expanded_tokens"] == 425 + 50 + 1920 + 85


@pytest.mark.parametrize("spread", [2, 200, 40_000])
def test_top_k_is_brute_force(spark, spread):
    rng = random.Random(spread)
    rows = [(i, [rng.randint(-spread, spread) / 64 for _ in range(6)]) for i in range(400)]
    rows += [(i, [1.0] * 6) for i in range(400, 700)] + [(700, None), (701, [float("nan")] * 6), (702, [None] * 6), (750, [float("inf")] + [0.0] * 5), (800, [1.0, 2.0]), (801, [2.0, 2.0]), (850, []), (50, rows[50][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, ids int").repartition(3)
    v = df.select("vec_id", vector_topk.quantise(df["embedding"]).alias("vector")).where("vector is not null")
    got = defaultdict(list)
    for r in vector_topk.top_k(v, v.where("vec_id % 50 = 0")).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    good = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in e]) for i, e in rows if e is not None and all(x is not None and np.isfinite(x) for x in e)]
    want = {}
    for q, e in {(i, tuple(e)) for i, e in good if i % 50 == 0}:
        scores = sorted((-sum(a * b for a, b in zip(e, f, strict=True)), i) for i, f in good if i != q and len(f) == len(e))
        if scores:
            want[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(scores[:5])]
    assert {k: sorted(x) for k, x in got.items()} == want
    assert vector_topk.top_k(v.limit(0), v.limit(0)).collect() == []


def test_bounds_stop_early():
    rng = np.random.default_rng(2)
    q, c = rng.integers(-90, 90, (20, 64)), rng.integers(-90, 90, (900, 64))
    qi, ci, score = vector_topk.search_block(np.arange(20), q, np.arange(1000, 1900), c, 5)
    full = q @ c.T
    for i in range(20):
        order = np.lexsort((np.arange(900), -full[i]))[:5]
        assert ci[qi == i].tolist() == order.tolist() and score[qi == i].tolist() == full[i][order].tolist()


LONGS = st.integers(-(2**63), 2**63 - 1) | st.integers(-300, 300) | st.sampled_from([-(2**63), 2**63 - 1, 0])


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 4).flatmap(lambda d: st.tuples(st.lists(st.lists(LONGS, min_size=d, max_size=d), min_size=1, max_size=4), st.lists(st.lists(LONGS, min_size=d, max_size=d), min_size=1, max_size=9))))
def test_any_integers_are_exact_or_an_error(both):
    q, c = both
    want, over = [], False
    for i, a in enumerate(q):
        best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), 100 + j) for j, b in enumerate(c))[:2]
        over |= any(abs(s) >= 2**63 for s, _ in best)
        want += [(i, j - 100, -s) for s, j in best]
    run = lambda: vector_topk.search_block(np.arange(len(q)), np.array(q, np.int64), np.arange(100, 100 + len(c)), np.array(c, np.int64), 2)
    if over:
        with pytest.raises(OverflowError):
            run()
    else:
        qi, ci, score = run()
        assert list(zip(qi.tolist(), ci.tolist(), score.tolist(), strict=True)) == want


@pytest.mark.parametrize("value", [1e300, -1e17, 3.6e16])
def test_components_beyond_64_bits_are_an_error(spark, value):
    df = spark.createDataFrame([(50, [value, 1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    v = df.select("vec_id", vector_topk.quantise(df["embedding"]).alias("vector"))
    if value == -1e17 or value > 2**63 / 256:
        with pytest.raises(Exception, match="beyond 64 bits"):
            v.collect()
    else:
        assert v.count() == 2


def test_pages(spark):
    menu = "<nav><ul><li>Home<li>News</ul></nav>"
    article = "<article><header><h1>Title &amp; more</h1></header><p>One <b>bold\n  word</b>.<p>Two<br>lines.<div class='share'>Tweet</div></article>"
    page = lambda body, extra="": f"<!DOCTYPE html><html><head><title>t</title><script>if (a<b) x('</p>')</script></head><body>{menu}{body}<div id='comments'><p>Nice!</div>{extra}<footer>&copy; x</footer></body></html>"
    bare = lambda own: page(f"<div>Site name</div><p>{own}</p><div>All topics</div>")
    rows = [(1, "http://a/1", page(article)), (2, "http://b/x/1", bare("First.")), (3, "http://b/x/2", bare("Second.")), (4, "http://b/y", bare("Third.")), (5, None, None), (6, "x", ""), (7, "http://c/", bare("Alone.")), (1, "http://a/1", page(article))]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, text string, n int")
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert got == {1: "Title & more\nOne bold word.\nTwo lines.", 2: "First.", 3: "Second.", 4: "Third.", 5: "", 6: "", 7: "Site name\nAlone.\nAll topics"}
    assert html_text.extract(df).count() == len(rows)
    assert html_text.extract(df.limit(0)).collect() == []
    for broken in ("<", "<p", "<p title='x>y", "<!--", "<script>x", "</div></p>", "<![CDATA[a", "&#xZZ; &", "<p>" * 3000 + "deep"):
        assert isinstance(html_text.page_lines(broken)[0], list)


def bare_page(*lines):
    return "<html><body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body></html>"


def test_pages_of_a_large_host_meet_their_nearest_url(spark, monkeypatch):
    """Each pair of siblings shares a notice of its own; ranges of a few pages must not part them."""
    rows = [(i, f"http://h/{i // 2:04d}/{i % 2}", bare_page(f"Notice of section {i // 2}", f"Own text number {i}.")) for i in range(1400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size in (7, 100, 10_000):
        monkeypatch.setattr(html_text, "RANGE", size, raising=False)
        got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
        assert got == {i: f"Own text number {i}." for i in range(1400)}


def test_copies_of_pages_without_an_article_keep_their_text(spark, monkeypatch):
    """Copies and variants of one url lose what they share with other pages, not what they share with each other."""
    long = [f"Sentence {k} of the story that all of these copies tell at length." for k in range(12)]
    story = lambda i: bare_page("All topics", *long, f"Page {i}")
    rows = [(i, f"http://h/a?utm={i}", story(i if i % 2 else 0)) for i in range(300)]
    rows += [(1000, "http://h/b", bare_page("All topics", "Another text.")), (1001, "http://only/x", story(1)), (1002, "http://only/x?page=2", story(1)), (1000, "http://h/b", bare_page("All topics", "Another text."))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: "\n".join([*long, f"Page {i if i % 2 else 0}"]) for i in range(300)} | {1000: "Another text."}
    want |= {i: "\n".join(["All topics", *long, "Page 1"]) for i in (1001, 1002)}
    for size in (7, 10_000):
        monkeypatch.setattr(html_text, "RANGE", size, raising=False)
        found = html_text.extract(df).collect()
        assert len(found) == len(rows) and {r["page_id"]: r["text"] for r in found} == want


def test_differencing_is_brute_force(spark, monkeypatch):
    """200 pages without a marked article: what goes is what the nearest url that isn't a copy has too, whatever the elements are called."""
    rng = random.Random(21)
    shared = {h: [f"Line {k} of host {h}" for k in range(12)] for h in "abc"}
    rows, texts = [], {}
    for i in range(200):
        h = rng.choice("abc")
        lines = [x for x in shared[h] if rng.random() < 0.7]
        own = [f"Text {i} number {k} that no other page of this host has in it." for k in range(rng.randint(2, 5))]
        at = rng.randint(0, len(lines))
        texts[i] = (h, f"/{rng.choice(['x', 'y/z', 'yy'])}/{i:03d}", lines[:at] + own + lines[at:])
        rows.append((i, f"http://{h}{texts[i][1]}", bare_page(*texts[i][2])))
    want = {}
    for i, (h, path, lines) in texts.items():
        side = lambda ok, best: best(((p, j) for j, (g, p, _) in texts.items() if g == h and ok((p, j))), default=None)  # noqa: B023, E731
        before, after = side(lambda x: x < (path, i), max), side(lambda x: x > (path, i), min)  # noqa: B023
        common = lambda x: next((k for k, (a, b) in enumerate(zip(path, x[0], strict=False)) if a != b), min(len(path), len(x[0])))  # noqa: B023, E731
        near = after if after and (not before or common(after) > common(before)) else before
        gone = set(texts[near[1]][2]) if near else set()
        want[i] = "\n".join(x for x in lines if x not in gone)
    assert sum(x.count("\n") + 1 for x in want.values()) < 0.6 * sum(len(x[2]) for x in texts.values()), "differencing decides on most lines"
    monkeypatch.setattr(html_text, "RANGE", 9)
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_shared_lines_outside_paragraphs_of_articles_go(spark):
    """Differencing decides in marked articles too, but for their prose."""
    page = lambda own: f"<main><div>You are reading The Daily</div><h1>Report</h1><p>A passage that all quote.</p><p>{own}</p><div>{own} aside</div><div>Rate this page</div></main>"
    rows = [(i, f"http://h/{i}", page(f"Own text number {i} of this page, of some length.")) for i in range(5)] + [(9, "http://h/9", "<main><p>A passage that all quote.</p></main>"), (10, "http://h/91", None)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    own = lambda i: f"Own text number {i} of this page, of some length."
    assert got == {i: f"Report\nA passage that all quote.\n{own(i)}\n{own(i)} aside" for i in range(5)} | {9: "A passage that all quote.", 10: ""}


def test_common_lines_is_longest():
    rng = random.Random(6)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 10))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        kept = html_text.common_lines(a, b)
        assert len(kept) == t[-1][-1]
        rest = iter(b)
        assert all(a[i] in rest for i in sorted(kept))


def test_plain_pages_match_a_plain_parser(spark):
    rng = random.Random(8)
    for _ in range(20):
        paragraphs = [" ".join(rng.choice(WORDS) + rng.choice(["", " &amp;", " <i>x</i>"]) for _ in range(8)) for _ in range(4)]
        lines, marked = html_text.page_lines("<main>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</main><aside>no</aside>")
        assert marked and lines == [" ".join(html_lib.unescape(p.replace("<i>", "").replace("</i>", "")).split()) for p in paragraphs]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    base = [r for r in documents(9, 60) if r[1] and len(r[1]) < 5000]
    rows = [(i, r[1], "en" if i % 2 else "fr", f"s{i % 3}", len(r[1]), 7, "k", None, b"t") for i, r in enumerate(base)]
    rows += [(500 + i, r[1], *r[2:]) for i, r in enumerate(rows[:10])] + [(600, None, "en", None, 0, 7, "k", None, b"t"), rows[3]]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = {}
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        stages[name] = out.collect()
        docs = spark.createDataFrame(stages[name], docs.schema)
    language_kept = stages["language_id"]
    # Each stage between the first and the last against a plain version.
    given = {r["doc_id"]: r for r in language_kept}
    fine = {}
    for i, r in given.items():
        w = (r["text"] or "").encode().split()
        twice = {g for g, n in Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2)).items() if n > 1}
        hit = {k + d for k in range(len(w) - 2) if tuple(w[k : k + 3]) in twice for d in range(3)}
        bad = sum(len("".join(x.split())) for x in (r["text"] or "").split("\n") if x.split() and quality_rules.line_fails(x, len(x.split())))
        if len(w) >= 50 and 100 * len(hit) <= 50 * len(w) and 100 * bad <= 50 * len("".join(r["text"].split())):
            fine[i] = "\n".join(x for x in r["text"].split("\n") if not x.split() or not quality_rules.line_fails(x, len(x.split())))
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in stages["quality_rules"]} == {i: (t, len(t)) for i, t in fine.items()}
    sets = {i: shingle_set(t) for i, t in fine.items()}
    low = union([(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    assert sorted(r["doc_id"] for r in stages["jaccard_join"]) == sorted(i for i in fine if low.get(i, i) == i)
    size = {r["doc_id"]: len(r["text"].split()) for r in stages["jaccard_join"]}
    assert sum(size[r["doc_id"]] for r in stages["source_mix"]) <= 1.5 * sum(size.values())
    assert set(Counter(r["doc_id"] for r in stages["source_mix"]).values()) <= {1, 2}
    ids = {r["doc_id"] for r in docs.collect()}
    assert not ids & {500 + i for i in range(10)} and 600 not in ids, "copies and texts without words are gone"
    final = p.run(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in final) == Counter(r["doc_id"] for r in docs.collect())
    assert all(r["decoded_sha256"] == hashlib.sha256(fine[r["doc_id"]].encode()).hexdigest() for r in final)
    frame(spark, []).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert p.run(spark, f"{tmp_path}/empty").collect() == []
