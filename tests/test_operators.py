"""Operators without SQL counterpart against plain versions, and invariants."""

import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinloom import sources, store, streaming
from kinloom.functions import hashing, lexical
from kinloom.operators import fingerprint, graphs, neighbours, regions, semantic, sequence, syntax
from kinloom.plans import queries


def plain_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
    return t[0][0]


def test_lcs_and_edits():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        assert sequence.lcs_length(a, b) == plain_lcs(a, b)
        script = sequence.edit_script(a, b)
        kinds = [k for k, *_ in script]
        assert len(a) - kinds.count("DELETED") - kinds.count("MODIFIED") == plain_lcs(a, b)
        assert len(b) - kinds.count("INSERTED") - kinds.count("MODIFIED") == plain_lcs(a, b)
    assert sequence.lcs_similarity([], []) == 1.0


def test_tree_distance():
    a = [(0, "a"), (1, "b"), (0, "r")]
    assert sequence.tree_distance(a, a) == 0
    assert sequence.tree_distance(a, [(0, "a"), (0, "r")]) == 1
    assert sequence.tree_distance(a, []) == 3
    assert sequence.tree_distance([(0, "x")], [(0, "y")]) == 1


def test_lexer(spark):
    cases = {
        'int x = 10L; // c\n"a\\"b" \'c\'': "int ID = NUM ID ; STR CHAR",
        "a >>> b": "ID >> > ID",
        "1e 0x1F .5e-3 1.2.3": "NUM ID NUM NUM NUM NUM",
        '"open': "STR",
        "/* open": "",
        "true null var": "ID ID ID",
        "": "",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "text string")
    found = {r["text"]: r["t"] for r in rows.select("text", F.array_join(lexical.baseline_tokens(F.col("text")), " ").alias("t")).collect()}
    assert found == cases
    kept = spark.createDataFrame([('a /* x */ "b // c" \n d // e',)], "text string").select(lexical.exact_key(F.col("text"))).first()[0]
    assert kept == 'a"b // c"d'


def test_winnow_guarantee(spark):
    """A shared run of w + k - 1 tokens shares a fingerprint; both forms of the selection agree."""
    rng = random.Random(2)
    k, w = 4, 3
    shared = [str(rng.random()) for _ in range(k + w - 1)]
    docs = [(i, [str(rng.random()) for _ in range(rng.randint(0, 9))] + shared + [str(rng.random()) for _ in range(5)]) for i in range(20)]
    docs += [(100, []), (101, ["a"] * 3), (102, ["a"] * 30), (103, ["a"] * 4)]
    df = spark.createDataFrame(docs, "doc_id long, t array<string>")
    grams = fingerprint.kgrams(fingerprint.explode_tokens(df, F.col("t")), k)
    got = {(r["doc_id"], r["hash"], r["pos"]) for r in fingerprint.winnow(grams, w).collect()}
    by = {}
    for r in grams.collect():
        by.setdefault(r["doc_id"], []).append((r["pos"], r["hash"]))
    want = {(d, h, p) for d, g in by.items() for h, p in hashing.winnow(np.array([x for _, x in sorted(g)], np.uint64), w)}
    assert got == want
    sets = {d: {h for e, h, _ in got if e == d} for d in range(20)}
    assert all(sets[a] & sets[b] for a in range(20) for b in range(20))
    pairs = fingerprint.fingerprint_pairs(fingerprint.winnow(grams, w)).collect()
    for r in pairs:
        a, b = ({h for e, h, _ in got if e == r[x]} for x in ("left_id", "right_id"))
        assert abs(r["jaccard"] - len(a & b) / len(a | b)) < 1e-12


def test_wrap_around_hashes(spark):
    assert hashing.fnv("") == hashing.TOKEN_OFFSET
    grams = hashing.rolling(np.array([1, 2, 3], np.uint64), 2)
    assert [int(x) for x in grams] == [(hashing.BASE + 2) % 2**64, (2 * hashing.BASE + 3) % 2**64]
    assert hashing.winnow(np.array([5, 5, 5], np.uint64), 2) == [(5, 1), (5, 2)]
    assert hashing.winnow(np.zeros(0, np.uint64), 2) == [] and hashing.winnow(np.array([1], np.uint64), 0) == []
    rows = spark.createDataFrame([(["a", "b", "c"],), ([],), (None,)], "t array<string>")
    assert [len(r[0]) for r in rows.select(hashing.fingerprints_column(F.col("t"), 2, 5)).collect()] == [1, 0, 0]


def test_nearest_is_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [float(rng.randint(0, 3)) for _ in range(3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "item_id long, v array<double>")
    got = {}
    for r in neighbours.nearest(df.where("item_id < 10"), df, 4).collect():
        got.setdefault(r["query_id"], []).append((r["place"], r["item_id"]))
    for q in range(10):
        order = sorted((round(sum((a - b) ** 2 for a, b in zip(rows[q][1], v, strict=True)) ** 0.5, 9), i) for i, v in rows if i != q)
        assert [i for _, i in sorted(got[q])] == [i for _, i in order[:4]]


def test_graphs():
    assert graphs.loops([("a", "b"), ("b", "a"), ("c", "c"), ("a", "c")]) == 2
    assert graphs.greedy_matching([(0.2, "a", "x"), (0.1, "a", "y"), (0.3, "b", "x")]) == [("a", "y", 0.1), ("b", "x", 0.3)]
    same = {("a", "a"): 0.0, ("b", "b"): 0.0, ("a", "b"): 0.6, ("b", "a"): 0.6}
    assert graphs.common_subgraph(same, {("a", "b")}, {("a", "b")}, (2, 2)) == 0.0
    assert graphs.common_subgraph({}, set(), set(), (0, 0)) == 0.0
    node = lambda label, out=(), into=(): {"label": label, "value": 0, "wl": 1, "kind": "STATEMENT", "op": "CALL", "out": list(out), "in": list(into)}
    left = {1: node("A", [2]), 2: node("B", (), [1])}
    assert graphs.grow_regions([(1, 1)], left, left) == [[(1, 1, 0.8), (2, 2, 0.8)]]
    assert graphs.grow_regions([(1, 1)], {1: node("A")}, {1: node("A")}) == []


def test_selection(spark):
    rows = [(1, 1, "T1", "METHOD", "METHOD", 1, 10, 1, 10), (1, 2, "T2", "METHOD", "METHOD", 1, 9, 2, 10), (1, 3, "T3", "CONTROL_REGION", "CONTROL_REGION", 8, 8, 3, 3), (1, 4, "T3", "METHOD", "METHOD", 20, 30, 1, 10), (1, 5, "NON_CLONE", "METHOD", "METHOD", 1, 1, 1, 1)]
    df = spark.createDataFrame(rows, "pair_id long, place int, type string, left_kind string, right_kind string, left_begin int, left_end int, right_begin int, right_end int")
    got = {r["place"]: r["selected"] for r in regions.select_regions(df).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True}


def test_equivalence():
    x, y = ("param", 0), ("param", 1)
    assert semantic.equivalence(("*", ("+", x, y), ("-", x, y)), ("-", ("*", x, x), ("*", y, y))) == "EQUIVALENT"
    assert semantic.equivalence(("+", x, ("const", 1)), x) == "DIFFERENT"
    assert semantic.equivalence(("/", x, y), ("/", x, y)) == "UNKNOWN"
    assert semantic.equivalence(("call", "f", y), ("+", y, y), {"f": ("+", x, x)}) == "EQUIVALENT"
    assert semantic.equivalence(("call", "f", x), x, {"f": ("call", "f", x)}) == "UNKNOWN"
    assert semantic.sampled_equivalence(("/", x, ("const", 2)), ("/", x, ("const", 2)), 1) == "LIKELY"
    assert semantic.evaluate(("%", ("const", -7), ("const", 3)), [0]) == -1
    assert semantic.value_hash(("+", x, y)) == semantic.value_hash(("+", y, x)) != semantic.value_hash(("-", x, y))
    assert semantic.region_equivalence({1: x}, {2: x}, {1: 2}) == "EQUIVALENT" and semantic.region_equivalence({1: x}, {}, {}) == "UNKNOWN"


def test_parser(spark):
    text = "class A { int f(int x) { if (x > 0) { return 1; } else return g(x); } int f(String s) { for (;;) { h(); } } int y = 3; }"
    nodes = syntax.flatten(text)
    assert [n["name"] for n in nodes if n["label"] == "MethodDeclaration"] == ["f", "f"]
    assert {"IfStmt", "ReturnStmt", "ForStmt", "FieldDeclaration", "ClassOrInterfaceDeclaration"} <= {n["label"] for n in nodes}
    assert nodes[0]["subtree_size"] == len(nodes)
    for broken in ("", "}", "class", "class A { void f() { if (", "((("):
        assert syntax.flatten(broken)
    df = spark.createDataFrame([(1, text)], "file_id int, text string")
    got = syntax.methods(syntax.ast_nodes(df)).select("method_id").collect()
    assert sorted(r[0] for r in got) == ["f#0", "f#1"]
    calls = syntax.external_calls(df.select("file_id", lexical.raw_tokens(F.col("text")).alias("tokens")), syntax.ast_nodes(df))
    assert sorted(r["call"] for r in calls.collect()) == ["g", "h"]


def test_trees():
    rows = [{"depth": 0, "label": "r"}, {"depth": 1, "label": "a"}, {"depth": 2, "label": "x"}, {"depth": 2, "label": "y"}, {"depth": 1, "label": "b"}]
    assert syntax.postorder(rows) == [(0, "x"), (1, "y"), (0, "a"), (3, "b"), (0, "r")]
    leaf = lambda x: hashing.subtree(x, [])
    a = hashing.subtree("a", [leaf("x"), leaf("y")])
    assert syntax.subtree_hashes(rows) == {a, hashing.subtree("r", [a, leaf("b")])}
    assert syntax.postorder([]) == [] and syntax.subtree_hashes([]) == set()


def test_signals(spark):
    from kinloom.plans import signals

    same = "import a.B; class A { int x = 1; int f(int a) { if (a > 0) { return g(a); } return 1; } }"
    other = "class Z { void q() { for (;;) { h(); } } void r() { try { k(); } finally { m(); } } }"
    files = spark.createDataFrame([(1, same), (2, same), (3, other), (4, "")], "file_id int, text string")
    wanted = spark.createDataFrame([(1, 1, 2), (2, 1, 3), (3, 4, 4)], "pair_id int, file_a int, file_b int")
    got = {r["pair_id"]: r for r in signals.five_signals(files, wanted).collect()}
    assert [got[1][f"s{i}"] for i in range(1, 6)] == [1.0] * 5 and got[1]["overall"] == 1.0
    assert got[2]["s5"] == 0.0 and got[2]["overall"] < 0.6
    assert got[3]["s5"] == -1.0


def test_batch_workflow(spark, tmp_path):
    (tmp_path / "m.csv").write_text("pair_id,left_path,right_path\np1,a,b\n\np2,c\np3,d,e\n")
    manifest = sources.read_manifest(spark, str(tmp_path / "m.csv"))
    assert sorted(r[0] for r in manifest.collect()) == ["p1", "p3"]
    out = str(tmp_path / "out")
    sources.append_results(manifest.where("pair_id = 'p1'"), out)
    (tmp_path / "out" / "cut.json").write_text('{"pair_id": "p9", "left_')
    done = sources.read_results(spark, out, sources.MANIFEST)
    assert [r["pair_id"] for r in sources.remaining(manifest, done).collect()] == ["p3"]
    sources.export_csv(manifest, str(tmp_path / "csv"))
    (tmp_path / "A.java").write_text("class A {}")
    assert sources.read_sources(spark, str(tmp_path / "A.java")).first()["language"] == "JAVA"


def test_raw_records(spark):
    raw = "array<struct<channel:string,value:string>>"
    schema = f"classes array<struct<raw:{raw},methods:array<struct<raw:{raw},blocks:array<struct<raw:{raw},instructions:array<struct<raw:{raw}>>>>>>>>"
    r = lambda x: [(x, x)]
    df = spark.createDataFrame([([(r("c"), [(r("m"), [(r("b"), [(r("i"),), (r("j"),)])])])],)], schema)
    assert [x["channel"] for x in sources.raw_records(df).orderBy("path").collect()] == ["c", "m", "b", "i", "j"]
    assert sources.record_json(sources.raw_records(df), "t", "1").count() == 5


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("pair_id,left_path,right_path\np1,a,b\np1,a,b\np2,c,d\n")
    q = streaming.score_stream(streaming.new_pairs(spark, str(folder)), lambda b: b.withColumn("score", F.lit(1)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(r["pair_id"] for r in spark.read.json(str(tmp_path / "out")).collect()) == ["p1", "p2"]


@pytest.mark.parametrize("shares", [[1.0, 1.0, 1.0], [0.5, 0.25, 0.25], [0.999, 0.001]])
def test_percents_add_up(spark, shares):
    df = spark.createDataFrame([(1, f"t{i}", s) for i, s in enumerate(shares)], "pair_id int, type string, share double")
    assert sum(r["percent"] for r in regions.largest_remainder(df).collect()) == 100


def test_equal_key_candidates_of_a_key_that_many_share(spark):
    rows = [(i, f"{i}:1", "hot") for i in range(1100)] + [(5, "5:2", "hot"), (1, "1:3", "b"), (2, "2:3", "b"), (3, "3:3", "c"), (4, "4:1", None)]
    rows += [(1, "1:3", "d"), (2, "2:3", "d"), (2, "2:3", "d")]
    df = spark.createDataFrame(rows, "file_id long, region_id string, v string")
    found = regions.equal_key_candidates(df, "X", F.col("v"))
    assert found.count() == 1100 * 1099 // 2 + 1099 + 1
    assert {(r["left_region"], r["right_region"]) for r in regions.equal_key_candidates(df, "X", F.col("v"), most=1000).collect()} == {("1:3", "2:3")}


@pytest.mark.parametrize("text", ["don't " + "x" * 1_000_000, '"' + "\\\\a" * 500_000, "'" + "\\" * 1_000_001, "/*" + " * a" * 300_000, "/*" + "*" * 1_000_000, '"' * 1_000_001])
def test_lexers_take_a_megabyte_of_anything(spark, text):
    from kinloom.functions import lexical

    df = spark.createDataFrame([(text,)], "t string").repartition(1)
    r = df.select(F.size(lexical.baseline_tokens(F.col("t"))).alias("a"), F.size(lexical.t2_tokens(F.col("t"))).alias("b"), F.length(lexical.exact_key(F.col("t"))).alias("c")).first()
    if text.startswith("don"):
        assert r["a"] == r["b"] == 2 and r["c"] == len(text)
    elif text.startswith("/*"):
        assert r["a"] == r["b"] == r["c"] == 0
    else:
        assert r["c"] == len(text) and r["a"] == r["b"] >= 1


def test_possessive_patterns_mean_the_same(spark):
    import random

    from kinloom.functions import lexical

    rng = random.Random(3)
    texts = ["".join(rng.choice("\"'\\/*\nab1 .=") for _ in range(rng.randint(0, 30))) for _ in range(600)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = lambda p: F.regexp_extract_all("t", F.lit(p), F.lit(1))
    for a, b in ((lexical.TOKEN, lexical.LONG_TOKEN), (lexical.TOKEN_T2, lexical.LONG_TOKEN_T2)):
        assert df.where(~found(a).eqNullSafe(found(b))).count() == 0
    assert df.where(F.regexp_replace("t", lexical.STRIP, "$1") != F.regexp_replace("t", lexical.LONG_STRIP, "$1")).count() == 0


def test_generics_of_any_depth_go(spark):
    from kinloom.functions import lexical

    rows = [("f(" + "A<" * n + "B" + ">" * n + " x, int y)",) for n in (0, 1, 3, 7, 40)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(lexical.erased_signature(F.col("s"))).collect()]
    assert got == ["f(b,int)"] + ["f(a,int)"] * 4


def test_equivalence_of_awkward_expressions(spark):
    from kinloom.operators import semantic

    deep = '["+", ' * 5000 + '["const", 1]' + ', ["const", 1]]' * 5000
    half = lambda i: f'["/", ["param", {i}], ["const", 2]]'
    df = spark.createDataFrame([(1, None, half(0)), (2, deep, deep), (3, half(4), half(0)), (4, half(4), half(4))], "i int, a string, b string")
    got = {r["i"]: r["v"] for r in df.select("i", semantic.equivalence_column(F.col("a"), F.col("b")).alias("v")).collect()}
    assert got[1] is None and tuple(got[2]) == ("UNKNOWN", "UNSUPPORTED")
    assert got[3]["sampling"] == "DIFFERENT" and got[4]["proof"] in ("EQUIVALENT", "UNKNOWN") and got[4]["sampling"] in (None, "LIKELY")


def test_source_scans_are_all_pairs(spark):
    """Equi-joins against every pair of regions looked at."""
    rng = random.Random(5)
    rows = []
    for pair in range(12):
        for side in ("LEFT", "RIGHT"):
            for r in range(rng.randint(0, 7)):
                take = lambda alphabet, most: [rng.choice(alphabet) for _ in range(rng.randint(0, most))]
                rows.append((pair, side, f"{side[0]}{r}", rng.choice(["FILE", "METHOD", "METHOD"]), take("ab", 2), take("xyz", 2 if r % 2 else 4) if r else None, take("stuv", 5), "clash"))
    rows += rows[:2] + [(99, "LEFT", "La", "METHOD", ["a"], ["x", "y", "x"], ["s"], "clash"), (99, "RIGHT", "Ra", "METHOD", ["b"], ["x", "y", "x"], ["t"], "clash")]
    df = spark.createDataFrame(rows, "pair_id long, side string, region_id string, kind string, t1 array<string>, t2 array<string>, stmts array<string>, channel string")
    want = set()
    for p, side, a, ka, t1, t2, st, _ in rows:
        for q, other, b, kb, u1, u2, su, _ in rows:
            if p != q or side != "LEFT" or other != "RIGHT" or (ka == "FILE") != (kb == "FILE"):
                continue
            t2_, u2_ = t2 or [], u2 or []
            if t1 and t1 == u1:
                want.add((p, a, b, "EXACT_TEXT_SCAN", 1.0))
            if t2_ and t2_ == u2_:
                want.add((p, a, b, "NORMALIZED_AST_SCAN", 1.0))
            s = len(set(t2_) & set(u2_)) / len(set(t2_) | set(u2_)) if t2_ or u2_ else 1.0
            if s >= 0.5:
                want.add((p, a, b, "NORMALIZED_TOKEN_OVERLAP_SCAN", round(s, 6)))
            s = plain_lcs(st, su) / max(len(st), len(su)) if st or su else 1.0
            if s >= 0.5:
                want.add((p, a, b, "STATEMENT_DIFF_SCAN", round(s, 6)))
    got = [(r["pair_id"], r["left_region"], r["right_region"], r["channel"], round(r["score"], 6)) for r in regions.source_scans(df).collect()]
    assert len(got) == len(set(got))
    assert not set(got) ^ want, (sorted(set(got) - want)[:3], sorted(want - set(got))[:3])
    assert {x[3] for x in want} == set(regions.SOURCE_CHANNELS)
    assert regions.source_scans(df.limit(0)).collect() == []


def test_containment_without_rows_for_words_or_lesser_pairs(spark, tmp_path):
    """All pairs from 0.3 on, as the join of all pairs gives them, with a passage that most documents share; neither words nor lesser pairs are rows of the plan."""
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice("abcdefgh") * rng.randint(1, 4) + str(rng.randint(0, 60)) for _ in range(n))
    common, texts = prose(14), ["", None, "one two", "a b c d e f", "a b c d e f", "é ü\n x  y  z w v"]
    for i in range(120):
        texts.append(" ".join([prose(rng.choice([0, 3, 8, 30, 200])), common if i % 3 else "", rng.choice([x for x in texts if x])]))
    rows = [(7 * i % 1000, x) for i, x in enumerate(texts)]
    df = spark.createDataFrame([*rows, (None, texts[-1])], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    words = fingerprint.explode_tokens(df.where("doc_id is not null"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([^ ]+)"), F.lit(1)))
    plain = fingerprint.fingerprint_pairs(fingerprint.winnow(fingerprint.kgrams(words, queries.K), queries.W)).where("greatest(cont_left, cont_right) >= 0.3")
    want = sorted((r["left_id"], r["right_id"], r["inter"], round(r["cont_left"], 6), round(r["cont_right"], 6)) for r in plain.collect())
    found = queries.doc_containment(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == want and len(want) > 500
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Aggregate [left_id" not in plan and "posexplode" not in plan


def test_containment_keys(spark):
    """Text keys, repeated keys as one set, an empty set."""
    rows = [("b", [1, 2, 3]), ("a", [1, 2, 3, 4, 5, 6, 7]), ("é", []), ("c", [7, 8, 9, 10]), ("d", [3])]
    got = sorted(map(tuple, fingerprint.containment_pairs(spark.createDataFrame(rows, "doc_id string, hashes array<long>"), 0.3).collect()))
    assert got == [("a", "b", 3, 3 / 7, 1.0), ("a", "d", 1, 1 / 7, 1.0), ("b", "d", 1, 1 / 3, 1.0)]
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "g h i j k l"), (2, "g h i j k l")], "doc_id long, text string")
    assert sorted((r[0], len(r[1])) for r in fingerprint.fingerprint_sets(twice, 6, 5).collect()) == [(1, 2), (2, 1)]


def test_nearest_makes_no_rows_of_all_pairs(spark, monkeypatch):
    """Cells against brute force: copies, nearly equal vectors, one dimension without spread, odd numbers; the plan joins no pairs."""
    monkeypatch.setattr(neighbours, "CELL", 40)
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=(900, 3)) * [1, 5, 0], 1) + rng.choice([0, 1e-15], size=(900, 3))
    v[100:200] = v[99]
    v[300:400] = rng.normal(size=(100, 3))
    for odd in (False, True):
        if odd:
            v = v[:300].copy()
            v[7], v[8] = np.inf, np.nan
        n, k = len(v), 5
        df = spark.createDataFrame([(int(i * 7 % 907), [float(y) for y in x]) for i, x in enumerate(v)], "item_id long, v array<double>")
        ids = np.array([i * 7 % 907 for i in range(n)])
        found = neighbours.nearest(df.unionByName(df.limit(1).selectExpr("cast(null as long) as item_id", "v")), df, k)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "_salt" not in plan
        assert {r["query_id"] for r in neighbours.nearest(df.where("item_id < 8"), df, k).collect()} == {int(i) for i in ids if i < 8}
        got = {}
        for r in sorted(found.collect(), key=lambda r: r["place"]):
            got.setdefault(r["query_id"], []).append((r["item_id"], r["place"]))
        with np.errstate(invalid="ignore"):
            far = np.round(np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2)), 9)
        for i in range(n):
            order = [ids[j] for j in np.lexsort((ids, far[i])) if j != i][:k]
            assert got[ids[i]] == [(x, p + 1) for p, x in enumerate(order)], (i, v[i])


def test_method_score_searches_cells(spark):
    """The score's neighbours come from the cells; no join of all pairs is planned."""
    assert "_salt" not in queries.knn_method_score(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_features_are_read_once_and_tables_go(spark, tmp_path):
    """The z-scores rest on a table, not on the long input again; of the score's tables only those that its result reads stay."""
    features = spark.createDataFrame([(i, f, float(i * j % 7)) for i in range(9) for j, f in enumerate("ab", 1)], "item_id long, feature string, value double")
    features.write.parquet(str(tmp_path / "long"))
    z = neighbours.standardise(spark.read.parquet(str(tmp_path / "long")))
    assert z.inputFiles() and not any(str(tmp_path) in f for f in z.inputFiles()) and z.count() == 18
    here = lambda: set(Path(store.shared_dir(spark)).glob("kinloom-*/*"))
    before = here()
    assert queries.knn_method_score(spark, "/root/testdata/sf0.001").count() > 0
    assert sorted(p.name for p in here() - before) == ["cells", "home", "vectors"]


def test_visits_bring_back_only_what_lies_within_reach():
    """A vector that visits a cell gets the items up to its reach, ties included, and at most k; at home, where reach is infinite, the k nearest."""
    items = pa.table({"id": [5, 3, 4, 9], "v": [[0.0], [1.0], [1.0], [7.0]], "cell": [0, 0, 0, 0]})
    asking = pa.table({"v": [[2.0], [2.0], [2.0], [-9.0], [2.0]], "cell": [0] * 5, "reach": [1.0, 0.5, 5.0, 9.0, np.inf]})
    found = neighbours._search(3)(asking, items)["found"].to_pylist()
    assert [[x["id"] for x in f] for f in found] == [[3, 4], [], [3, 4, 5], [5], [3, 4, 5]]
