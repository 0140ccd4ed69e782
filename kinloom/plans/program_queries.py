"""Queries over programs as relations; importing this module registers them."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from kinloom.functions import report
from kinloom.operators import graphs, neighbours, programs, semantic, syntax
from kinloom.plans import signals
from kinloom.plans.fixtures import load, with_
from kinloom.plans.queries import feats, java_files, query, rounded
from kinloom.runtime import ship

_KINDS = ("binary", "invoke", "conditional", "return", "put", "get", "array", "new", "comparison", "define", "nop")
_INSTR = """SELECT l_orderkey % 200 AS method_id, l_suppkey % 6 AS block_id, l_linenumber AS pos,
    CASE l_partkey % 11 """ + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)) + """ END AS kind,
    CASE l_suppkey % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'XOR' ELSE 'ushr' END AS operator, 't' || CAST(l_partkey % 40 AS STRING) AS text,
    CASE WHEN l_partkey % 4 = 0 THEN ' ' ELSE 'm' || CAST(l_suppkey % 9 AS STRING) END AS target, CASE l_partkey % 3 WHEN 0 THEN 'INTERNAL' WHEN 1 THEN 'EXTERNAL' ELSE 'NONE' END AS call_kind,
    l_linenumber % 2 AS n_constants, l_linenumber % 3 AS n_strings, l_partkey % 2 AS n_defs, l_suppkey % 3 AS n_uses FROM lineitem"""
_CAT = "CASE WHEN kind = 'binary' THEN CASE WHEN lower(operator) IN ('and', 'or', 'xor', 'shl', 'shr', 'ushr') THEN 'LOGIC' ELSE 'ARITHMETIC' END " + " ".join(f"WHEN kind = '{k}' THEN '{c}'" for k, c in programs.CATEGORIES.items()) + " ELSE 'OTHER' END"
_I = f"i AS (SELECT *, {_CAT} AS category FROM ({_INSTR}))"
_E = "e AS (SELECT DISTINCT l_orderkey % 200 AS method_id, l_suppkey % 6 AS src, l_partkey % 6 AS dst, l_partkey % 5 = 0 AS exceptional FROM lineitem)"


def instructions(spark, d):
    rows = load(spark, d, "lineitem").selectExpr(*_columns(_INSTR))
    return rows.withColumn("category", programs.category(F.col("kind"), F.col("operator")))


def _columns(sql: str) -> list[str]:
    """The select list of a statement, split at its outer commas."""
    body, out, depth, start = sql[len("SELECT ") : sql.rindex(" FROM ")], [], 0, 0
    for i, c in enumerate(body):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(body[start:i])
            start = i + 1
    return [*out, body[start:]]


def flow_edges(spark, d):
    return load(spark, d, "lineitem").selectExpr("l_orderkey % 200 AS method_id", "l_suppkey % 6 AS src", "l_partkey % 6 AS dst", "l_partkey % 5 = 0 AS exceptional").distinct()


@query(f"WITH {_I} SELECT category, count(*) AS n FROM i GROUP BY category")
def instruction_categories(spark, d):
    return instructions(spark, d).groupBy("category").agg(F.count("*").alias("n"))


def _n(names) -> str:
    return ", ".join(f"count(*) FILTER (WHERE category = '{n}') AS {n.lower()}" for n in names)


@query(f"WITH {_I} SELECT method_id, count(DISTINCT block_id) AS blocks, count(*) AS instructions, {_n(programs.COUNTED)}, count(*) FILTER (WHERE call_kind = 'INTERNAL') AS internal_calls, count(*) FILTER (WHERE call_kind = 'EXTERNAL') AS external_calls, CAST(sum(n_constants) AS BIGINT) AS constants, CAST(sum(n_strings) AS BIGINT) AS strings FROM i GROUP BY method_id")
def method_features(spark, d):
    return programs.method_features(instructions(spark, d))


@query(f"WITH {_I}, {_E}, b AS (SELECT method_id, block_id, count(*) AS instructions, {_n(programs.BLOCK_COUNTED)} FROM i GROUP BY ALL) SELECT b.*, CAST((SELECT count(*) FROM e WHERE e.method_id = b.method_id AND e.dst = b.block_id) AS BIGINT) AS preds, CAST((SELECT count(*) FROM e WHERE e.method_id = b.method_id AND e.src = b.block_id) AS BIGINT) AS succs FROM b")
def block_features(spark, d):
    return programs.block_features(instructions(spark, d), flow_edges(spark, d)).drop("constants", "strings")


@query(f"WITH {_I} SELECT method_id, block_id, count(*) FILTER (WHERE category IN ('LOGIC', 'COMPARISON')) AS logic, count(*) FILTER (WHERE category IN ('ASSIGNMENT', 'FIELD_ACCESS', 'ARRAY_ACCESS')) AS transfers, CAST(sum(n_constants) AS BIGINT) AS numbers FROM i GROUP BY ALL")
def content_features(spark, d):
    return programs.content_features(instructions(spark, d)).select("method_id", "block_id", "logic", "transfers", "numbers")


@query(f"""WITH {_I}, {_E} SELECT method_id || '/' || block_id AS item_id, 'numeric.distinctDeclaredTargetCount' AS feature, count(DISTINCT target) FILTER (WHERE trim(target) <> '')::DOUBLE AS value FROM i GROUP BY ALL
  UNION ALL SELECT method_id || '/' || block_id, 'numeric.instructionCount', count(*)::DOUBLE FROM i GROUP BY ALL UNION ALL SELECT method_id || '/' || dst, 'numeric.predecessorCount', count(*)::DOUBLE FROM e GROUP BY ALL
  UNION ALL SELECT method_id || '/' || src, CASE WHEN exceptional THEN 'numeric.exceptionalSuccessorCount' ELSE 'numeric.normalSuccessorCount' END, count(*)::DOUBLE FROM e GROUP BY ALL""")
def raw_numeric_view(spark, d):
    shown = ("distinctDeclaredTargetCount", "instructionCount", "predecessorCount", "exceptionalSuccessorCount", "normalSuccessorCount")
    return programs.raw_numeric(instructions(spark, d), flow_edges(spark, d)).where(F.col("feature").isin(*[f"numeric.{x}" for x in shown]))


def raw_hashed(spark, d):
    return programs.raw_hashed(instructions(spark, d).select(F.concat_ws("/", "method_id", "block_id").alias("item_id"), F.lit("instruction.rawInstructionText").alias("channel"), F.col("text").alias("value")))


@query()
def raw_hash_view(spark, d):
    return raw_hashed(spark, d)


@query()
def block_candidates(spark, d):
    """Candidate blocks by the hybrid view: left methods are even, right ones odd, and both share the pair."""
    both = programs.block_view(programs.raw_numeric(instructions(spark, d), flow_edges(spark, d)), raw_hashed(spark, d), "HYBRID_NUMERIC_HASH")
    s = neighbours.standardise(both)
    names = sorted(r["feature"] for r in s.select("feature").distinct().collect())
    v = neighbours.vectors(s, names).withColumn("_m", F.split("item_id", "/")[0].cast("int")).withColumn("pair_id", F.floor(F.col("_m") / 2))
    found = neighbours.nearest(v.where("_m % 2 = 0"), v.where("_m % 2 = 1"), 3, within="pair_id")
    return rounded(found.select("query_id", "item_id", "place", (1 / (1 + F.col("distance"))).alias("score")))


_LABELS = "s AS (SELECT DISTINCT l_orderkey % 50 AS pair_id, CASE l_partkey % 2 WHEN 0 THEN 'A' ELSE 'B' END AS side, l_suppkey % 7 AS method, l_partkey % 23 AS label FROM lineitem)"


@query(f"""WITH {_LABELS}, n AS (SELECT pair_id, side, method, count(*) AS n FROM s GROUP BY ALL), i AS (SELECT a.pair_id, a.method AS x, b.method AS y, count(*) AS i FROM s a JOIN s b ON a.pair_id = b.pair_id AND a.label = b.label AND a.side = 'A' AND b.side = 'B' GROUP BY ALL),
  j AS (SELECT i.*, i / (p.n + q.n - i) AS sim FROM i JOIN n p ON p.pair_id = i.pair_id AND p.side = 'A' AND p.method = x JOIN n q ON q.pair_id = i.pair_id AND q.side = 'B' AND q.method = y),
  u AS (SELECT pair_id, 'A' AS side, x AS method, y AS other, sim FROM j UNION ALL SELECT pair_id, 'B', y, x, sim FROM j)
  SELECT pair_id, side, method, other, round(sim, 6) AS similarity FROM u QUALIFY row_number() OVER (PARTITION BY pair_id, side, method ORDER BY sim DESC, other) <= 4""")
def label_knn(spark, d):
    s = load(spark, d, "lineitem").selectExpr("l_orderkey % 50 AS pair_id", "CASE l_partkey % 2 WHEN 0 THEN 'A' ELSE 'B' END AS side", "l_suppkey % 7 AS method", "l_partkey % 23 AS label")
    return rounded(programs.label_neighbours(s).select("pair_id", "side", "method", "other", "similarity"))


_FLOW = """m AS (SELECT graph_id AS pair_id, node AS left_block, node AS right_block FROM (SELECT DISTINCT graph_id, src AS node FROM edges)), l AS (SELECT DISTINCT graph_id AS pair_id, src, dst, kind FROM edges WHERE kind = 'T' OR src < dst), r AS (SELECT DISTINCT graph_id AS pair_id, src, dst, kind FROM edges WHERE kind = 'F' OR src < dst)"""


@query(with_("edges") + f""", {_FLOW}, k AS (SELECT l.pair_id, count(*) AS k FROM l JOIN m a ON a.pair_id = l.pair_id AND a.left_block = src JOIN m b ON b.pair_id = l.pair_id AND b.left_block = dst SEMI JOIN r ON r.pair_id = l.pair_id AND r.src = a.right_block AND r.dst = b.right_block AND r.kind = l.kind GROUP BY l.pair_id)
  SELECT p.pair_id, round(CASE WHEN greatest(coalesce(ln, 0), coalesce(rn, 0)) = 0 THEN 1 ELSE least(1, coalesce(k, 0) / greatest(coalesce(ln, 0), coalesce(rn, 0))) END, 6) AS preserved FROM (SELECT DISTINCT pair_id FROM m) p
  LEFT JOIN (SELECT pair_id, count(*) AS ln FROM l GROUP BY pair_id) USING (pair_id) LEFT JOIN (SELECT pair_id, count(*) AS rn FROM r GROUP BY pair_id) USING (pair_id) LEFT JOIN k USING (pair_id)""")
def edge_preservation(spark, d):
    e = load(spark, d, "edges").withColumnRenamed("graph_id", "pair_id")
    m = e.select("pair_id", F.col("src").alias("left_block"), F.col("src").alias("right_block")).distinct()
    return rounded(programs.edge_preservation(m, e.where("kind = 'T' or src < dst").distinct(), e.where("kind = 'F' or src < dst").distinct()))


@query(f"""WITH {_I}, a AS (SELECT method_id AS region, category AS op, CASE pos % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 ELSE 1.0 END AS g FROM i), p AS (SELECT region, count(*) FILTER (WHERE op NOT IN ('RETURN', 'CONSTANT', 'OTHER')) AS n, min(g) FILTER (WHERE op NOT IN ('RETURN', 'CONSTANT', 'OTHER')) AS least FROM a GROUP BY region),
  t AS (SELECT method_id AS region, count(*) FILTER (WHERE category NOT IN ('RETURN', 'CONSTANT', 'OTHER')) AS l, count(*) FILTER (WHERE category NOT IN ('RETURN', 'CONSTANT', 'OTHER')) + method_id % 5 AS r FROM i GROUP BY method_id),
  j AS (SELECT t.region, l, r, coalesce(n, 0) AS n, least, CASE WHEN coalesce(n, 0) = 0 OR greatest(l, r) = 0 THEN 0 ELSE n / greatest(l, r) END AS share FROM t LEFT JOIN p USING (region))
  SELECT region, round(share, 6) AS share, l > n OR r > n AS edits, CASE WHEN share < 0.5 THEN 'NONE' WHEN NOT (l > n OR r > n) AND least >= 0.999 THEN 'T1' WHEN NOT (l > n OR r > n) AND least >= 0.79 THEN 'T2' ELSE 'T3' END AS type FROM j""")
def aligned_region_types(spark, d):
    i = instructions(spark, d)
    own = F.col("category").isin(*programs.SUBSTANTIVE)
    aligned = i.select(F.col("method_id").alias("region"), F.col("category").alias("op"), F.when(F.col("pos") % 3 == 1, 0.8).otherwise(1.0).alias("agreement"))
    totals = i.groupBy(F.col("method_id").alias("region")).agg(F.count_if(own).alias("left_total"), (F.count_if(own) + F.col("method_id") % 5).alias("right_total"))
    return rounded(programs.aligned_types(aligned, totals).select("region", "share", "edits", "type"))


@query("SELECT l_orderkey % 300 AS region, l_partkey % 4 AS method, CAST(min(l_suppkey % 90) AS BIGINT) AS begin_line, CAST(max(l_suppkey % 90) AS BIGINT) AS end_line, count(DISTINCT l_suppkey % 90) AS lines FROM lineitem WHERE l_suppkey % 90 > 0 GROUP BY ALL")
def region_extents(spark, d):
    return programs.extents(load(spark, d, "lineitem").selectExpr("l_orderkey % 300 AS region", "l_partkey % 4 AS method", "l_suppkey % 90 AS line"))


@query(with_("method_pairs") + ", s AS (SELECT pair_id, method_a AS m, 'a' AS side, max(s3) AS best, max(size_a) AS w FROM method_pairs GROUP BY ALL UNION ALL SELECT pair_id, method_b, 'b', max(s3), max(size_b) FROM method_pairs GROUP BY ALL) SELECT pair_id, round(sum(best * w) / sum(w), 6) AS average FROM s GROUP BY pair_id")
def directional_average(spark, d):
    return rounded(programs.directional_average(feats(spark, d).withColumn("score", F.col("s3"))))


@query(with_("labelled", "results") + ", c AS (SELECT pair_id % 900 AS case_id, expected_type, bool_or(expected_type = found_type)::INT AS ok FROM labelled JOIN results USING (pair_id) GROUP BY ALL) SELECT count(*) AS cases, CAST(sum(ok) AS BIGINT) AS \"right\", round(avg(ok), 6) AS accuracy FROM c")
def family_accuracy(spark, d):
    r = load(spark, d, "labelled").join(load(spark, d, "results"), "pair_id").select((F.col("pair_id") % 900).alias("case_id"), F.col("expected_type").alias("expected"), F.col("found_type").alias("found"))
    return rounded(programs.family_accuracy(r))


_CFG = "SELECT o_orderkey AS pair_id, o_orderpriority AS view, CASE WHEN o_custkey % 6 = 0 THEN '<init>' ELSE 'run' END AS left_name, CASE WHEN o_orderkey % 9 = 0 THEN '<init>' ELSE 'go' END AS right_name, (o_custkey % 97) / 97.0e0 AS similarity, CAST(1 + o_custkey % 30 AS DOUBLE) AS candidates, CAST(31 + o_orderkey % 50 AS DOUBLE) AS all_pairs FROM orders"


@query(f"SELECT view, count(*) AS pairs, round(avg(similarity), 6) AS mean_similarity, round(max(similarity), 6) AS max_similarity, CAST((array_agg(pair_id ORDER BY similarity DESC, pair_id))[1] AS BIGINT) AS best_pair, round(avg(1 - candidates / all_pairs), 6) AS reduction FROM ({_CFG}) WHERE left_name <> '<init>' AND right_name <> '<init>' GROUP BY view")
def cfg_summary(spark, d):
    return rounded(programs.cfg_summary(load(spark, d, "orders").selectExpr(*_columns(_CFG))))


@query(with_("decisions") + ", k AS (SELECT DISTINCT left_kind AS left_method, right_kind AS right_method FROM decisions), s AS (SELECT *, length(left_method) / (length(left_method) + length(right_method)) AS score FROM k) SELECT pair_id, place, round(score, 6) AS score FROM decisions JOIN s ON left_kind = left_method AND right_kind = right_method")
def oracle_cache(spark, d):
    r = load(spark, d, "decisions").select("pair_id", "place", F.col("left_kind").alias("left_method"), F.col("right_kind").alias("right_method"))
    score = F.length("left_method") / (F.length("left_method") + F.length("right_method"))
    return rounded(programs.once_per_pair(r, score).select("pair_id", "place", "score"))


@query(with_("sources") + ", c AS (SELECT DISTINCT pair_id, left_region, right_region FROM sources), e AS (SELECT DISTINCT pair_id, left_region, true AS proven FROM sources WHERE score > 0.95) SELECT pair_id, left_region, right_region, coalesce(proven, false) AS proven FROM c LEFT JOIN e USING (pair_id, left_region)")
def evidence_attach(spark, d):
    s = load(spark, d, "sources")
    e = s.where("score > 0.95").select("pair_id", "left_region").distinct().withColumn("proven", F.lit(True))
    return programs.attach(s.select("pair_id", "left_region", "right_region").distinct(), e, ("pair_id", "left_region"), {"proven": F.lit(False)})


@query()
def region_report(spark, d):
    r = load(spark, d, "decisions").where("type <> 'NON_CLONE'").select("pair_id", "place", "type", (1 / (1 + F.col("place"))).alias("score"))
    return report.region_json(r)


@query()
def tree_profile(spark, d):
    ship(spark)
    return syntax.tree_profile(syntax.ast_nodes(java_files(spark, d)))


@query()
def tree_regions(spark, d):
    ship(spark)
    return syntax.tree_regions(syntax.ast_nodes(java_files(spark, d)))


@query()
def region_of_lines(spark, d):
    ship(spark)
    lines = java_files(spark, d).select("file_id", F.lit(1).alias("region"), F.explode(F.array(F.lit(8), F.lit(9))).alias("line"))
    return syntax.region_of_lines(syntax.ast_nodes(java_files(spark, d)), lines)


@query()
def summary_cross_proof(spark, d):
    """Every left summary of a pair against every right one: an equi-join on the pair, then proofs, and sampling where they don't decide."""
    ship(spark)
    n = load(spark, d, "nation").select(F.col("n_regionkey").alias("pair_id"), "n_nationkey")
    e = lambda k: F.when(F.col("n_nationkey") % 3 == 0, F.lit(json.dumps(["*", ["param", 0], ["const", k]]))).when(F.col("n_nationkey") % 3 == 1, F.lit(json.dumps(["+", ["param", 0], ["param", 0]]))).otherwise(F.lit(json.dumps(["%", ["param", 0], ["const", 2]])))
    a, b = n.select("pair_id", F.col("n_nationkey").alias("left"), e(2).alias("x")), n.select("pair_id", F.col("n_nationkey").alias("right"), e(3).alias("y"))
    return a.join(b, "pair_id").select("pair_id", "left", "right", semantic.equivalence_column(F.col("x"), F.col("y")).alias("v")).select("pair_id", "left", "right", "v.proof", "v.sampling")


@query()
def recall_at_k(spark, d):
    from kinloom.operators import evaluation

    rows = load(spark, d, "orders").selectExpr("o_custkey AS case_id", "o_orderkey AS region", "(o_orderkey % 89) / 10.0e0 AS priority", "(o_orderkey % 5) / 2.0e0 AS coverage", "CAST(o_orderkey % 4 = 0 AS INT) AS hits")
    truth = load(spark, d, "customer").selectExpr("c_custkey AS case_id", "c_custkey % 3 = 0 AS positive")
    return evaluation.recall_at(rows, truth)


@query()
def loop_counts(spark, d):
    ship(spark)
    import pyarrow as pa

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        return pa.table({"graph_id": pa.array([rows[0]["graph_id"]], pa.int64()), "loops": pa.array([graphs.loops([(r["src"], r["dst"]) for r in rows])], pa.int64())})

    return load(spark, d, "edges").select("graph_id", "src", "dst").distinct().groupBy("graph_id").applyInArrow(run, "graph_id long, loops long")




@query()
def five_signals(spark, d):
    """Sources written for these queries, each against the next."""
    ship(spark)
    files = java_files(spark, d)
    wanted = files.select(F.col("file_id").alias("pair_id"), F.col("file_id").alias("file_a"), ((F.col("file_id") + 1) % 25).alias("file_b"))
    return rounded(signals.five_signals(files, wanted))
