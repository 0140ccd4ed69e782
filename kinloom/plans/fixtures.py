"""The driver's tables in the shapes that the operators take.

Each fixture is SQL that Spark and DuckDB read alike, so that a query and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

SQL = {
    # Scored pairs of methods: a file pair holds up to 5 x 4 of them.
    "method_pairs": """
      SELECT pair_id, method_a, method_b, 3 + (pair_id * 7 + ka * 11) % 40 AS size_a, 3 + (pair_id * 5 + kb * 13) % 40 AS size_b,
        least(s2, s4) AS s2, s3, s4, least(i, 4 + ka * 3, 4 + kb * 3) AS inter, 4 + ka * 3 AS count_a, 4 + kb * 3 AS count_b
      FROM (
        SELECT pair_id, ka, kb, 'A' || CAST(ka AS STRING) AS method_a, 'B' || CAST(kb AS STRING) AS method_b,
          max((l_partkey * 7 + l_suppkey) % 101) / 100.0e0 AS s2, max((l_partkey * 13 + l_linenumber * 7) % 101) / 100.0e0 AS s3,
          max((l_suppkey * 17 + l_partkey) % 101) / 100.0e0 AS s4, max(l_partkey % 9) AS i
        FROM (SELECT *, l_orderkey % 400 AS pair_id, l_partkey % 5 AS ka, l_suppkey % 4 AS kb FROM lineitem)
        GROUP BY pair_id, ka, kb)""",
    "methods": """
      SELECT DISTINCT pair_id, 'A' AS side, 'A' || CAST(k AS STRING) AS method, 3 + (pair_id * 7 + k * 11) % 40 AS tree_size FROM (SELECT l_orderkey % 400 AS pair_id, l_partkey % 6 AS k FROM lineitem)
      UNION ALL
      SELECT DISTINCT pair_id, 'B' AS side, 'B' || CAST(k AS STRING) AS method, 3 + (pair_id * 5 + k * 13) % 40 AS tree_size FROM (SELECT l_orderkey % 400 AS pair_id, l_suppkey % 5 AS k FROM lineitem)""",
    "profiles": """
      SELECT o_orderkey AS pair_id, o_custkey % 12 AS methods_a, o_orderkey % 9 AS methods_b, o_custkey % 3 AS classes_a, o_orderkey % 4 AS classes_b,
        (o_custkey * 31) % 300 AS nodes_a, (o_orderkey * 17) % 300 AS nodes_b, o_custkey % 7 AS outside_a, o_orderkey % 6 AS outside_b,
        o_custkey % 4 AS calls_a, o_orderkey % 5 AS calls_b, o_custkey % 5 AS trivial_a, o_orderkey % 3 AS trivial_b FROM orders""",
    "sources": """
      SELECT l_orderkey % 500 AS pair_id, 'L' || CAST(l_partkey % 12 AS STRING) AS left_region, 'R' || CAST(l_suppkey % 12 AS STRING) AS right_region,
        CASE l_linenumber % 5 WHEN 0 THEN 'EXACT_TEXT_SCAN' WHEN 1 THEN 'NORMALIZED_AST_SCAN' WHEN 2 THEN 'NORMALIZED_TOKEN_OVERLAP_SCAN' WHEN 3 THEN 'STATEMENT_DIFF_SCAN' ELSE 'CFG_KNN_SCAN' END AS channel,
        (50 + l_partkey % 51) / 100.0e0 AS score FROM lineitem""",
    "decisions": """
      SELECT pair_id, place, type, left_kind, right_kind, left_begin, left_begin + left_len AS left_end, right_begin, right_begin + right_len AS right_end FROM (
        SELECT CAST(floor(l_orderkey / 4) AS BIGINT) AS pair_id, CAST(row_number() OVER (PARTITION BY floor(l_orderkey / 4) ORDER BY l_partkey, l_suppkey, l_orderkey, l_linenumber) AS INT) AS place,
          CASE l_partkey % 8 WHEN 0 THEN 'T1' WHEN 1 THEN 'T2' WHEN 2 THEN 'T3' WHEN 3 THEN 'T4_CONFIRMED' WHEN 4 THEN 'T4_DYNAMIC_EVIDENCE' WHEN 5 THEN 'POSSIBLE_T4_CANDIDATE' ELSE 'NON_CLONE' END AS type,
          CASE l_suppkey % 4 WHEN 0 THEN 'METHOD' WHEN 1 THEN 'FILE' WHEN 2 THEN 'STATEMENT_WINDOW_REGION' ELSE 'CONTROL_REGION' END AS left_kind,
          CASE l_suppkey % 3 WHEN 0 THEN 'METHOD' WHEN 1 THEN 'FILE' ELSE 'STATEMENT_WINDOW_REGION' END AS right_kind,
          CAST(1 + l_partkey % 60 AS INT) AS left_begin, CAST(l_suppkey % 14 AS INT) AS left_len, CAST(1 + l_suppkey % 50 AS INT) AS right_begin, CAST(l_partkey % 11 AS INT) AS right_len
        FROM lineitem)""",
    "region_tokens": """
      SELECT CAST(floor(l_orderkey / 8) AS BIGINT) AS pair_id, CASE l_orderkey % 2 WHEN 0 THEN 'LEFT' ELSE 'RIGHT' END AS side, l_orderkey AS region_id, CASE WHEN l_orderkey % 8 < 2 THEN 'FILE' ELSE 'METHOD' END AS kind,
        l_linenumber AS pos, 't' || CAST(l_suppkey % 4 AS STRING) AS t1, 'n' || CAST(l_partkey % 5 AS STRING) AS t2, 's' || CAST(l_partkey % 3 AS STRING) AS stmt FROM lineitem""",
    "file_lines": """
      SELECT pair_id, side, CAST(CASE side WHEN 'LEFT' THEN 20 + pair_id % 50 ELSE 15 + pair_id % 40 END AS INT) AS lines
      FROM (SELECT DISTINCT CAST(floor(l_orderkey / 4) AS BIGINT) AS pair_id FROM lineitem), (SELECT 'LEFT' AS side UNION ALL SELECT 'RIGHT' AS side)""",
    "features": """
      SELECT user_id AS item_id, event_type AS feature, sum(abs(value)) AS value FROM events GROUP BY user_id, event_type""",
    "calls": "SELECT user_id, event_type AS target FROM events",
    "edges": """
      SELECT graph_id, src, dst, kind FROM (
        SELECT user_id AS graph_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst, CASE WHEN event_id % 3 = 0 THEN 'T' ELSE 'F' END AS kind
        FROM events) WHERE dst IS NOT NULL""",
    "graph_nodes": "SELECT DISTINCT user_id AS graph_id, event_type AS node, event_type AS label FROM events",
    # Chains whose labels meet across graphs.
    "chains": "SELECT l_orderkey AS graph_id, 'n' || CAST(l_linenumber AS STRING) AS src, 'n' || CAST(l_linenumber + 1 AS STRING) AS dst, l_returnflag AS kind FROM lineitem",
    "chain_nodes": """
      SELECT DISTINCT graph_id, node, CASE WHEN node = 'n1' THEN 'start' ELSE 'step' END AS label FROM (
        SELECT l_orderkey AS graph_id, 'n' || CAST(l_linenumber AS STRING) AS node FROM lineitem UNION ALL SELECT l_orderkey, 'n' || CAST(l_linenumber + 1 AS STRING) FROM lineitem)""",
    "blocks": """
      SELECT o_orderkey AS block_id, o_custkey AS pair_id, o_orderkey % 2 AS side, CAST(o_orderkey % 7 AS DOUBLE) AS arithmetic, CAST(o_custkey % 3 AS DOUBLE) AS calls, CAST(o_orderkey % 13 AS DOUBLE) AS instructions,
        CAST(o_custkey % 5 AS DOUBLE) AS logic, CAST(o_orderkey % 4 AS DOUBLE) AS transfers, CAST(o_custkey % 2 AS DOUBLE) AS strings, CAST(o_orderkey % 3 AS DOUBLE) AS numbers FROM orders""",
    "scored": "SELECT doc_id, CAST((doc_id * 37 + length(text)) % 101 AS DOUBLE) AS score, quality = 1 AS positive FROM documents JOIN labels USING (doc_id)",
    "labelled": """
      SELECT o_orderkey AS pair_id, CASE o_custkey % 5 WHEN 0 THEN 'T1' WHEN 1 THEN 'T2' WHEN 2 THEN 'T3' WHEN 3 THEN 'T4_WEAK' ELSE 'NON_CLONE' END AS expected_type,
        CASE o_custkey % 5 WHEN 2 THEN CASE o_orderkey % 3 WHEN 0 THEN 'VST3' WHEN 1 THEN 'ST3' ELSE 'MT3' END END AS band FROM orders""",
    "results": """
      SELECT o_orderkey AS pair_id, CASE WHEN o_orderkey % 23 = 0 THEN 'ERROR' ELSE 'OK' END AS status, CASE o_orderkey % 4 WHEN 0 THEN 'T1' WHEN 1 THEN 'T2' WHEN 2 THEN 'T3' ELSE 'NON_CLONE' END AS found_type,
        ((o_orderkey * 29) % 101) / 100.0e0 AS coverage, (o_orderkey * 7) % 1000 AS wall_ms, o_orderpriority AS project, CAST((o_orderkey * 7) % 1000 AS DOUBLE) AS runtime_ms FROM orders""",
    "channel_values": "SELECT event_type AS channel, user_id % 6 AS variant, CAST(event_id % 97 AS STRING) AS value FROM events",
    "clones": """
      SELECT l_partkey AS one_id, l_suppkey AS two_id, l_quantity AS min_size, 0.4e0 + ((l_partkey * 7) % 61) / 100.0e0 AS sim_line, 0.4e0 + ((l_suppkey * 11) % 61) / 100.0e0 AS sim_token FROM lineitem""",
    "functions": "SELECT p_partkey AS id, p_name AS name, p_size AS lines FROM part",
    "tree_nodes": """
      SELECT r_regionkey AS tree_id, 'r' AS node_id, CAST(NULL AS STRING) AS parent_id, 0 AS ordinal, r_name AS label, 0 AS depth FROM region
      UNION ALL SELECT n_regionkey, 'n' || CAST(n_nationkey AS STRING), 'r', n_nationkey, n_name, 1 FROM nation
      UNION ALL SELECT n_regionkey, 'c' || CAST(c_custkey AS STRING), 'n' || CAST(n_nationkey AS STRING), CAST(c_custkey AS INT), c_mktsegment, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey""",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a fixture. Tables are passed as arguments, so nothing is registered in the session's catalog."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    import re

    text = SQL[name]
    used = [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", text)]
    text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", r"\1 {\2}", text)
    return spark.sql(text, **{t: load(spark, sf_dir, t) for t in used})


def with_(*names: str) -> str:
    """The fixtures as the head of a DuckDB statement."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names)
