"""Registered queries over the operators, each with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinloom import sources as io
from kinloom.functions import hashing, lexical, report
from kinloom.operators import evaluation, fingerprint, graphs, neighbours, pairs, regions, semantic, sequence, syntax
from kinloom.plans.fixtures import load, with_
from kinloom.runtime import ship
from kinloom.store import discard, materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def docs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents")


# --- lexical -----------------------------------------------------------------------------------------------------


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


_KEYS = ", ".join(f"'{k}'" for k in lexical.JAVA_KEYWORDS)
_T2KEYS = ", ".join(f"'{k}'" for k in lexical.T2_KEYWORDS)


def _sql_tokens(pattern: str) -> str:
    return f"list_filter(regexp_extract_all(coalesce(text, ''), '{_sql(pattern)}'), lambda t: NOT starts_with(t, '//') AND NOT starts_with(t, '/*'))"


def _sql_normal(tokens: str, keys: str, character: str, start: str) -> str:
    return f"""list_transform({tokens}, lambda t: CASE WHEN starts_with(t, '"') THEN 'STR' WHEN starts_with(t, '''') THEN '{character}'
      WHEN regexp_matches(t, '^(?:[0-9]|\\.[0-9])') THEN 'NUM' WHEN regexp_matches(t, '{start}') AND t NOT IN ({keys}) THEN 'ID' ELSE t END)"""


_BASE = _sql_normal(_sql_tokens(lexical.TOKEN), _KEYS, "CHAR", r"^[\p{L}_]")
_T2 = _sql_normal(_sql_tokens(lexical.TOKEN_T2), _T2KEYS, "CHR", r"^[\p{L}_$]")


@query("SELECT doc_id, CASE WHEN ends_with(source || CASE WHEN doc_id % 3 = 0 THEN '.java' ELSE '.c' END, '.java') THEN 'JAVA' ELSE 'C' END AS language FROM documents")
def lang_detect(spark, d):
    path = F.concat("source", F.when(F.col("doc_id") % 3 == 0, ".java").otherwise(".c"))
    return docs(spark, d).select("doc_id", lexical.language_of(path).alias("language"))


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_BASE} AS t FROM documents)")
def tokenize(spark, d):
    t = docs(spark, d).select("doc_id", lexical.baseline_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_T2} AS t FROM documents)")
def tokenize_t2(spark, d):
    t = docs(spark, d).select("doc_id", lexical.t2_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(f"SELECT doc_id, md5(regexp_replace(coalesce(text, ''), '{_sql(lexical.STRIP)}', '\\1', 'g')) AS key FROM documents")
def strip_exact_key(spark, d):
    return docs(spark, d).select("doc_id", F.md5(lexical.exact_key(F.col("text"))).alias("key"))


@query("SELECT min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY md5(regexp_replace(coalesce(text, ''), '" + _sql(lexical.STRIP) + "', '\\1', 'g')) HAVING count(*) > 1")
def exact_dups(spark, d):
    keyed = docs(spark, d).select("doc_id", F.md5(lexical.exact_key(F.col("text"))).alias("k"))
    return keyed.groupBy("k").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1").select("first_id", "copies")


_DESC = [("(I[Ljava/lang/String;[[D)V",), ("()J",), ("(Ljava/util/Map$Entry;ZB)V",), ("([I[J)Ljava/lang/Object;",)]


@query("SELECT * FROM (VALUES ('()J', ''), ('(I[Ljava/lang/String;[[D)V', 'int,string[],double[][]'), ('(Ljava/util/Map$Entry;ZB)V', 'entry,boolean,byte'), ('([I[J)Ljava/lang/Object;', 'int[],long[]')) v(descriptor, types)")
def jvm_descriptors(spark, d):
    rows = spark.createDataFrame(_DESC, "descriptor string")
    return rows.select("descriptor", F.array_join(lexical.descriptor_types(F.col("descriptor")), ",").alias("types"))


@query("SELECT * FROM (VALUES (1, 'put(map,string,int[])'), (2, 'run()'), (3, 'add(list,object)')) v(id, signature)")
def signature_erasure(spark, d):
    rows = spark.createDataFrame([(1, "put(java.util.Map<String, List<Map<A, Map<B, Set<Map<C, D>>>>>> m, final String key, int... xs)"), (2, "run()"), (3, "add(List<? extends T> a, @Nullable Object b)")], "id int, s string")
    return rows.select("id", lexical.erased_signature(F.col("s")).alias("signature"))


_RESOLVE_FIX = """calls AS (SELECT o_orderkey AS call_id, 'm' || CAST(floor(o_custkey / (1 + o_orderkey % 3)) AS INT) AS name, o_orderkey % 4 AS arity, 's' || CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE o_orderkey END % 30 AS STRING) AS sig FROM orders),
  decls AS (SELECT DISTINCT 'm' || CAST(floor(c_custkey / (1 + c_custkey % 3)) AS INT) AS name, c_custkey % 4 AS arity, 's' || CAST(c_custkey % 30 AS STRING) AS sig, CAST(c_custkey AS STRING) AS method FROM customer)"""


@query(f"""WITH {_RESOLVE_FIX},
  exact AS (SELECT name, sig, min(method) AS m FROM decls GROUP BY ALL HAVING count(*) = 1), by_arity AS (SELECT name, arity, min(method) AS m FROM decls GROUP BY ALL HAVING count(*) = 1),
  by_name AS (SELECT name, min(method) AS m FROM decls GROUP BY ALL HAVING count(*) = 1)
  SELECT call_id, coalesce(e.m, a.m, n.m) AS method FROM calls c LEFT JOIN exact e ON c.name = e.name AND c.sig = e.sig LEFT JOIN by_arity a ON c.name = a.name AND c.arity = a.arity LEFT JOIN by_name n ON c.name = n.name""")
def method_resolution(spark, d):
    calls = load(spark, d, "orders").selectExpr("o_orderkey AS call_id", "'m' || CAST(floor(o_custkey / (1 + o_orderkey % 3)) AS INT) AS name", "o_orderkey % 4 AS arity", "'s' || CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE o_orderkey END % 30 AS STRING) AS sig")
    decls = load(spark, d, "customer").selectExpr("'m' || CAST(floor(c_custkey / (1 + c_custkey % 3)) AS INT) AS name", "c_custkey % 4 AS arity", "'s' || CAST(c_custkey % 30 AS STRING) AS sig", "CAST(c_custkey AS STRING) AS method").distinct()
    for i, keys in enumerate((["name", "sig"], ["name", "arity"], ["name"])):
        one = decls.groupBy(*keys).agg(F.min("method").alias(f"m{i}"), F.count("*").alias("n")).where("n = 1").drop("n")
        calls = calls.join(one, keys, "left")
    return calls.select("call_id", F.coalesce("m0", "m1", "m2").alias("method"))


@query("SELECT doc_id, printf('%.4f', n_chars / 7.0::DOUBLE) AS a, printf('%.2f%%', n_chars / 900.0::DOUBLE * 100) AS b FROM documents")
def number_format(spark, d):
    return docs(spark, d).select("doc_id", F.format_string("%.4f", F.col("n_chars") / 7.0).alias("a"), report.percent(F.col("n_chars") / 900.0).alias("b"))


# --- fingerprints ------------------------------------------------------------------------------------------------

K, W = 6, 5
_WORDS = "regexp_extract_all(coalesce(text, ''), '[^ ]+')"


def _grams(k: int) -> str:
    gram = " || ' ' || ".join(["tok", *[f"lead(tok, {i}) OVER w" for i in range(1, k)]])
    return f"""words AS (SELECT doc_id, unnest({_WORDS}) AS tok, generate_subscripts({_WORDS}, 1) - 1 AS pos FROM documents),
  grams AS (SELECT * FROM (SELECT doc_id, pos, CAST('0x' || substr(md5({gram}), 1, 15) AS BIGINT) AS hash FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE hash IS NOT NULL)"""


_PRINTS = _grams(K) + f""",
  mins AS (SELECT doc_id, min({{'h': hash, 'n': -pos}}) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {W - 1} FOLLOWING) AS m, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r,
    lead(pos, {W - 1}) OVER (PARTITION BY doc_id ORDER BY pos) AS full_ FROM grams),
  prints AS (SELECT DISTINCT doc_id, m.h AS hash, -m.n AS pos FROM mins WHERE full_ IS NOT NULL OR r = 1)"""
_PAIRSQL = _PRINTS + """,
  s AS (SELECT DISTINCT doc_id, hash FROM prints), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  inter AS (SELECT a.doc_id AS left_id, b.doc_id AS right_id, count(*) AS i FROM s a JOIN s b ON a.hash = b.hash AND a.doc_id < b.doc_id GROUP BY ALL),
  pairs AS (SELECT left_id, right_id, i, x.n AS nl, y.n AS nr, i / (x.n + y.n - i) AS jaccard, i / x.n AS cont_left, i / y.n AS cont_right FROM inter JOIN n x ON x.doc_id = left_id JOIN n y ON y.doc_id = right_id)"""


def words(spark, d):
    return fingerprint.explode_tokens(docs(spark, d), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([^ ]+)"), F.lit(1)))


def prints(spark, d):
    return fingerprint.winnow(fingerprint.kgrams(words(spark, d), K), W)


@query(f"WITH {_grams(K)} SELECT doc_id, count(*) AS grams, CAST(sum(hash % 1000003) AS BIGINT) AS folded FROM grams GROUP BY doc_id")
def kgram_hash(spark, d):
    g = fingerprint.kgrams(words(spark, d), K)
    return g.groupBy("doc_id").agg(F.count("*").alias("grams"), F.sum(F.col("hash") % 1000003).alias("folded"))


@query(f"WITH {_PRINTS} SELECT doc_id, hash, CAST(pos AS INT) AS pos FROM prints")
def winnow(spark, d):
    return prints(spark, d)


@query(f"WITH {_PAIRSQL} SELECT left_id, right_id, round(jaccard, 6) AS jaccard FROM pairs WHERE jaccard >= 0.2")
def doc_jaccard(spark, d):
    return rounded(fingerprint.fingerprint_pairs(prints(spark, d), least=0.2).select("left_id", "right_id", "jaccard"))


@query(f"WITH {_PAIRSQL} SELECT left_id, right_id, i AS inter, round(cont_left, 6) AS cont_left, round(cont_right, 6) AS cont_right FROM pairs WHERE greatest(cont_left, cont_right) >= 0.3")
def doc_containment(spark, d):
    return rounded(fingerprint.containment_pairs(fingerprint.fingerprint_sets(docs(ship(spark), d), K, W), 0.3))


@query()
def fingerprints_compat(spark, d):
    ship(spark)
    f = docs(spark, d).select("doc_id", hashing.fingerprints_column(lexical.baseline_tokens(F.col("text")), K, W).alias("f"))
    return f.select("doc_id", F.explode("f").alias("x")).select("doc_id", "x.hash", "x.pos")


@query()
def hash_buckets(spark, d):
    e = load(spark, d, "events").select("event_type", "user_id", hashing.bucket(F.col("event_type"), F.col("user_id").cast("string"), 128).alias("bucket"))
    return e.groupBy("event_type", "bucket").agg(F.count("*").alias("n"))


# --- method pairs to verdicts ------------------------------------------------------------------------------------

_EPS = "1e-9"
_FEAT = with_("method_pairs", "methods") + f""",
  f0 AS (SELECT *, sqrt(s3 * s3 + s4 * s4) / sqrt(2) AS magnitude FROM method_pairs),
  f AS (SELECT *, CASE WHEN magnitude = 0 THEN 0 ELSE greatest(-1, least(1, (s3 - s4) / (magnitude * sqrt(2)))) END AS divergence,
    greatest(0, least(1, (s2 + {_EPS}) / (s4 + {_EPS}))) AS exactness, greatest(0, least(1, (s3 - s2) / (s3 + {_EPS}))) AS gap,
    greatest(s2, s3, s4) - least(s2, s3, s4) AS spread, least(size_a, size_b) / greatest(size_a, size_b) AS size_ratio, inter / count_a AS cont_a_in_b, inter / count_b AS cont_b_in_a FROM f0),
  sc AS (SELECT *, greatest(magnitude, greatest(cont_a_in_b, cont_b_in_a) * sqrt(size_ratio)) AS match_score,
    CASE WHEN greatest(cont_a_in_b, cont_b_in_a) * sqrt(size_ratio) > magnitude THEN 'CONTAINMENT_DOMINANT' ELSE 'MAGNITUDE_DOMINANT' END AS reason FROM f),
  rk AS (SELECT *, row_number() OVER (PARTITION BY pair_id, method_a ORDER BY match_score DESC, magnitude DESC, exactness DESC, size_ratio DESC, method_a, method_b) AS ra,
    row_number() OVER (PARTITION BY pair_id, method_b ORDER BY match_score DESC, magnitude DESC, exactness DESC, size_ratio DESC, method_a, method_b) AS rb FROM sc),
  mg AS (SELECT *, CASE WHEN ra = 1 AND rb = 1 THEN 'BIDIRECTIONAL' WHEN ra = 1 THEN 'A_TO_B_ONLY' ELSE 'B_TO_A_ONLY' END AS direction, ra = 1 AND rb = 1 AS confirmed,
    match_score * least(1.0, least(size_a, size_b) / 10.0::DOUBLE) AS weight FROM rk WHERE ra = 1 OR rb = 1)"""
_STATS = _FEAT + """,
  wt AS (SELECT *, CASE WHEN sum(weight) OVER p = 0 THEN 1 ELSE weight END AS w, min(weight) OVER p = 0 AS low FROM mg WINDOW p AS (PARTITION BY pair_id)),
  ct AS (SELECT *, s3 - sum(s3 * w) OVER p / sum(w) OVER p AS d3, s4 - sum(s4 * w) OVER p / sum(w) OVER p AS d4 FROM wt WINDOW p AS (PARTITION BY pair_id)),
  st AS (SELECT pair_id, count(*) AS matches, sum(magnitude * w) / sum(w) AS magnitude_avg, sum(match_score * w) / sum(w) AS match_score_avg, sum(s3 * w) / sum(w) AS centroid_s3, sum(s4 * w) / sum(w) AS centroid_s4,
    sum(divergence * w) / sum(w) AS divergence_avg, sum(spread * w) / sum(w) AS spread_avg, sum(exactness * w) / sum(w) AS exactness_avg, sum(gap * w) / sum(w) AS gap_avg,
    sum(d3 * d3 * w) / sum(w) AS variance_s3, sum(d4 * d4 * w) / sum(w) AS variance_s4, sum(cont_a_in_b * (1 - size_ratio) * w) / sum(w) AS partial_a_in_b, sum(cont_b_in_a * (1 - size_ratio) * w) / sum(w) AS partial_b_in_a,
    avg(confirmed::INT) AS confirmed_ratio, bool_or(low) AS low_evidence FROM ct GROUP BY pair_id),
  sides AS (SELECT pair_id, 'A' AS side, method_a AS method, match_score, confirmed FROM mg UNION ALL SELECT pair_id, 'B', method_b, match_score, confirmed FROM mg),
  cv AS (SELECT m.pair_id, m.side, m.method, any_value(tree_size) AS tree_size, coalesce(max(match_score), 0) AS covered, coalesce(bool_or(confirmed), false) AS confirmed FROM methods m LEFT JOIN sides USING (pair_id, side, method) GROUP BY ALL),
  ctot AS (SELECT pair_id, sum(tree_size * covered) FILTER (WHERE side = 'A') / sum(tree_size) FILTER (WHERE side = 'A') AS coverage_a, sum(tree_size * covered) FILTER (WHERE side = 'B') / sum(tree_size) FILTER (WHERE side = 'B') AS coverage_b,
    sum(tree_size * confirmed::INT) FILTER (WHERE side = 'A') / sum(tree_size) FILTER (WHERE side = 'A') AS confirmed_a, sum(tree_size * confirmed::INT) FILTER (WHERE side = 'B') / sum(tree_size) FILTER (WHERE side = 'B') AS confirmed_b FROM cv GROUP BY pair_id),
  sm AS (SELECT *, greatest(partial_a_in_b, partial_b_in_a) AS partial_signal FROM st JOIN ctot USING (pair_id))"""
_VERDICT = _STATS + """,
  v0 AS (SELECT *, ((pair_id * 13) % 101) / 100.0::DOUBLE AS s1, CASE WHEN pair_id % 3 = 0 THEN -1.0::DOUBLE ELSE ((pair_id * 29) % 101) / 100.0::DOUBLE END AS s5, pair_id % 11 = 0 AS exact_match, pair_id % 17 <> 0 AS parse_ok,
    pair_id % 2 = 0 AS weak_ctx, pair_id % 5 = 0 AS trivial_, pair_id % 7 = 0 AS costly FROM sm),
  v1 AS (SELECT *, (match_score_avg + magnitude_avg + centroid_s3 + centroid_s4) / 4 AS ms, (coverage_a + coverage_b) / 2 AS cs, (partial_signal + greatest(partial_a_in_b, partial_b_in_a) + abs(coverage_a - coverage_b)) / 3 AS ps,
    (gap_avg + spread_avg) / 2 AS ch FROM v0),
  v2 AS (SELECT *, greatest(0, least(1, (coverage_a + coverage_b + confirmed_a + confirmed_b + confirmed_ratio) / 5 * (1 - partial_signal))) AS sf, greatest(0, least(1, ps)) AS sp, greatest(0, least(1, (variance_s3 + variance_s4 + spread_avg) / 3)) AS sx,
    exact_match::INT::DOUBLE AS t1, (ms + exactness_avg + 1 - ch + cs) / 4 AS t2, (ms + centroid_s4 + ch + cs) / 4 AS t3, CASE WHEN s5 < 0 THEN 0 ELSE greatest(0, least(1, (s5 + 1 - ms + CASE WHEN weak_ctx THEN 0 ELSE s1 END) / 3)) END AS t4,
    (1 - ms + 1 - cs + 1 - ps + CASE WHEN s5 >= 0 THEN 1 - s5 ELSE 0.5 END) / 4 AS nc FROM v1),
  v3 AS (SELECT *, CASE WHEN NOT parse_ok THEN 'INCONCLUSIVE' WHEN exact_match THEN 'T1' WHEN t4 >= 0.65 AND t4 > greatest(t2, t3) AND ms < 0.75 THEN 'T4_WEAK' WHEN ms >= 0.45 AND cs >= 0.30 THEN CASE WHEN t2 >= t3 THEN 'T2' ELSE 'T3' END
      WHEN t4 >= 0.75 AND ms < 0.75 THEN 'T4_WEAK' WHEN nc >= 0.75 THEN 'NON_CLONE' ELSE 'INCONCLUSIVE' END AS clone_type,
    CASE WHEN sp >= 0.45 AND sp > sf THEN 'PARTIAL' WHEN sf >= 0.45 AND sf >= sx THEN 'FULL' WHEN sx >= 0.45 THEN 'MIXED' ELSE 'UNKNOWN' END AS scope0 FROM v2),
  v4 AS (SELECT *, CASE WHEN clone_type = 'NON_CLONE' THEN 'UNKNOWN' ELSE scope0 END AS scope FROM v3),
  v5 AS (SELECT *, CASE clone_type WHEN 'T1' THEN t1 WHEN 'T2' THEN t2 WHEN 'T3' THEN t3 WHEN 'T4_WEAK' THEN t4 WHEN 'NON_CLONE' THEN nc ELSE 0.35 END AS strength,
    greatest(0, least(1, 1 - (CASE WHEN scope = 'FULL' THEN 0.5 ELSE 0.35 END) * spread_avg - (CASE WHEN scope = 'FULL' THEN 0.25 ELSE 0.15 END) * (variance_s3 + variance_s4))) AS consistency,
    CASE WHEN NOT parse_ok THEN 0.2 WHEN low_evidence THEN least(0.5, 1 - CASE WHEN trivial_ THEN 0.1 ELSE 0 END - CASE WHEN costly THEN 0.05 ELSE 0 END) ELSE 1 - CASE WHEN trivial_ THEN 0.1 ELSE 0 END - CASE WHEN costly THEN 0.05 ELSE 0 END END AS reliability FROM v4),
  verdict AS (SELECT *, CASE WHEN clone_type = 'T4_WEAK' THEN least(0.7, strength * consistency * reliability) ELSE strength * consistency * reliability END AS confidence,
    CASE WHEN scope <> 'PARTIAL' THEN 'NONE' WHEN partial_a_in_b > partial_b_in_a + 0.1 THEN 'A_IN_B' WHEN partial_b_in_a > partial_a_in_b + 0.1 THEN 'B_IN_A' ELSE 'UNKNOWN' END AS direction FROM v5)"""


def feats(spark, d):
    return pairs.features(load(spark, d, "method_pairs"))


def merged(spark, d):
    return pairs.merge_directions(pairs.match_scores(feats(spark, d)))


def verdicts(spark, d):
    s = pairs.summarise(feats(spark, d), load(spark, d, "methods"))
    flags = {"CLASS_CONTEXT_WEAK": 2, "TRIVIAL_METHOD_HEAVY": 5, "S4_COST_RISK": 7}
    p = F.col("pair_id")
    s = s.select(
        "*", (p * 13 % 101 / 100.0).alias("s1"), F.when(p % 3 == 0, F.lit(-1.0)).otherwise(p * 29 % 101 / 100.0).alias("s5"), (p % 11 == 0).alias("exact_match"), (p % 17 != 0).alias("parse_ok"),
        F.array_compact(F.array(*[F.when(p % n == 0, F.lit(k)) for k, n in flags.items()])).alias("profile_flags"),
    )
    return pairs.classify(s)


@query(_FEAT + " SELECT pair_id, method_a, method_b, round(magnitude, 6) AS magnitude, round(divergence, 6) AS divergence, round(exactness, 6) AS exactness, round(gap, 6) AS gap, round(spread, 6) AS spread, round(size_ratio, 6) AS size_ratio, round(cont_a_in_b, 6) AS cont_a_in_b FROM f")
def stage2_features(spark, d):
    return rounded(feats(spark, d).select("pair_id", "method_a", "method_b", "magnitude", "divergence", "exactness", "gap", "spread", "size_ratio", "cont_a_in_b"))


@query(_FEAT + " SELECT pair_id, method_a, method_b, reason, round(match_score, 6) AS match_score FROM rk WHERE ra = 1")
def best_match_forward(spark, d):
    return rounded(pairs.best_matches(pairs.match_scores(feats(spark, d)), "method_a").select("pair_id", "method_a", "method_b", "reason", "match_score"))


@query(_FEAT + " SELECT pair_id, method_a, method_b, direction, confirmed, round(weight, 6) AS weight FROM mg")
def merge_directions(spark, d):
    return rounded(merged(spark, d).select("pair_id", "method_a", "method_b", "direction", "confirmed", "weight"))


@query(_STATS + " SELECT pair_id, matches, round(magnitude_avg, 6) AS magnitude_avg, round(variance_s3, 6) AS variance_s3, round(variance_s4, 6) AS variance_s4, round(partial_a_in_b, 6) AS partial_a_in_b, round(confirmed_ratio, 6) AS confirmed_ratio, low_evidence FROM st")
def weighted_stats(spark, d):
    return rounded(pairs.weighted(merged(spark, d)).select("pair_id", "matches", "magnitude_avg", "variance_s3", "variance_s4", "partial_a_in_b", "confirmed_ratio", "low_evidence"))


@query(_STATS + " SELECT pair_id, round(coverage_a, 6) AS coverage_a, round(coverage_b, 6) AS coverage_b, round(confirmed_a, 6) AS confirmed_a, round(confirmed_b, 6) AS confirmed_b FROM ctot")
def coverage(spark, d):
    return rounded(pairs.coverage_totals(pairs.coverage(merged(spark, d), load(spark, d, "methods"))).select("pair_id", "coverage_a", "coverage_b", "confirmed_a", "confirmed_b"))


@query(_STATS + " SELECT pair_id, side, CAST(row_number() OVER (PARTITION BY pair_id, side ORDER BY covered, method) AS INT) AS place, method, round(covered, 6) AS covered FROM cv QUALIFY row_number() OVER (PARTITION BY pair_id, side ORDER BY covered, method) <= 3")
def least_covered(spark, d):
    return rounded(pairs.least_covered(pairs.coverage(merged(spark, d), load(spark, d, "methods"))))


@query(_STATS + """ SELECT pair_id, round(partial_signal, 6) AS partial_signal, concat_ws(',', CASE WHEN abs(coverage_a - coverage_b) >= 0.25 THEN 'ASYMMETRIC_COVERAGE' END, CASE WHEN variance_s3 >= 0.1 OR variance_s4 >= 0.1 THEN 'HIGH_VARIANCE' END,
  CASE WHEN low_evidence THEN 'LOW_EVIDENCE' END, CASE WHEN confirmed_ratio < 0.5 THEN 'MANY_UNCONFIRMED_MATCHES' END, CASE WHEN partial_signal >= 0.45 THEN 'PARTIAL_PATTERN_PRESENT' END) AS flags FROM sm""")
def stage3_summary(spark, d):
    s = pairs.summarise(feats(spark, d), load(spark, d, "methods"))
    return rounded(s.select("pair_id", "partial_signal", F.array_join("flags", ",").alias("flags")))


@query(_VERDICT + " SELECT pair_id, clone_type, scope, direction, round(confidence, 6) AS confidence, CASE WHEN confidence >= 0.75 THEN 'HIGH' WHEN confidence >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_level FROM verdict")
def stage4_verdict(spark, d):
    return rounded(verdicts(spark, d).select("pair_id", "clone_type", "scope", "direction", "confidence", "confidence_level"))


@query()
def evidence_chain(spark, d):
    return pairs.evidence(verdicts(spark, d))


@query()
def report_json(spark, d):
    return report.verdict_json(verdicts(spark, d))


@query()
def report_text(spark, d):
    return report.verdict_text(verdicts(spark, d))


@query(with_("profiles") + """, c AS (SELECT *, outside_a >= 4 OR classes_a > 1 AS ca, outside_b >= 4 OR classes_b > 1 AS cb FROM profiles),
  m AS (SELECT *, CASE WHEN nodes_a <= 5 AND nodes_b <= 5 THEN 'EMPTY_OR_TOO_SMALL' WHEN methods_a = 0 OR methods_b = 0 THEN 'NO_METHOD_CLASS_CONTEXT' WHEN methods_a = 1 AND methods_b = 1 THEN CASE WHEN ca OR cb THEN 'SINGLE_METHOD_REAL_FILE' ELSE 'BCB_SINGLE_METHOD_FRAGMENT' END
    WHEN methods_a = 1 OR methods_b = 1 THEN 'ONE_TO_MANY_METHOD' WHEN least(methods_a, methods_b) / greatest(methods_a, methods_b) >= 0.6 THEN 'MULTI_METHOD_BALANCED' ELSE 'MULTI_METHOD_UNBALANCED' END AS mode FROM c)
  SELECT pair_id, mode, concat_ws(',', CASE WHEN calls_a + calls_b >= 5 THEN 'API_DENSE' END, CASE WHEN greatest(nodes_a, nodes_b) > 0 AND least(nodes_a, nodes_b) / greatest(nodes_a, nodes_b) < 0.5 THEN 'ASYMMETRIC_FILE_SIZE' END,
    CASE WHEN (methods_a = 0) <> (methods_b = 0) THEN 'ASYMMETRIC_METHOD_PRESENCE' END, CASE WHEN ca OR cb THEN 'CLASS_CONTEXT_STRONG' END, CASE WHEN NOT ca OR NOT cb THEN 'CLASS_CONTEXT_WEAK' END, CASE WHEN methods_a * methods_b > 200 THEN 'S4_COST_RISK' END,
    CASE WHEN (methods_a > 0 AND trivial_a >= greatest(2, methods_a // 2)) OR (methods_b > 0 AND trivial_b >= greatest(2, methods_b // 2)) THEN 'TRIVIAL_METHOD_HEAVY' END) AS flags,
    CASE WHEN mode = 'BCB_SINGLE_METHOD_FRAGMENT' OR NOT ca OR NOT cb THEN 'ENABLED_WEAK' WHEN mode = 'EMPTY_OR_TOO_SMALL' THEN 'DISABLED' ELSE 'ENABLED' END AS signal_s1 FROM m""")
def stage0_profile(spark, d):
    return pairs.profile(load(spark, d, "profiles")).select("pair_id", "mode", F.array_join("flags", ",").alias("flags"), "signal_s1")


@query("SELECT pair_id, round((a + b) / 2, 6) AS token_layer, round(CASE WHEN e >= 0 THEN ((a + b) / 2 + c + e) / 3 ELSE ((a + b) / 2 + c) / 2 END, 6) AS overall FROM (SELECT o_orderkey AS pair_id, (o_custkey % 101) / 103.0::DOUBLE AS a, (o_orderkey % 97) / 101.0::DOUBLE AS b, (o_custkey % 89) / 97.0::DOUBLE AS c, CASE WHEN o_orderkey % 4 = 0 THEN -1.0::DOUBLE ELSE (o_orderkey % 83) / 89.0::DOUBLE END AS e FROM orders)")
def combined_signals(spark, d):
    files = load(spark, d, "orders").selectExpr("o_orderkey AS pair_id", "(o_custkey % 101) / 103.0e0 AS s1", "(o_orderkey % 97) / 101.0e0 AS s3", "(o_custkey % 89) / 97.0e0 AS s4", "CASE WHEN o_orderkey % 4 = 0 THEN -1.0e0 ELSE (o_orderkey % 83) / 89.0e0 END AS s5")
    return rounded(pairs.combine_signals(files).select("pair_id", "token_layer", "overall"))


# --- regions -----------------------------------------------------------------------------------------------------

_STMTS = "stmts AS (SELECT conv_id AS file_id, turn AS pos, md5(coalesce(text, '')) AS stmt FROM conversations)"


@query(f"WITH {_STMTS}, o AS (SELECT file_id, stmt, row_number() OVER (PARTITION BY file_id ORDER BY pos) - 1 AS start FROM stmts), n AS (SELECT file_id, count(*) AS n FROM o GROUP BY file_id)"
       " SELECT o.file_id, CAST(s.size AS INT) AS size, CAST(o.start AS INT) AS start, (SELECT string_agg(x.stmt, ' ' ORDER BY x.start) FROM o x WHERE x.file_id = o.file_id AND x.start BETWEEN o.start AND o.start + s.size - 1) AS stmts FROM o JOIN n USING (file_id), (SELECT unnest(range(2, 7)) AS size) s WHERE o.start + s.size <= n.n AND o.start < 64")
def stmt_windows(spark, d):
    stmts = load(spark, d, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("pos"), F.md5(F.coalesce("text", F.lit(""))).alias("stmt"))
    return regions.statement_windows(stmts).select("file_id", "size", "start", F.array_join("stmts", " ").alias("stmts"))


@query("WITH r AS (SELECT doc_id, p, md5(line) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents) WHERE length(line) >= 40), f AS (SELECT k FROM r GROUP BY k HAVING count(*) >= 2)"
       " SELECT DISTINCT a.doc_id AS left_file, b.doc_id AS right_file, a.doc_id || ':' || a.p AS left_region, b.doc_id || ':' || b.p AS right_region FROM r a JOIN r b ON a.k = b.k AND a.doc_id < b.doc_id JOIN f ON a.k = f.k")
def region_candidates(spark, d):
    lines = docs(spark, d).select(F.col("doc_id").alias("file_id"), F.posexplode(F.split("text", "\n")).alias("p", "line")).where(F.length("line") >= 40)
    rows = lines.select("file_id", F.concat_ws(":", F.col("file_id").cast("string"), (F.col("p") + 1).cast("string")).alias("region_id"), F.md5("line").alias("k"))
    return regions.equal_key_candidates(rows, "EXACT_TEXT_SCAN", F.col("k")).select("left_file", "right_file", "left_region", "right_region")


def _region_arrays(spark, d):
    rows = load(spark, d, "region_tokens").groupBy("pair_id", "side", "region_id", "kind").agg(F.array_sort(F.collect_list(F.struct("pos", "t1", "t2", "stmt"))).alias("r"))
    return rows.select("pair_id", "side", "region_id", "kind", F.col("r.t1").alias("t1"), F.col("r.t2").alias("t2"), F.col("r.stmt").alias("stmts"))


@query(with_("region_tokens") + """, r AS (SELECT pair_id, side, region_id, kind = 'FILE' AS whole, list(t1 ORDER BY pos, t1, t2, stmt) AS t1, list(t2 ORDER BY pos, t1, t2, stmt) AS t2 FROM region_tokens GROUP BY ALL),
  p AS (SELECT a.pair_id, a.region_id AS left_region, b.region_id AS right_region, a.t1 AS x1, b.t1 AS y1, a.t2 AS x2, b.t2 AS y2 FROM r a JOIN r b ON a.pair_id = b.pair_id AND a.whole = b.whole AND a.side = 'LEFT' AND b.side = 'RIGHT'),
  j AS (SELECT *, len(list_intersect(x2, y2)) / len(list_distinct(list_concat(x2, y2))) AS s FROM p)
  SELECT pair_id, left_region, right_region, 'EXACT_TEXT_SCAN' AS channel, 1.0::DOUBLE AS score FROM p WHERE x1 = y1 UNION ALL SELECT pair_id, left_region, right_region, 'NORMALIZED_AST_SCAN', 1.0 FROM p WHERE x2 = y2
  UNION ALL SELECT pair_id, left_region, right_region, 'NORMALIZED_TOKEN_OVERLAP_SCAN', round(s, 6) FROM j WHERE s >= 0.5""")
def token_scans(spark, d):
    ship(spark)
    return rounded(regions.source_scans(_region_arrays(spark, d)).where("channel <> 'STATEMENT_DIFF_SCAN'"))


@query()
def statement_scan(spark, d):
    ship(spark)
    return rounded(regions.source_scans(_region_arrays(spark, d)).where("channel = 'STATEMENT_DIFF_SCAN'"))


@query()
def scanned_candidates(spark, d):
    """Regions to ranked candidates: the scans' channels merged, with ranks in their file pair."""
    ship(spark)
    merged = regions.merge_candidates(regions.source_scans(_region_arrays(spark, d)))
    size = load(spark, d, "region_tokens").groupBy("region_id", "kind").agg(F.count("*").cast("int").alias("tokens"))
    for side in ("left", "right"):
        merged = merged.join(size.select(F.col("region_id").alias(f"{side}_region"), F.col("kind").alias(f"{side}_kind"), F.col("tokens").alias(f"{side}_tokens")), f"{side}_region")
    return rounded(regions.rank_candidates(merged).select("pair_id", "left_region", "right_region", "n_channels", "rank_score", "place"))


_KIND = "CASE CAST(substr({0}_region, 2) AS INT) % 4 WHEN 0 THEN 'METHOD' WHEN 1 THEN 'METHOD_BODY_REGION' WHEN 2 THEN 'CONTROL_REGION' ELSE 'STATEMENT_WINDOW_REGION' END"


@query(with_("sources") + f""", c AS (SELECT pair_id, left_region, right_region, max(score) AS best, count(DISTINCT channel) AS n, bool_or(channel = 'CFG_KNN_SCAN') AS cfg, {_KIND.format('left')} AS lk, {_KIND.format('right')} AS rk,
    CAST(substr(left_region, 2) AS INT) * 9 + CAST(substr(right_region, 2) AS INT) * 5 AS tok FROM sources GROUP BY pair_id, left_region, right_region),
  s AS (SELECT *, round(0.42 * best + 0.22 * least(1.0, n / 4) + 0.18 * least(1.0, tok / 120) + 0.18 * CASE WHEN lk = 'METHOD' AND rk = 'METHOD' THEN 1.0 WHEN lk = 'METHOD_BODY_REGION' AND rk = 'METHOD_BODY_REGION' THEN 0.92
    WHEN lk LIKE 'METHOD%' AND rk LIKE 'METHOD%' THEN 0.88 WHEN lk = 'CONTROL_REGION' OR rk = 'CONTROL_REGION' THEN 0.62 WHEN lk = 'STATEMENT_WINDOW_REGION' OR rk = 'STATEMENT_WINDOW_REGION' THEN 0.45 ELSE 0.5 END + CASE WHEN cfg THEN 0.12 ELSE 0 END, 9) AS rank_score FROM c)
  SELECT pair_id, left_region, right_region, n AS n_channels, round(rank_score, 6) AS rank_score, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY rank_score DESC, left_region, right_region) AS INT) AS place FROM s""")
def candidate_merge_rank(spark, d):
    m = regions.merge_candidates(load(spark, d, "sources"))
    num = lambda s: F.substring(f"{s}_region", 2, 9).cast("int")
    m = m.select("*", F.expr(_KIND.format("left")).alias("left_kind"), F.expr(_KIND.format("right")).alias("right_kind"), (num("left") * 9).alias("left_tokens"), (num("right") * 5).alias("right_tokens"))
    return rounded(regions.rank_candidates(m).select("pair_id", "left_region", "right_region", "n_channels", "rank_score", "place"))


_TYPES = "['T1', 'T2', 'T3', 'T4_CONFIRMED', 'T4_DYNAMIC_EVIDENCE', 'POSSIBLE_T4_CANDIDATE']"
_LINES = with_("decisions", "file_lines") + f""",
  shown AS (SELECT * FROM (SELECT *, max((NOT (left_kind = 'FILE' AND right_kind = 'FILE'))::INT) OVER (PARTITION BY pair_id) AS fine FROM decisions WHERE type <> 'NON_CLONE') WHERE fine = 0 OR NOT (left_kind = 'FILE' AND right_kind = 'FILE')),
  ln AS (SELECT DISTINCT pair_id, 'LEFT' AS side, type, unnest(range(left_begin, left_end + 1)) AS line FROM FROM_ UNION SELECT DISTINCT pair_id, 'RIGHT', type, unnest(range(right_begin, right_end + 1)) FROM FROM_),
  rk AS (SELECT *, list_position({_TYPES}, type) AS r, min(list_position({_TYPES}, type)) OVER (PARTITION BY pair_id, side, line) AS m FROM ln),
  cov AS (SELECT pair_id, side, type, r, least(1.0::DOUBLE, count(*) / any_value(lines)) AS covered, least(1.0::DOUBLE, sum((r = m)::INT) / any_value(lines)) AS exclusive FROM rk JOIN file_lines USING (pair_id, side) GROUP BY ALL)"""


@query(_LINES.replace("FROM_", "(SELECT * FROM decisions WHERE type <> 'NON_CLONE')") + " SELECT pair_id, side, type, round(covered, 6) AS covered, round(exclusive, 6) AS exclusive FROM cov")
def line_coverage(spark, d):
    shown = load(spark, d, "decisions").where("type <> 'NON_CLONE'")
    return rounded(regions.type_coverage(shown, load(spark, d, "file_lines")).select("pair_id", "side", "type", "covered", "exclusive"))


@query(_LINES.replace("FROM_", "shown") + f""",
  tot AS (SELECT pair_id, side, least(1.0::DOUBLE, count(DISTINCT line) / any_value(lines)) AS x FROM ln JOIN file_lines USING (pair_id, side) GROUP BY pair_id, side),
  mt AS (SELECT pair_id, coalesce(max(x) FILTER (WHERE side = 'LEFT'), 0) AS l, coalesce(max(x) FILTER (WHERE side = 'RIGHT'), 0) AS r FROM tot GROUP BY pair_id),
  dm AS (SELECT pair_id, count(*) AS k, arg_max(type, x * 1000000 - rr) AS dominant FROM (SELECT pair_id, type, any_value(r) AS rr, max(covered) AS x FROM cov GROUP BY pair_id, type) GROUP BY pair_id),
  un AS (SELECT pair_id, bool_or(left_kind IN ('FILE', 'METHOD') OR right_kind IN ('FILE', 'METHOD')) AS unit, count(*) AS n FROM shown GROUP BY pair_id),
  j AS (SELECT f.pair_id, coalesce(l, 0) AS l, coalesce(r, 0) AS r, coalesce(k, 0) AS k, dominant, coalesce(unit, false) AS unit, coalesce(n, 0) AS n FROM (SELECT DISTINCT pair_id FROM file_lines) f LEFT JOIN mt USING (pair_id) LEFT JOIN dm USING (pair_id) LEFT JOIN un USING (pair_id)),
  sh AS (SELECT *, CASE WHEN n = 0 OR greatest(l, r) < 0.2 THEN 'NO_SIGNIFICANT_OVERLAP' WHEN NOT unit THEN 'LOCAL_SIMILARITIES_ONLY' WHEN least(l, r) >= 0.8 THEN 'FULL_OVERLAP' WHEN l >= 0.8 AND r >= 0.2 THEN 'LEFT_EMBEDDED_IN_RIGHT'
    WHEN r >= 0.8 AND l >= 0.2 THEN 'RIGHT_EMBEDDED_IN_LEFT' WHEN least(l, r) >= 0.2 THEN 'PARTIAL_OVERLAP' ELSE 'LOCAL_SIMILARITIES_ONLY' END AS shape FROM j)
  SELECT pair_id, CASE WHEN k = 0 THEN 'NON_CLONE' WHEN least(l, r) < 0.2 THEN 'MOSTLY_NON_CLONE' WHEN k > 1 THEN 'MIXED_CLONE_TYPES' WHEN dominant NOT IN ('T1', 'T2', 'T3') THEN 'POSSIBLE_SEMANTIC_RELATION' WHEN least(l, r) >= 0.8 THEN 'FULL_FILE_' || dominant
    WHEN dominant = 'T3' THEN 'PARTIAL_T3' ELSE 'PARTIAL_T2' END AS relationship, shape, CASE WHEN shape = 'NO_SIGNIFICANT_OVERLAP' THEN 'NONE' WHEN shape = 'LOCAL_SIMILARITIES_ONLY' THEN CASE WHEN greatest(l, r) >= 0.8 THEN 'MEDIUM' ELSE 'LOW' END
    WHEN shape <> 'PARTIAL_OVERLAP' THEN 'HIGH' ELSE 'MEDIUM' END AS priority, round(1 - least(l, r), 6) AS unrelated, coalesce(dominant, 'NON_CLONE') AS dominant FROM sh""")
def file_relationship(spark, d):
    s = regions.file_summary(load(spark, d, "decisions"), load(spark, d, "file_lines"))
    return rounded(s.select("pair_id", "relationship", "shape", "priority", "unrelated", "dominant"))


@query(_LINES.replace("FROM_", "(SELECT * FROM decisions WHERE type <> 'NON_CLONE')") + """, x AS (SELECT pair_id, type, sum(exclusive) AS share FROM cov GROUP BY ALL HAVING sum(exclusive) > 0), e AS (SELECT *, round(share / sum(share) OVER (PARTITION BY pair_id) * 100, 9) AS v FROM x), f AS (SELECT *, floor(v) AS fl, 100 - sum(floor(v)) OVER (PARTITION BY pair_id) AS rest,
  row_number() OVER (PARTITION BY pair_id ORDER BY round(v - floor(v), 9) DESC, type) AS p FROM e) SELECT pair_id, type, CAST(fl + CASE WHEN p <= rest THEN 1 ELSE 0 END AS BIGINT) AS percent FROM f""")
def largest_remainder(spark, d):
    cover = regions.type_coverage(load(spark, d, "decisions").where("type <> 'NON_CLONE'"), load(spark, d, "file_lines"))
    return regions.largest_remainder(cover.groupBy("pair_id", "type").agg(F.sum("exclusive").alias("share")).where("share > 0"))


@query(with_("decisions") + " SELECT a.pair_id, CAST(a.place AS BIGINT) AS a_id, CAST(b.place AS BIGINT) AS b_id, CAST(least(a.left_end, b.right_end) - greatest(a.left_begin, b.right_begin) + 1 AS BIGINT) AS lines FROM decisions a JOIN decisions b ON a.pair_id = b.pair_id AND a.left_begin <= b.right_end AND b.right_begin <= a.left_end")
def line_overlap_join(spark, d):
    rows = load(spark, d, "decisions")
    r = lambda s: rows.select("pair_id", F.col("place").cast("long").alias("id"), F.col(f"{s}_begin").cast("long").alias("first"), F.col(f"{s}_end").cast("long").alias("last"))
    return regions.overlapping(r("left"), r("right"))


@query()
def greedy_select(spark, d):
    ship(spark)
    return regions.select_regions(load(spark, d, "decisions")).select("pair_id", "place", "type", "selected")


@query()
def region_types(spark, d):
    ship(spark)
    x = _line_pairs(spark, d)
    lines = lambda c: F.transform(c, lambda y: F.md5(y))
    tokens = lambda c: F.flatten(F.transform(c, lambda y: F.split(y, " ")))
    cand = x.select("doc_id", tokens(F.col("a")).alias("t1_left"), tokens(F.col("b")).alias("t1_right"), lines(F.col("a")).alias("stmts_left"), lines(F.col("b")).alias("stmts_right"))
    none = {"proven": F.lit(False), "sampled": F.col("doc_id") % 7 == 0, "region_coverage": (F.col("doc_id") % 4).cast("double")}
    kinds = {"left_kind": F.lit("METHOD"), "right_kind": F.lit("METHOD"), "channels": F.array(F.lit("EXACT_TEXT_SCAN")), "t2_left": F.transform("t1_left", F.lower), "t2_right": F.transform("t1_right", F.lower)}
    return rounded(regions.decide(cand.withColumns(none | kinds)).select("doc_id", "type", "strength", "similarity", "edits"))


def _line_pairs(spark, d):
    x = docs(spark, d).select("doc_id", "source", F.split("text", "\n").alias("s"))
    order = Window.partitionBy("source").orderBy("doc_id")
    return x.select("doc_id", F.col("s").alias("a"), F.lead("s").over(order).alias("b")).where("b is not null")


@query()
def lcs(spark, d):
    ship(spark)
    return rounded(_line_pairs(spark, d).select("doc_id", sequence.lcs_similarity_column(F.col("a"), F.col("b")).alias("similarity")))


@query()
def edit_script(spark, d):
    ship(spark)
    e = _line_pairs(spark, d).select("doc_id", F.explode(sequence.edit_script_column(F.col("a"), F.col("b"))).alias("e"))
    return e.groupBy("doc_id", F.col("e.kind").alias("kind")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT c_custkey, string_split(c_mktsegment, 'E') AS l, string_split(c_name, '0') AS r FROM customer),
  z AS (SELECT c_custkey AS id, l, r, unnest(range(1, least(len(l), len(r)) + 1)) AS p FROM c), q AS (SELECT id, p, l[p] AS a, r[p] AS b FROM z),
  f AS (SELECT id, a || '=' || arg_min(b, p) AS e FROM q WHERE a <> b GROUP BY id, a), g AS (SELECT id, string_agg(e, ',' ORDER BY e) AS renames FROM f GROUP BY id)
  SELECT q.id, coalesce(any_value(renames), '') AS renames, count(DISTINCT a || '=' || b) > count(DISTINCT a) AS conflict FROM q LEFT JOIN g USING (id) GROUP BY q.id""")
def rename_map(spark, d):
    c = load(spark, d, "customer").select("c_custkey", F.split("c_mktsegment", "E").alias("l"), F.split("c_name", "0").alias("r"))
    ids = lambda x: F.transform(x, lambda _: F.lit("ID"))
    m = c.select(F.col("c_custkey").alias("id"), sequence.rename_map(F.col("l"), F.col("r"), ids("l"), ids("r")).alias("m"))
    told = F.array_sort(F.transform(F.map_entries("m.renames"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return m.select("id", F.array_join(told, ",").alias("renames"), F.col("m.conflict").alias("conflict"))


# --- neighbours and graphs ---------------------------------------------------------------------------------------

_STD = with_("features") + """, lg AS (SELECT item_id, feature, log10(value + 1) AS x FROM features), n AS (SELECT count(DISTINCT item_id) AS n FROM lg),
  st AS (SELECT feature, sum(x) / any_value(n) AS mean, sqrt(greatest(0, sum(x * x) / any_value(n) - (sum(x) / any_value(n)) ** 2)) AS sd FROM lg, n GROUP BY feature),
  z AS (SELECT i.item_id, s.feature, (coalesce(x, 0) - mean) / sd AS z, x IS NOT NULL AS present FROM (SELECT DISTINCT item_id FROM lg) i, (SELECT * FROM st WHERE sd > 1e-9) s LEFT JOIN lg ON lg.item_id = i.item_id AND lg.feature = s.feature)"""


@query(_STD + " SELECT item_id, feature, round(z, 6) AS z FROM z WHERE present")
def standardize(spark, d):
    return rounded(neighbours.standardise(load(spark, d, "features")).select("item_id", "feature", "z"))


def item_vectors(spark, d):
    logged = neighbours.standardise(load(spark, d, "features"))
    s = materialize(logged, "standard")
    discard(logged)
    names = sorted(r["feature"] for r in s.select("feature").distinct().collect())
    v = materialize(neighbours.vectors(s, names), "vectors")
    discard(s)
    return v


@query(_STD + """, p AS (SELECT a.item_id AS query_id, b.item_id, round(sqrt(sum((a.z - b.z) ** 2)), 9) AS distance FROM z a JOIN z b ON a.feature = b.feature AND a.item_id <> b.item_id GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS place FROM p) SELECT query_id, item_id, CAST(place AS INT) AS place, round(distance, 6) AS distance FROM r WHERE place <= 5""")
def knn_exact(spark, d):
    v = item_vectors(spark, d)
    return rounded(neighbours.nearest(v, v, 5).select("query_id", "item_id", "place", "distance"))


@query(_STD + """, p AS (SELECT a.item_id AS query_id, b.item_id, round(sqrt(sum((a.z - b.z) ** 2)), 9) AS distance FROM z a JOIN z b ON a.feature = b.feature AND a.item_id <> b.item_id GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS place FROM p) SELECT query_id % 4 AS left_method, item_id % 7 AS right_method, count(*) AS blocks, round(0.65 / (1 + avg(distance)) + 0.35 / (1 + min(distance)), 6) AS score FROM r WHERE place <= 4 GROUP BY ALL""")
def knn_method_score(spark, d):
    v = item_vectors(spark, d)
    found = neighbours.nearest(v, v, 4).select((F.col("query_id") % 4).alias("left_method"), (F.col("item_id") % 7).alias("right_method"), "distance")
    return rounded(neighbours.closeness(found))


_BLOCKFIX = with_("blocks") + ", l AS (SELECT * FROM blocks WHERE side = 0), r AS (SELECT * FROM blocks WHERE side = 1)"


def _l1(weights: dict[str, float]) -> str:
    top = " + ".join(f"{w} * abs(l.{f} - r.{f})" for f, w in weights.items())
    low = " + ".join(f"{w} * greatest(l.{f}, r.{f})" for f, w in weights.items())
    return f"CASE WHEN {low} = 0 THEN 0 ELSE ({top}) / ({low}) END"


def block_pairs(spark, d):
    b = load(spark, d, "blocks")
    side = lambda i, s: b.where(f"side = {i}").select("pair_id", *[F.col(c).alias(f"{s}_{c}") for c in ["block_id", *neighbours.BLOCK_WEIGHTS]])
    return side(0, "l").join(side(1, "r"), "pair_id")


@query(f"{_BLOCKFIX} SELECT l.pair_id, l.block_id AS left_block, r.block_id AS right_block, round({_l1(neighbours.BLOCK_WEIGHTS)}, 6) AS distance FROM l JOIN r ON l.pair_id = r.pair_id WHERE {_l1(neighbours.BLOCK_WEIGHTS)} <= 0.5")
def block_distance(spark, d):
    at = lambda s: {f: F.col(f"{s}_{f}") for f in neighbours.BLOCK_WEIGHTS}
    found = block_pairs(spark, d).select("pair_id", F.col("l_block_id").alias("left_block"), F.col("r_block_id").alias("right_block"), neighbours.weighted_l1(at("l"), at("r"), neighbours.BLOCK_WEIGHTS).alias("distance"))
    return rounded(found.where("distance <= 0.5"))


_NUM = " + ".join(f"CASE WHEN greatest(l.{f}, r.{f}) = 0 THEN 0 ELSE abs(l.{f} - r.{f}) / greatest(l.{f}, r.{f}) END" for f in neighbours.BLOCK_WEIGHTS)


@query(f"{_BLOCKFIX} SELECT l.pair_id, count(*) AS n, round(avg(({_NUM}) / 7), 6) AS mean, round(min(({_NUM}) / 7), 6) AS least FROM l JOIN r ON l.pair_id = r.pair_id GROUP BY ALL")
def numeric_distance(spark, d):
    far = neighbours.mean_relative_difference(list(neighbours.BLOCK_WEIGHTS))
    return rounded(block_pairs(spark, d).withColumn("x", far).groupBy("pair_id").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.min("x").alias("least")))


@query()
def static_match(spark, d):
    ship(spark)
    at = lambda s: {f: F.col(f"{s}_{f}") for f in neighbours.BLOCK_WEIGHTS}
    far = block_pairs(spark, d).select("pair_id", F.col("l_block_id").cast("string").alias("left_block"), F.col("r_block_id").cast("string").alias("right_block"), neighbours.weighted_l1(at("l"), at("r"), neighbours.BLOCK_WEIGHTS).alias("distance"))
    return rounded(graphs.match_blocks(far))


@query(with_("calls") + " SELECT target, count(*) AS in_degree FROM calls GROUP BY target")
def in_degree(spark, d):
    return graphs.in_degree(load(spark, d, "calls"))


@query(with_("edges") + " SELECT graph_id, node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT graph_id, src AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT graph_id, dst, 1, 0 FROM edges) GROUP BY ALL")
def block_degrees(spark, d):
    return graphs.degrees(load(spark, d, "edges"))


def _wl(k: int) -> str:
    h = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"
    out = f"b AS (SELECT graph_id, src AS at, dst AS of, 'o' || kind AS way FROM edges UNION ALL SELECT graph_id, dst, src, 'i' || kind FROM edges), w0 AS (SELECT graph_id, node, {h.format('label')} AS l FROM graph_nodes)"
    for i in range(k):
        out += f""", n{i} AS (SELECT b.graph_id, b.at AS node, array_to_string(list_sort(list(b.way || ':' || w.l)), ',') AS near FROM b JOIN w{i} w ON w.graph_id = b.graph_id AND w.node = b.of GROUP BY ALL),
  w{i + 1} AS (SELECT w.graph_id, w.node, {h.format("w.l || '|' || coalesce(near, '')")} AS l FROM w{i} w LEFT JOIN n{i} USING (graph_id, node))"""
    return out


@query(with_("edges", "graph_nodes") + f", {_wl(3)} SELECT graph_id, node, l AS label3 FROM w3")
def wl_labels(spark, d):
    return graphs.wl_labels(load(spark, d, "graph_nodes"), load(spark, d, "edges")).select("graph_id", "node", "label3")


@query(with_("chains", "chain_nodes") + f""", edges AS (SELECT * FROM chains), graph_nodes AS (SELECT * FROM chain_nodes), {_wl(2)}, x AS (SELECT graph_id // 2 AS pair_id, graph_id % 2 AS s, node, l AS wl2, (SELECT l FROM w1 WHERE w1.graph_id = w2.graph_id AND w1.node = w2.node) AS wl1 FROM w2),
  h AS (SELECT a.pair_id, a.node AS left_node, b.node AS right_node, 1.0 AS st, 'WL2' AS e FROM x a JOIN x b ON a.pair_id = b.pair_id AND a.wl2 = b.wl2 AND a.s = 0 AND b.s = 1 UNION ALL SELECT a.pair_id, a.node, b.node, 0.8, 'WL1' FROM x a JOIN x b ON a.pair_id = b.pair_id AND a.wl1 = b.wl1 AND a.s = 0 AND b.s = 1)
  SELECT CAST(pair_id AS BIGINT) AS pair_id, left_node, right_node, max(st)::DOUBLE AS strength, array_to_string(list_sort(list(DISTINCT e)), ',') AS evidence FROM h GROUP BY ALL""")
def seed_buckets(spark, d):
    w = graphs.wl_labels(load(spark, d, "chain_nodes"), load(spark, d, "chains"), 2)
    side = lambda s: w.where(F.col("graph_id") % 2 == s).select(F.floor(F.col("graph_id") / 2).alias("pair_id"), "node", "label1", "label2")
    s = graphs.seeds(side(0), side(1), [("label2", 1.0, "WL2"), ("label1", 0.8, "WL1")])
    return s.select("pair_id", "left_node", "right_node", "strength", F.array_join("evidence", ",").alias("evidence"))


@query("WITH a AS (SELECT l_orderkey % 300 AS pair_id, l_partkey % 4 AS region, CASE l_suppkey % 4 WHEN 0 THEN 'CALL' WHEN 1 THEN 'ARITHMETIC' WHEN 2 THEN 'RETURN' ELSE 'ASSIGNMENT' END AS op, CASE l_linenumber % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 ELSE 0.5 END AS g FROM lineitem),"
       " r AS (SELECT pair_id, region, count(*) AS pairs, avg(g::DOUBLE) AS s, sum((CASE op WHEN 'CALL' THEN 0.8 WHEN 'ASSIGNMENT' THEN 0.6 WHEN 'RETURN' THEN 0.1 ELSE 1.0 END)::DOUBLE) AS c FROM a GROUP BY ALL) SELECT pair_id, region, pairs, round(s, 6) AS strength, round(c, 6) AS coverage, round(c * (0.5 + 0.5 * s), 6) AS priority FROM r")
def region_priority(spark, d):
    a = load(spark, d, "lineitem").selectExpr("l_orderkey % 300 AS pair_id", "l_partkey % 4 AS region", "CASE l_suppkey % 4 WHEN 0 THEN 'CALL' WHEN 1 THEN 'ARITHMETIC' WHEN 2 THEN 'RETURN' ELSE 'ASSIGNMENT' END AS op", "CASE l_linenumber % 3 WHEN 0 THEN 1.0e0 WHEN 1 THEN 0.8e0 ELSE 0.5e0 END AS agreement")
    return rounded(graphs.region_totals(a))


@query(with_("tree_nodes") + """, h2 AS (SELECT tree_id, node_id, parent_id, ordinal, CAST('0x' || substr(md5(label), 1, 15) AS BIGINT) AS h, 1 AS n FROM tree_nodes WHERE depth = 2),
  h1 AS (SELECT t.tree_id, t.node_id, t.parent_id, t.ordinal, CAST('0x' || substr(md5(concat_ws('|', any_value(t.label), string_agg(k.h::VARCHAR, ',' ORDER BY k.ordinal, k.h))), 1, 15) AS BIGINT) AS h, 1 + coalesce(sum(k.n), 0) AS n FROM tree_nodes t LEFT JOIN h2 k ON k.tree_id = t.tree_id AND k.parent_id = t.node_id WHERE t.depth = 1 GROUP BY ALL),
  h0 AS (SELECT t.tree_id, t.node_id, t.parent_id, t.ordinal, CAST('0x' || substr(md5(concat_ws('|', any_value(t.label), string_agg(k.h::VARCHAR, ',' ORDER BY k.ordinal, k.h))), 1, 15) AS BIGINT) AS h, 1 + coalesce(sum(k.n), 0) AS n FROM tree_nodes t LEFT JOIN h1 k ON k.tree_id = t.tree_id AND k.parent_id = t.node_id WHERE t.depth = 0 GROUP BY ALL)
  SELECT tree_id, node_id, h AS hash, CAST(n AS BIGINT) AS size FROM h0 UNION ALL SELECT tree_id, node_id, h, CAST(n AS BIGINT) FROM h1 UNION ALL SELECT tree_id, node_id, h, n FROM h2""")
def subtree_hash(spark, d):
    return graphs.tree_levels(load(spark, d, "tree_nodes"), 2).select("tree_id", "node_id", "hash", "size")


# --- evaluation --------------------------------------------------------------------------------------------------

_SWEEP = with_("scored") + """, s AS (SELECT t AS threshold, count(*) FILTER (WHERE score >= t AND positive) AS tp, count(*) FILTER (WHERE score < t AND positive) AS fn, count(*) FILTER (WHERE score >= t AND NOT positive) AS fp, count(*) FILTER (WHERE score < t AND NOT positive) AS tn
    FROM scored, (SELECT unnest(range(5, 96, 5)) AS t) GROUP BY t), m AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r FROM s)"""


@query(_SWEEP + " SELECT threshold, tp, fn, fp, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM m")
def threshold_sweep(spark, d):
    return rounded(evaluation.threshold_sweep(load(spark, d, "scored")))


@query(_SWEEP + ", pts AS (SELECT DISTINCT r, p FROM m UNION SELECT 0, 1 UNION SELECT 1, 0), l AS (SELECT r, p, lag(r) OVER o AS r0, lag(p) OVER o AS p0 FROM pts WINDOW o AS (ORDER BY r, p)) SELECT round(sum((r - r0) * (p + p0) / 2), 6) AS auc FROM l")
def auc_pr(spark, d):
    return rounded(evaluation.auc_pr(evaluation.threshold_sweep(load(spark, d, "scored"))))


@query(with_("labelled", "results") + """ SELECT coalesce(band, expected_type) AS "group", count(*) AS pairs, count(*) FILTER (WHERE status = 'OK' AND coverage >= 0.7) AS detected, count(*) FILTER (WHERE CASE WHEN expected_type = 'NON_CLONE' THEN coverage < 0.7 ELSE coverage >= 0.7 AND found_type = expected_type END) AS type_hits,
  count(*) FILTER (WHERE status <> 'OK') AS errors, count(*) FILTER (WHERE status = 'OK' AND coverage < 0.7 AND coverage > 0) AS sub_coverage, round(avg(wall_ms), 6) AS mean_ms, round(median(wall_ms), 6) AS median_ms FROM results JOIN labelled USING (pair_id) GROUP BY ALL""")
def dual_metric(spark, d):
    return rounded(evaluation.dual_metric(load(spark, d, "labelled"), load(spark, d, "results")))


@query(with_("labelled", "results") + " SELECT project, count(*) AS pairs, round(avg((expected_type = found_type)::INT), 6) AS type_accuracy, round(avg(runtime_ms), 6) AS mean_ms FROM results JOIN labelled USING (pair_id) GROUP BY ALL")
def project_accuracy(spark, d):
    r = load(spark, d, "results").join(load(spark, d, "labelled"), "pair_id")
    return rounded(evaluation.accuracy(r, "project", {"type_accuracy": ("expected_type", "found_type")}))


@query(with_("labelled", "results") + " SELECT CASE WHEN expected_type = 'NON_CLONE' THEN CASE WHEN coverage < 0.2 THEN 'RESTRAINED' ELSE 'FAIL' END WHEN starts_with(expected_type, 'T4') THEN CASE WHEN found_type = expected_type THEN 'PASS' ELSE 'EXPLORATORY' END WHEN found_type = expected_type THEN 'PASS' ELSE 'FAIL' END AS outcome, count(*) AS n FROM results JOIN labelled USING (pair_id) GROUP BY ALL")
def expectation_status(spark, d):
    r = load(spark, d, "results").join(load(spark, d, "labelled"), "pair_id")
    return r.groupBy(evaluation.expectation(F.col("expected_type"), F.col("found_type"), F.col("coverage")).alias("outcome")).agg(F.count("*").alias("n"))


_STAB = with_("channel_values") + """, s AS (SELECT DISTINCT * FROM channel_values), n AS (SELECT channel, variant, count(*) AS n FROM s GROUP BY ALL), i AS (SELECT a.channel, a.variant AS v1, b.variant AS v2, count(*) AS c FROM s a JOIN s b ON a.channel = b.channel AND a.value = b.value AND a.variant < b.variant GROUP BY ALL),
  p AS (SELECT a.channel, coalesce(c, 0) / (a.n + b.n - coalesce(c, 0)) AS j FROM n a JOIN n b ON a.channel = b.channel AND a.variant < b.variant LEFT JOIN i ON i.channel = a.channel AND i.v1 = a.variant AND i.v2 = b.variant),
  st AS (SELECT channel, avg(j) AS a, stddev_pop(j) AS sd, count(*) AS k FROM p GROUP BY channel), cv AS (SELECT channel, count(DISTINCT variant) / (SELECT count(DISTINCT variant) FROM s) AS cov, count(DISTINCT value) AS dv FROM s GROUP BY channel)"""


@query(_STAB + " SELECT channel, round(a, 6) AS avg_stability, round(sd, 6) AS stability_std, round(cov, 6) AS coverage, dv AS distinct_values, k AS pair_count FROM st JOIN cv USING (channel)")
def channel_stability(spark, d):
    return rounded(evaluation.channel_stability(load(spark, d, "channel_values")))


@query(_STAB + " SELECT channel, CASE WHEN a >= 0.9 AND cov >= 0.5 THEN 'KEEP' WHEN a >= 0.7 AND cov >= 0.2 THEN 'REVIEW' ELSE 'DROP' END AS decision FROM st JOIN cv USING (channel)")
def channel_decision(spark, d):
    s = evaluation.channel_stability(load(spark, d, "channel_values"))
    return s.select("channel", evaluation.channel_decision(F.col("avg_stability"), F.col("coverage")).alias("decision"))


_BAND = "CASE WHEN least(sim_line, sim_token) >= 0.9 THEN 'VST3' WHEN least(sim_line, sim_token) >= 0.7 THEN 'ST3' WHEN least(sim_line, sim_token) >= 0.5 THEN 'MT3' ELSE 'WT3T4' END"


@query(with_("clones", "functions") + f" SELECT {_BAND} AS band, count(*) AS n, CAST(sum(a.lines + b.lines) AS BIGINT) AS lines FROM clones JOIN functions a ON one_id = a.id JOIN functions b ON two_id = b.id WHERE min_size >= 20 GROUP BY ALL")
def star_join_bands(spark, d):
    j = evaluation.star_join(load(spark, d, "clones"), load(spark, d, "functions"), 20)
    return j.groupBy("band").agg(F.count("*").alias("n"), F.sum(F.col("one_lines") + F.col("two_lines")).cast("long").alias("lines"))


@query("SELECT c_custkey, c_mktsegment, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(concat_ws(':', c_custkey::VARCHAR, '7')), c_custkey) AS INT) AS place FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(concat_ws(':', c_custkey::VARCHAR, '7')), c_custkey) <= 20")
def stratified_sample(spark, d):
    return evaluation.stratified(load(spark, d, "customer"), "c_mktsegment", "c_custkey", 20, "7").select("c_custkey", "c_mktsegment", "place")


@query("SELECT pair_id FROM (SELECT o_orderkey AS pair_id FROM orders) WHERE pair_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def resume_anti_join(spark, d):
    manifest = load(spark, d, "orders").select(F.col("o_orderkey").alias("pair_id"))
    return io.remaining(manifest, load(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("pair_id")))


@query("SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) % 8 AS INT) AS shard FROM orders")
def round_robin_shards(spark, d):
    return evaluation.shards(load(spark, d, "orders").select("o_orderkey"), "o_orderkey", 8)


@query("SELECT doc_id, CASE WHEN 2 <= len(l) AND doc_id % 3 + 2 <= len(l) THEN md5('class Wrapped {' || chr(10) || array_to_string(l[2:doc_id % 3 + 2], chr(10)) || chr(10) || '}' || chr(10)) END AS fragment FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def fragment_cut(spark, d):
    return docs(spark, d).select("doc_id", F.md5(io.cut_fragment(F.col("text"), F.lit(2), (F.col("doc_id") % 3 + 2).cast("int"), "Wrapped")).alias("fragment"))


@query("WITH p AS (SELECT s_name AS name, s_suppkey % 3 AS rank, 'd' || (s_suppkey % 3) || '/' || s_name AS path FROM supplier WHERE s_suppkey % 5 <> 0) SELECT name, min_by(path, rank) AS path FROM (SELECT s_name AS name FROM supplier) LEFT JOIN p USING (name) GROUP BY name")
def resolve_files(spark, d):
    s = load(spark, d, "supplier")
    places = s.where("s_suppkey % 5 <> 0").selectExpr("s_name AS name", "s_suppkey % 3 AS rank", "'d' || CAST(s_suppkey % 3 AS STRING) || '/' || s_name AS path")
    return io.resolve(s.select(F.col("s_name").alias("name")).distinct(), places)


@query("SELECT method FROM (SELECT l_partkey AS method, l_linenumber AS variant, l_quantity AS blocks FROM lineitem WHERE l_linenumber <= 4) WHERE blocks >= 5 GROUP BY method HAVING count(DISTINCT variant) = 4")
def all_variants(spark, d):
    rows = load(spark, d, "lineitem").where("l_linenumber <= 4").selectExpr("l_partkey AS method", "l_linenumber AS variant", "l_quantity AS blocks")
    return evaluation.in_all_variants(rows, "method", "variant", "blocks").select("method")


# --- syntax and semantics ----------------------------------------------------------------------------------------

JAVA = '''package demo;
import java.util.List;
public class Sum {{
  private int seed = {0};
  // adds up
  public int total(List<Integer> xs) {{
    int s = seed;
    for (int x : xs) {{ s += x; log(s); }}
    if (s > {0}) {{ return s; }} else {{ s = s - 1; }}
    return helper(s);
  }}
  private int helper(int v) {{ return v * {1}; }}
}}
'''


def java_files(spark, d):
    """Sources written for these queries: the tables hold none."""
    n = load(spark, d, "nation").select(F.col("n_nationkey").alias("file_id"))
    return n.select("file_id", F.format_string(JAVA.replace("{{", "{").replace("}}", "}").replace("{0}", "%1$d").replace("{1}", "%2$d"), F.col("file_id"), F.col("file_id") % 3).alias("text"))


@query()
def ast_methods(spark, d):
    ship(spark)
    return syntax.methods(syntax.ast_nodes(java_files(spark, d)))


@query()
def ast_linearised(spark, d):
    ship(spark)
    return syntax.linearised(syntax.ast_nodes(java_files(spark, d)), outside_methods=True).select("file_id", F.array_join("labels", " ").alias("labels"))


@query()
def external_calls(spark, d):
    ship(spark)
    files = java_files(spark, d)
    return syntax.external_calls(files.select("file_id", lexical.raw_tokens(F.col("text")).alias("tokens")), syntax.ast_nodes(files))


@query()
def ted(spark, d):
    ship(spark)
    rows = spark.createDataFrame([(1, [(0, "a"), (1, "b"), (0, "r")], [(0, "a"), (0, "r")]), (2, [(0, "x")], [(0, "y")])], "id int, a array<struct<leaf:int,label:string>>, b array<struct<leaf:int,label:string>>")
    return rows.select("id", sequence.tree_distance_column(F.col("a"), F.col("b")).alias("distance"))


@query()
def poly_equivalence(spark, d):
    ship(spark)
    n = load(spark, d, "nation").select("n_nationkey")
    left = F.format_string('["*", ["+", ["param", 0], ["const", %d]], ["param", 1]]', F.col("n_nationkey"))
    right = F.when(F.col("n_nationkey") % 2 == 0, F.format_string('["+", ["*", ["param", 1], ["param", 0]], ["*", ["const", %d], ["param", 1]]]', F.col("n_nationkey"))).otherwise(F.lit('["/", ["param", 0], ["const", 2]]'))
    return n.select("n_nationkey", semantic.equivalence_column(left, right).alias("v")).select("n_nationkey", "v.proof", "v.sampling")


@query()
def mcs(spark, d):
    ship(spark)
    import pyarrow as pa

    e = load(spark, d, "edges").select(F.floor(F.col("graph_id") / 2).alias("pair_id"), (F.col("graph_id") % 2).alias("s"), "src", "dst")

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        sides = [{(r["src"], r["dst"]) for r in rows if r["s"] == s} for s in (0, 1)]
        nodes = [{x for p in side for x in p} for side in sides]
        far = {(a, b): 0.0 if a == b else 0.4 for a in nodes[0] for b in nodes[1]}
        x = graphs.common_subgraph(far, sides[0], sides[1], (len(nodes[0]), len(nodes[1])))
        return pa.table({"pair_id": pa.array([rows[0]["pair_id"]], pa.int64()), "distance": pa.array([x], pa.float64()), "loops": pa.array([graphs.loops(sorted(sides[0]))], pa.int64())})

    return rounded(e.groupBy("pair_id").applyInArrow(run, "pair_id long, distance double, loops long"))


@query()
def region_grow(spark, d):
    ship(spark)
    import pyarrow as pa

    e = load(spark, d, "edges").select(F.floor(F.col("graph_id") / 2).alias("pair_id"), (F.col("graph_id") % 2).alias("s"), "src", "dst")

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        names = sorted({x for r in rows for x in (r["src"], r["dst"])})
        number = {x: i for i, x in enumerate(names)}
        sides = []
        for s in (0, 1):
            g = {number[x]: {"label": x[:1], "value": 0, "wl": number[x], "kind": "STATEMENT", "op": "OTHER", "out": [], "in": []} for r in rows if r["s"] == s for x in (r["src"], r["dst"])}
            for a, b in sorted({(r["src"], r["dst"]) for r in rows if r["s"] == s}):
                g[number[a]]["out"].append(number[b])
                g[number[b]]["in"].append(number[a])
            sides.append(g)
        both = sorted(set(sides[0]) & set(sides[1]))
        found = graphs.grow_regions([(x, x) for x in both], *sides)
        n = len(found)
        return pa.table({"pair_id": pa.array([rows[0]["pair_id"]] * n, pa.int64()), "region": pa.array(range(n), pa.int32()), "pairs": pa.array([len(r) for r in found], pa.int32())})

    return e.groupBy("pair_id").applyInArrow(run, "pair_id long, region int, pairs int")

