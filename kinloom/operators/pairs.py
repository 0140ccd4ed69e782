"""From scored pairs of methods to a verdict on a pair of files.

``features`` derives a pair's indicators; ``best_matches`` and ``merge_directions`` pick each method's
counterpart in both directions; ``summarise`` aggregates a file pair; ``classify`` decides type,
scope and confidence. All are relational: a row a method pair, then a row a file pair.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-9
# Thresholds of the verdict.
HIGH, MEDIUM, LOW, WEAK_T4, MARGIN, WEAK_CAP, UNDECIDED = 0.75, 0.45, 0.30, 0.65, 0.10, 0.70, 0.35
# Thresholds of the file-pair flags.
ASYMMETRIC, PARTIAL_SIGNAL, UNCONFIRMED, VARIANCE, SMALL_METHOD = 0.25, 0.45, 0.5, 0.10, 10
# Limits of the input profile.
TINY_TREE, BALANCED, UNEVEN, DENSE_CALLS, COSTLY_PAIRS = 5, 0.60, 0.50, 5, 200


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def mean(*xs: Column) -> Column:
    return reduce(lambda a, b: a + b, xs) / len(xs)


def ratio(a: Column, b: Column, empty: float) -> Column:
    """The smaller over the larger; ``empty`` where both are 0."""
    return F.when(F.greatest(a, b) == 0, F.lit(empty)).otherwise(F.least(a, b) / F.greatest(a, b))


def features(pairs: DataFrame) -> DataFrame:
    """Adds magnitude, divergence, exactness, gap, spread, size_ratio and containments to (s2, s3, s4, inter, count_*, size_*)."""
    c = F.col
    root = F.sqrt(F.lit(2.0))
    out = pairs.withColumn("magnitude", F.sqrt(c("s3") * c("s3") + c("s4") * c("s4")) / root)
    share = lambda n: F.when(c(n) == 0, F.lit(0.0)).otherwise(c("inter") / c(n))
    return out.select(
        "*",
        F.when(c("magnitude") == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (c("s3") - c("s4")) / (c("magnitude") * root)))).alias("divergence"),
        clamp((c("s2") + EPS) / (c("s4") + EPS)).alias("exactness"),
        clamp((c("s3") - c("s2")) / (c("s3") + EPS)).alias("gap"),
        (F.greatest("s2", "s3", "s4") - F.least("s2", "s3", "s4")).alias("spread"),
        ratio(c("size_a"), c("size_b"), 0.0).alias("size_ratio"),
        share("count_a").alias("cont_a_in_b"), share("count_b").alias("cont_b_in_a"),
        ((c("count_a") == 0) | (c("count_b") == 0)).alias("low_token_evidence"),
    )


def match_scores(feats: DataFrame) -> DataFrame:
    held = F.greatest("cont_a_in_b", "cont_b_in_a") * F.sqrt("size_ratio")
    return feats.select(
        "*",
        F.greatest("magnitude", held).alias("match_score"),
        F.when(held > F.col("magnitude"), "CONTAINMENT_DOMINANT").otherwise("MAGNITUDE_DOMINANT").alias("reason"),
    )


def _ranked(scored: DataFrame, side: str) -> Column:
    order = [F.desc(x) for x in ("match_score", "magnitude", "exactness", "size_ratio")] + [F.col("method_a"), F.col("method_b")]
    return F.row_number().over(Window.partitionBy("pair_id", side).orderBy(*order))


def best_matches(scored: DataFrame, side: str) -> DataFrame:
    """The best counterpart of each method of a side (method_a or method_b); ties by magnitude, exactness, size ratio, names."""
    return scored.withColumn("_r", _ranked(scored, side)).where("_r = 1").drop("_r")


def merge_directions(scored: DataFrame) -> DataFrame:
    """Pairs that are best in one direction or both; no join. Dealt by file pair once, which serves both rankings and what follows by pair."""
    both = scored.repartition("pair_id").withColumn("_f", _ranked(scored, "method_a") == 1).withColumn("_b", _ranked(scored, "method_b") == 1).where("_f or _b")
    way = F.when(F.col("_f") & F.col("_b"), "BIDIRECTIONAL").when(F.col("_f"), "A_TO_B_ONLY").otherwise("B_TO_A_ONLY")
    weight = F.col("match_score") * F.least(F.lit(1.0), F.least("size_a", "size_b") / SMALL_METHOD)
    return both.select(*scored.columns, way.alias("direction"), (F.col("_f") & F.col("_b")).alias("confirmed"), weight.alias("weight"))


def coverage(merged: DataFrame, methods: DataFrame) -> DataFrame:
    """(pair_id, side, method, tree_size, covered, confirmed) from methods (pair_id, side, method, tree_size): 0 where nothing matched."""
    sides = [
        merged.select("pair_id", F.lit(s.upper()).alias("side"), F.col(f"method_{s}").alias("method"), "match_score", "confirmed") for s in ("a", "b")
    ]
    best = sides[0].unionByName(sides[1]).groupBy("pair_id", "side", "method").agg(F.max("match_score").alias("covered"), F.max("confirmed").alias("confirmed"))
    joined = methods.join(best, ["pair_id", "side", "method"], "left")
    return joined.select("pair_id", "side", "method", "tree_size", F.coalesce("covered", F.lit(0.0)).alias("covered"), F.coalesce("confirmed", F.lit(False)).alias("confirmed"))


def coverage_totals(covered: DataFrame) -> DataFrame:
    size = F.sum("tree_size")
    share = lambda x: F.when(size == 0, F.lit(0.0)).otherwise(F.sum(F.col("tree_size") * x) / size)
    per = covered.groupBy("pair_id", "side").agg(share(F.col("covered")).alias("c"), share(F.col("confirmed").cast("int")).alias("k"))
    pick = lambda s, x: F.coalesce(F.max(F.when(F.col("side") == s, F.col(x))), F.lit(0.0))
    return per.groupBy("pair_id").agg(pick("A", "c").alias("coverage_a"), pick("B", "c").alias("coverage_b"), pick("A", "k").alias("confirmed_a"), pick("B", "k").alias("confirmed_b"))


def least_covered(covered: DataFrame, limit: int = 3) -> DataFrame:
    """The least covered methods of each side; ties by name."""
    order = F.row_number().over(Window.partitionBy("pair_id", "side").orderBy("covered", "method"))
    return covered.withColumn("place", order).where(F.col("place") <= limit).select("pair_id", "side", "place", "method", "covered")


def weighted(merged: DataFrame) -> DataFrame:
    """Weighted means and variances of a file pair; equal weights where all are 0. Two moments in one aggregation, centred by a window first."""
    every = Window.partitionBy("pair_id")
    total = F.sum("weight").over(every)
    laid = merged.withColumn("_w", F.when(total == 0, F.lit(1.0)).otherwise(F.col("weight"))).withColumn("_low", (total == 0) | (F.min("weight").over(every) == 0))
    avg = lambda x: F.sum(x * F.col("_w")) / F.sum("_w")
    for s in ("s3", "s4"):
        laid = laid.withColumn(f"_{s}", F.col(s) - F.sum(F.col(s) * F.col("_w")).over(every) / F.sum("_w").over(every))
    c = F.col
    return laid.groupBy("pair_id").agg(
        F.count("*").alias("matches"),
        *[avg(c(x)).alias(n) for x, n in (("magnitude", "magnitude_avg"), ("match_score", "match_score_avg"), ("s3", "centroid_s3"), ("s4", "centroid_s4"), ("divergence", "divergence_avg"), ("spread", "spread_avg"), ("exactness", "exactness_avg"), ("gap", "gap_avg"))],
        avg(c("_s3") * c("_s3")).alias("variance_s3"), avg(c("_s4") * c("_s4")).alias("variance_s4"),
        avg(c("cont_a_in_b") * (1 - c("size_ratio"))).alias("partial_a_in_b"), avg(c("cont_b_in_a") * (1 - c("size_ratio"))).alias("partial_b_in_a"),
        F.avg(c("confirmed").cast("double")).alias("confirmed_ratio"), F.max("_low").alias("low_evidence"),
    )


def summarise(feats: DataFrame, methods: DataFrame) -> DataFrame:
    """A row a file pair: means, variances, coverages, partial signals and flags."""
    merged = merge_directions(match_scores(feats))
    stats = weighted(merged).join(coverage_totals(coverage(merged, methods)), "pair_id")
    c = F.col
    partial = F.greatest("partial_a_in_b", "partial_b_in_a")
    flag = lambda test, name: F.when(test, F.lit(name))
    flags = F.array(
        flag(F.abs(c("coverage_a") - c("coverage_b")) >= ASYMMETRIC, "ASYMMETRIC_COVERAGE"),
        flag((c("variance_s3") >= VARIANCE) | (c("variance_s4") >= VARIANCE), "HIGH_VARIANCE"),
        flag(c("low_evidence"), "LOW_EVIDENCE"),
        flag(c("confirmed_ratio") < UNCONFIRMED, "MANY_UNCONFIRMED_MATCHES"),
        flag(partial >= PARTIAL_SIGNAL, "PARTIAL_PATTERN_PRESENT"),
    )
    return stats.withColumn("partial_signal", partial).withColumn("flags", F.array_compact(flags))


def profile(files: DataFrame) -> DataFrame:
    """Input profile of a pair from (methods_*, classes_*, nodes_*, outside_*, calls_*, trivial_*): mode, flags, enabled signals."""
    c = F.col
    context = lambda s: (c(f"outside_{s}") >= 4) | (c(f"classes_{s}") > 1)
    heavy = lambda s: (c(f"methods_{s}") > 0) & (c(f"trivial_{s}") >= F.greatest(F.lit(2), F.floor(c(f"methods_{s}") / 2)))
    one = lambda s: c(f"methods_{s}") == 1
    none = lambda s: c(f"methods_{s}") == 0
    weak = ~context("a") | ~context("b")
    mode = (
        F.when((c("nodes_a") <= TINY_TREE) & (c("nodes_b") <= TINY_TREE), "EMPTY_OR_TOO_SMALL")
        .when(none("a") | none("b"), "NO_METHOD_CLASS_CONTEXT")
        .when(one("a") & one("b"), F.when(context("a") | context("b"), "SINGLE_METHOD_REAL_FILE").otherwise("BCB_SINGLE_METHOD_FRAGMENT"))
        .when(one("a") | one("b"), "ONE_TO_MANY_METHOD")
        .when(ratio(c("methods_a"), c("methods_b"), 1.0) >= BALANCED, "MULTI_METHOD_BALANCED")
        .otherwise("MULTI_METHOD_UNBALANCED")
    )
    flags = {
        "API_DENSE": c("calls_a") + c("calls_b") >= DENSE_CALLS,
        "ASYMMETRIC_FILE_SIZE": ratio(c("nodes_a"), c("nodes_b"), 1.0) < UNEVEN,
        "ASYMMETRIC_METHOD_PRESENCE": none("a") != none("b"),
        "CLASS_CONTEXT_STRONG": context("a") | context("b"),
        "CLASS_CONTEXT_WEAK": weak,
        "S4_COST_RISK": c("methods_a").cast("long") * c("methods_b") > COSTLY_PAIRS,
        "TRIVIAL_METHOD_HEAVY": heavy("a") | heavy("b"),
    }
    told = files.withColumn("mode", mode).withColumn("flags", F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in flags.items()])))
    empty, bare = c("mode") == "EMPTY_OR_TOO_SMALL", c("mode") == "NO_METHOD_CLASS_CONTEXT"
    s1 = F.when((c("mode") == "BCB_SINGLE_METHOD_FRAGMENT") | F.array_contains("flags", "CLASS_CONTEXT_WEAK"), "ENABLED_WEAK").when(empty, "DISABLED").otherwise("ENABLED")
    mid = F.when(empty | bare, "DISABLED").otherwise("ENABLED")
    return told.select("*", s1.alias("signal_s1"), mid.alias("signal_s2_s3_s4"), F.when(empty, "DISABLED").otherwise("ENABLED_IF_APPLICABLE").alias("signal_s5"))


def level(x: Column) -> Column:
    return F.when(x >= HIGH, "HIGH").when(x >= MEDIUM, "MEDIUM").otherwise("LOW")


def classify(summary: DataFrame) -> DataFrame:
    """Verdict columns for rows of summarise() with s1, s5 (-1: not applicable), exact_match, parse_ok and profile_flags beside them."""
    c = F.col
    has = lambda f: F.array_contains("profile_flags", f)
    method = mean(c("match_score_avg"), c("magnitude_avg"), c("centroid_s3"), c("centroid_s4"))
    cover = mean(c("coverage_a"), c("coverage_b"))
    lean = F.abs(c("coverage_a") - c("coverage_b"))
    partial = mean(c("partial_signal"), F.greatest("partial_a_in_b", "partial_b_in_a"), lean)
    api, changed = c("s5"), mean(c("gap_avg"), c("spread_avg"))
    reliable = F.when(has("CLASS_CONTEXT_WEAK"), F.lit(0.0)).otherwise(c("s1"))
    scored = summary.select(
        "*", method.alias("method_strength"), cover.alias("cover_strength"),
        clamp(mean(c("coverage_a"), c("coverage_b"), c("confirmed_a"), c("confirmed_b"), c("confirmed_ratio")) * (1 - c("partial_signal"))).alias("scope_full"),
        clamp(partial).alias("scope_partial"),
        clamp(mean(c("variance_s3"), c("variance_s4"), c("spread_avg"))).alias("scope_mixed"),
        c("exact_match").cast("double").alias("t1"),
        clamp(mean(method, c("exactness_avg"), 1 - changed, cover)).alias("t2"),
        clamp(mean(method, c("centroid_s4"), changed, cover)).alias("t3"),
        F.when(api < 0, F.lit(0.0)).otherwise(clamp(mean(api, 1 - method, reliable))).alias("t4"),
        clamp(mean(1 - method, 1 - cover, 1 - partial, F.when(api >= 0, 1 - api).otherwise(F.lit(0.5)))).alias("non_clone"),
    )
    kind = (
        F.when(~c("parse_ok"), "INCONCLUSIVE")
        .when(c("exact_match"), "T1")
        .when((c("t4") >= WEAK_T4) & (c("t4") > F.greatest("t2", "t3")) & (c("method_strength") < HIGH), "T4_WEAK")
        .when((c("method_strength") >= MEDIUM) & (c("cover_strength") >= LOW), F.when(c("t2") >= c("t3"), "T2").otherwise("T3"))
        .when((c("t4") >= HIGH) & (c("method_strength") < HIGH), "T4_WEAK")
        .when(c("non_clone") >= HIGH, "NON_CLONE")
        .otherwise("INCONCLUSIVE")
    )
    scope = (
        F.when((c("scope_partial") >= MEDIUM) & (c("scope_partial") > c("scope_full")), "PARTIAL")
        .when((c("scope_full") >= MEDIUM) & (c("scope_full") >= c("scope_mixed")), "FULL")
        .when(c("scope_mixed") >= MEDIUM, "MIXED")
        .otherwise("UNKNOWN")
    )
    typed = scored.withColumn("_scope", scope).withColumn("clone_type", kind)
    typed = typed.withColumn("scope", F.when(c("clone_type") == "NON_CLONE", "UNKNOWN").otherwise(c("_scope")))
    full = c("scope") == "FULL"
    strength = F.coalesce(*[F.when(c("clone_type") == n, c(x)) for n, x in (("T1", "t1"), ("T2", "t2"), ("T3", "t3"), ("T4_WEAK", "t4"), ("NON_CLONE", "non_clone"))], F.lit(UNDECIDED))
    variance = F.when(full, F.lit(0.25)).otherwise(F.lit(0.15))
    consistent = clamp(1 - F.when(full, F.lit(0.50)).otherwise(F.lit(0.35)) * c("spread_avg") - variance * (c("variance_s3") + c("variance_s4")))
    less = F.when(has("BOILERPLATE_HEAVY"), 0.10).otherwise(0.0) + F.when(has("TRIVIAL_METHOD_HEAVY"), 0.10).otherwise(0.0) + F.when(has("S4_COST_RISK"), 0.05).otherwise(0.0)
    sure = F.when(~c("parse_ok"), F.lit(0.20)).otherwise(clamp(F.when(c("low_evidence"), F.least(1 - less, F.lit(0.5))).otherwise(1 - less)))
    judged = typed.select("*", strength.alias("strength"), consistent.alias("consistency"), sure.alias("reliability"))
    confidence = clamp(c("strength") * c("consistency") * c("reliability"))
    way = F.when(c("scope") != "PARTIAL", "NONE").when(c("partial_a_in_b") > c("partial_b_in_a") + MARGIN, "A_IN_B").when(c("partial_b_in_a") > c("partial_a_in_b") + MARGIN, "B_IN_A").otherwise("UNKNOWN")
    wide = F.coalesce(*[F.when(c("scope") == n, c(f"scope_{n.lower()}")) for n in ("FULL", "PARTIAL", "MIXED")], F.lit(UNDECIDED))
    out = judged.withColumn("confidence", F.when(c("clone_type") == "T4_WEAK", F.least(confidence, F.lit(WEAK_CAP))).otherwise(confidence))
    out = out.withColumn("direction", way).withColumn("scope_confidence", wide)
    return out.withColumn("confidence_level", level(c("confidence"))).withColumn("scope_level", level(c("scope_confidence"))).drop("_scope")


def evidence(verdict: DataFrame) -> DataFrame:
    """(pair_id, place, signal, value as %.4f, supports, level): what speaks for the type and the scope, a row an item."""
    c = F.col
    items = {
        "T1": [("file_exact_normalized_match", F.lit(1.0), "T1")],
        "T2": [("structural_exactness_avg", c("exactness_avg"), "T2"), ("method_similarity_strength", c("method_strength"), "T2"), ("modification_strength", (c("gap_avg") + c("spread_avg")) / 2, "T3")],
        "T3": [("method_similarity_strength", c("method_strength"), "T3"), ("modification_strength", (c("gap_avg") + c("spread_avg")) / 2, "T3"), ("structural_exactness_avg", c("exactness_avg"), "T2")],
        "T4_WEAK": [("S5", c("s5"), "T4_WEAK")],
        "NON_CLONE": [("method_dissimilarity_strength", 1 - c("method_strength"), "NON_CLONE"), ("uncovered_method_mass", 1 - c("cover_strength"), "NON_CLONE")],
    }
    scopes = {
        "PARTIAL": [("partial_clone_signal", c("partial_signal")), ("coverage_asymmetry", F.abs(c("coverage_a") - c("coverage_b")))],
        "FULL": [("confirmed_ratio", c("confirmed_ratio")), ("coverage_A/B", F.least("coverage_a", "coverage_b"))],
        "MIXED": [("spread_avg", c("spread_avg"))],
    }
    row = lambda test, signal, x, supports: F.when(test, F.struct(F.lit(signal).alias("signal"), F.format_string("%.4f", x.cast("double")).alias("value"), F.lit(supports).alias("supports"), level(x).alias("level")))
    told = [row(c("clone_type") == k, *x) for k, xs in items.items() for x in xs] + [row(c("scope") == k, s, x, k) for k, xs in scopes.items() for s, x in xs]
    return verdict.select("pair_id", F.posexplode(F.array_compact(F.array(*told))).alias("place", "e")).select("pair_id", "place", "e.signal", "e.value", "e.supports", "e.level")


def combine_signals(files: DataFrame) -> DataFrame:
    """Token, structure and overall similarity of S1 to S5; a negative S5 is left out, not counted as 0."""
    token, structure = (F.col("s1") + F.col("s3")) / 2, F.col("s4")
    return files.withColumn("token_layer", token).withColumn("overall", F.when(F.col("s5") >= 0, (token + structure + F.col("s5")) / 3).otherwise((token + structure) / 2))
