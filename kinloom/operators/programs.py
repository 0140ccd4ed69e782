"""Instructions, blocks and methods of analysed programs, held as relations.

instructions: (method_id, block_id, pos, kind, operator, text, target, call_kind, n_constants, n_strings, n_defs, n_uses).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Instruction kinds by category; binary operators split into logic and arithmetic.
CATEGORIES = {"conditional": "BRANCH", "goto": "BRANCH", "return": "RETURN", "invoke": "CALL", "comparison": "COMPARISON", "new": "ALLOCATION", "put": "ASSIGNMENT", "get": "FIELD_ACCESS", "array": "ARRAY_ACCESS", "define": "ASSIGNMENT", "constant": "CONSTANT"}
LOGIC_OPERATORS = ("and", "or", "xor", "shl", "shr", "ushr")
SUBSTANTIVE = ("ARITHMETIC", "LOGIC", "COMPARISON", "BRANCH", "FIELD_ACCESS", "ARRAY_ACCESS", "ALLOCATION", "CALL", "ASSIGNMENT")
COUNTED = ("BRANCH", "RETURN", "CALL", "ARITHMETIC", "LOGIC", "COMPARISON", "ASSIGNMENT", "ALLOCATION", "FIELD_ACCESS", "ARRAY_ACCESS")
BLOCK_COUNTED = ("BRANCH", "RETURN", "CALL", "ARITHMETIC", "COMPARISON", "ASSIGNMENT")
# Hash buckets of each raw channel; 32 for any other.
BUCKETS = {"instruction.rawInstructionText": 128, "instruction.rawDeclaredTargetText": 64}
T3_FRACTION, T1_AGREEMENT, T2_AGREEMENT = 0.50, 0.999, 0.79


def category(kind: Column, operator: Column) -> Column:
    """Category of an instruction from its kind; binary ones by operator."""
    binary = F.when(F.lower(operator).isin(*LOGIC_OPERATORS), "LOGIC").otherwise("ARITHMETIC")
    named = F.coalesce(*[F.when(kind == k, c) for k, c in CATEGORIES.items()])
    return F.when(kind == "binary", binary).otherwise(F.coalesce(named, F.lit("OTHER")))


def _counts(names: tuple[str, ...]) -> list[Column]:
    return [F.count_if(F.col("category") == n).alias(n.lower()) for n in names]


def method_features(instructions: DataFrame) -> DataFrame:
    """Counts of a method over its instructions; edges, parameters, loops and locals join in from their own relations."""
    return instructions.groupBy("method_id").agg(
        F.countDistinct("block_id").alias("blocks"), F.count("*").alias("instructions"), *_counts(COUNTED),
        F.count_if(F.col("call_kind") == "INTERNAL").alias("internal_calls"), F.count_if(F.col("call_kind") == "EXTERNAL").alias("external_calls"),
        F.sum("n_constants").alias("constants"), F.sum("n_strings").alias("strings"),
    )


def block_features(instructions: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of a block and its degrees; edges: (method_id, src, dst)."""
    per = instructions.groupBy("method_id", "block_id").agg(F.count("*").alias("instructions"), *_counts(BLOCK_COUNTED), F.sum("n_constants").alias("constants"), F.sum("n_strings").alias("strings"))
    ends = edges.select("method_id", F.explode(F.array(F.struct(F.col("src").alias("b"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("b"), F.lit(0).alias("o")))).alias("e"))
    degree = ends.groupBy("method_id", F.col("e.b").alias("block_id")).agg(F.sum(1 - F.col("e.o")).alias("preds"), F.sum("e.o").alias("succs"))
    joined = per.join(degree, ["method_id", "block_id"], "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("preds", "succs")})


def content_features(instructions: DataFrame) -> DataFrame:
    """The seven block counts of the weighted distance: transfers are data movement, not jumps."""
    c = F.col("category")
    return instructions.groupBy("method_id", "block_id").agg(
        F.count_if(c == "ARITHMETIC").alias("arithmetic"), F.count_if(c == "CALL").alias("calls"), F.count("*").alias("instructions"), F.count_if(c.isin("LOGIC", "COMPARISON")).alias("logic"),
        F.count_if(c.isin("ASSIGNMENT", "FIELD_ACCESS", "ARRAY_ACCESS")).alias("transfers"), F.sum("n_strings").alias("strings"), F.sum("n_constants").alias("numbers"),
    )


def raw_numeric(instructions: DataFrame, edges: DataFrame) -> DataFrame:
    """(item_id, feature, value): the numeric view of a block; edges: (method_id, src, dst, exceptional)."""
    item = F.concat_ws("/", "method_id", "block_id")
    some = F.trim("target") != ""
    own = instructions.groupBy(item.alias("item_id")).agg(
        F.count("*").alias("instructionCount"), F.countDistinct("kind").alias("distinctInstructionClassCount"), F.countDistinct("text").alias("distinctInstructionTextCount"), F.count_if(some).alias("declaredTargetCount"),
        F.countDistinct(F.when(some, F.col("target"))).alias("distinctDeclaredTargetCount"), F.sum("n_defs").alias("defValueCount"), F.sum("n_uses").alias("useValueCount"),
    )
    rows = own.select("item_id", F.explode(F.array(*[F.struct(F.lit(f"numeric.{c}").alias("feature"), F.col(c).cast("double").alias("value")) for c in own.columns[1:]])).alias("f")).select("item_id", "f.feature", "f.value")
    out = edges.groupBy(F.concat_ws("/", "method_id", "src").alias("item_id"), F.when(F.col("exceptional"), "numeric.exceptionalSuccessorCount").otherwise("numeric.normalSuccessorCount").alias("feature")).agg(F.count("*").cast("double").alias("value"))
    into = edges.groupBy(F.concat_ws("/", "method_id", "dst").alias("item_id"), F.lit("numeric.predecessorCount").alias("feature")).agg(F.count("*").cast("double").alias("value"))
    return rows.unionByName(out).unionByName(into)


def raw_hashed(records: DataFrame) -> DataFrame:
    """(item_id, feature, value): counts of a block's raw records (item_id, channel, value) by hash bucket."""
    size = F.coalesce(*[F.when(F.col("channel") == k, n) for k, n in BUCKETS.items()], F.lit(32))
    at = F.pmod(F.crc32(F.concat("channel", F.lit("\0"), "value").cast("binary")), size)
    named = records.select("item_id", F.concat(F.lit("hash."), "channel", F.lit("."), at.cast("string")).alias("feature"))
    return named.groupBy("item_id", "feature").agg(F.count("*").cast("double").alias("value"))


def block_view(numeric: DataFrame, hashed: DataFrame, view: str) -> DataFrame:
    """Features of one of the views DISCOVRE_NUMERIC, RAW_HASH_BUCKET, HYBRID_NUMERIC_HASH."""
    if view == "HYBRID_NUMERIC_HASH":
        return numeric.unionByName(hashed)
    return numeric if view == "DISCOVRE_NUMERIC" else hashed


def label_neighbours(sets: DataFrame, k: int = 4) -> DataFrame:
    """(side, method, other, place, similarity): in both directions the k most alike methods of the other side, by Jaccard of label sets over 0.

    sets: (pair_id, side A or B, method, label). Pairs come from shared labels: an inverted index, no cross product.
    """
    s = sets.distinct()
    n = s.groupBy("pair_id", "side", "method").agg(F.count("*").alias("n"))
    full = s.join(n, ["pair_id", "side", "method"])
    a, b = (full.where(F.col("side") == x).select("pair_id", "label", F.col("method").alias(x), F.col("n").alias(f"n{x}")) for x in "AB")
    met = a.join(b, ["pair_id", "label"]).groupBy("pair_id", "A", "B", "nA", "nB").agg(F.count("*").alias("i"))
    alike = met.withColumn("similarity", F.col("i") / (F.col("nA") + F.col("nB") - F.col("i")))
    both = [alike.select("pair_id", F.lit(x).alias("side"), F.col(x).alias("method"), F.col(y).alias("other"), "similarity") for x, y in ("AB", "BA")]
    place = F.row_number().over(Window.partitionBy("pair_id", "side", "method").orderBy(F.desc("similarity"), "other"))
    return both[0].unionByName(both[1]).withColumn("place", place).where(F.col("place") <= k)


def edge_preservation(matches: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(pair_id, preserved): left edges whose matched ends form a right edge of the kind, over the larger edge count; 1 without edges.

    matches: (pair_id, left_block, right_block); edges: (pair_id, src, dst, kind).
    """
    m = lambda s, t: matches.select("pair_id", F.col("left_block").alias(s), F.col("right_block").alias(t))
    kept = left.join(m("src", "src2"), ["pair_id", "src"]).join(m("dst", "dst2"), ["pair_id", "dst"]).join(right.select("pair_id", F.col("src").alias("src2"), F.col("dst").alias("dst2"), "kind").distinct(), ["pair_id", "src2", "dst2", "kind"], "left_semi")
    n = lambda df, name: df.groupBy("pair_id").agg(F.count("*").alias(name))
    out = matches.select("pair_id").distinct().join(n(left, "l"), "pair_id", "left").join(n(right, "r"), "pair_id", "left").join(n(kept, "k"), "pair_id", "left")
    most = F.greatest(F.coalesce("l", F.lit(0)), F.coalesce("r", F.lit(0)))
    return out.select("pair_id", F.when(most == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.coalesce("k", F.lit(0)) / most)).alias("preserved"))


def aligned_types(aligned: DataFrame, totals: DataFrame) -> DataFrame:
    """Type of aligned regions by graph evidence.

    aligned: (region, op, agreement); totals: (region, left_total, right_total) substantive nodes of the methods on each side.
    """
    own = F.col("op").isin(*SUBSTANTIVE)
    per = aligned.groupBy("region").agg(F.count_if(own).alias("n"), F.min(F.when(own, F.col("agreement"))).alias("least"))
    c = F.col
    joined = totals.join(per, "region", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    most = F.greatest("left_total", "right_total")
    share = F.when((c("n") == 0) | (most == 0), F.lit(0.0)).otherwise(c("n") / most)
    edits = (c("left_total") > c("n")) | (c("right_total") > c("n"))
    kind = F.when(c("share") < T3_FRACTION, "NONE").when(~edits & (c("least") >= T1_AGREEMENT), "T1").when(~edits & (c("least") >= T2_AGREEMENT), "T2").otherwise("T3")
    return joined.withColumn("share", share).withColumn("edits", edits).withColumn("type", kind)


def extents(nodes: DataFrame) -> DataFrame:
    """(region, method, begin_line, end_line, lines) of a region's nodes with known lines."""
    known = nodes.where("line > 0")
    return known.groupBy("region", "method").agg(F.min("line").alias("begin_line"), F.max("line").alias("end_line"), F.countDistinct("line").alias("lines"))


def once_per_pair(regions: DataFrame, score: Column, keys: tuple[str, str] = ("left_method", "right_method")) -> DataFrame:
    """Adds ``score`` of the keys to regions, computed once for each distinct pair of methods."""
    return regions.join(regions.select(*keys).distinct().withColumn("score", score), list(keys), "left")


def attach(candidates: DataFrame, evidence: DataFrame, keys: tuple[str, ...], columns: dict[str, Column]) -> DataFrame:
    """Evidence columns joined to candidates by normalised keys, with defaults where there is none."""
    return candidates.join(evidence, list(keys), "left").withColumns({k: F.coalesce(F.col(k), v) for k, v in columns.items()})


def directional_average(scores: DataFrame, empty: float = 0.0) -> DataFrame:
    """(pair_id, average): best score of each method on both sides, weighted by size. scores: (pair_id, method_a, method_b, size_a, size_b, score)."""
    side = lambda s: scores.groupBy("pair_id", F.col(f"method_{s}").alias("m")).agg(F.max("score").alias("best"), F.max(f"size_{s}").alias("w"), F.lit(s).alias("s"))
    both = side("a").unionByName(side("b"))
    return both.groupBy("pair_id").agg(F.coalesce(F.sum(F.col("best") * F.col("w")) / F.sum("w"), F.lit(empty)).alias("average"))


def family_accuracy(results: DataFrame) -> DataFrame:
    """(cases, right, accuracy): a case is right where its expected family is among those found. results: (case_id, expected, found)."""
    per = results.groupBy("case_id", "expected").agg(F.array_contains(F.collect_set("found"), F.col("expected")).cast("long").alias("ok"))
    return per.agg(F.count("*").alias("cases"), F.sum("ok").alias("right"), F.avg("ok").alias("accuracy"))


def cfg_summary(results: DataFrame) -> DataFrame:
    """Per view: mean and best similarity with its pair, and the mean share of candidates saved; constructors are left out."""
    kept = results.where("left_name <> '<init>' and right_name <> '<init>'")
    return kept.groupBy("view").agg(
        F.count("*").alias("pairs"), F.avg("similarity").alias("mean_similarity"), F.max("similarity").alias("max_similarity"),
        F.max_by("pair_id", F.struct("similarity", -F.col("pair_id"))).alias("best_pair"), F.avg(1 - F.col("candidates") / F.col("all_pairs")).alias("reduction"),
    )
