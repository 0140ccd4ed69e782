"""Regions of files: windows, candidates, ranking, types, selection and line coverage."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom.operators.sequence import edit_script, lcs_similarity, lcs_similarity_column

# Clone types from strongest to weakest, and kinds with their rank in selection.
TYPES = ("T1", "T2", "T3", "T4_CONFIRMED", "T4_DYNAMIC_EVIDENCE", "POSSIBLE_T4_CANDIDATE")
KIND_ORDER = {"METHOD": 6, "METHOD_BODY_REGION": 5, "CALL_EXPANDED_REGION": 5, "BLOCK_SEQUENCE_REGION": 4, "CONTROL_REGION": 3, "STATEMENT_WINDOW_REGION": 2, "FILE": 1}
UNITS = ("FILE", "METHOD", "METHOD_BODY_REGION", "CALL_EXPANDED_REGION")
SOURCE_CHANNELS = ("EXACT_TEXT_SCAN", "NORMALIZED_AST_SCAN", "NORMALIZED_TOKEN_OVERLAP_SCAN", "STATEMENT_DIFF_SCAN")
SMALLEST, LARGEST, MOST_WINDOWS = 2, 6, 64
T3_LEAST, FULL, PART, REDUNDANT, REGION_COVERAGE = 0.50, 0.80, 0.20, 0.80, 2.0


def statement_windows(statements: DataFrame, key: str = "file_id", text: str = "stmt") -> DataFrame:
    """(key, size, start, stmts): windows of 2 to 6 statements, the first 64 of each size. One sort by key and position."""
    order = Window.partitionBy(key).orderBy("pos")
    sizes = range(SMALLEST, LARGEST + 1)
    wide = F.collect_list(text).over(order.rowsBetween(0, LARGEST - 1))
    framed = statements.select(key, (F.row_number().over(order) - 1).alias("start"), wide.alias("_w")).where(F.col("start") < MOST_WINDOWS)
    cut = framed.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).where(F.size("_w") >= F.col("size"))
    return cut.select(key, "size", "start", F.slice("_w", F.lit(1), F.col("size")).alias("stmts"))


def equal_key_candidates(regions: DataFrame, channel: str, value: Column, most: int | None = None) -> DataFrame:
    """(left_region, right_region, channel, score 1.0) of regions of two files with one key; keys of more regions than ``most``, where given, are left to other channels."""
    keyed = regions.select("file_id", "region_id", value.alias("k")).where("k is not null")
    # Pairs come once by themselves but where both regions have several keys: only those are made distinct, so that hot keys' pairs aren't shuffled.
    keys = keyed.groupBy("file_id", "region_id").agg(F.collect_set("k").alias("ks"))
    keyed = keys.select("file_id", "region_id", (F.size("ks") > 1).alias("several"), F.explode("ks").alias("k"))
    rare = keyed.groupBy("k").agg(F.count("*").alias("n")).where((F.col("n") >= 2) & (F.lit(True) if most is None else F.col("n") <= most)).select("k")
    keyed = keyed.join(rare, "k")

    def met(rows: DataFrame) -> DataFrame:
        a, b = (rows.select("k", *[F.col(c).alias(f"{s}_{n}") for c, n in (("file_id", "file"), ("region_id", "region"), ("several", "several"))]) for s in ("left", "right"))
        return a.join(b, "k").where("left_file < right_file")

    cols = ("left_file", "right_file", "left_region", "right_region")
    pair = met(keyed).where("NOT (left_several AND right_several)").select(*cols).unionByName(met(keyed.where("several")).select(*cols).distinct())
    return pair.select(*cols, F.lit(channel).alias("channel"), F.lit(1.0).alias("score"))


def source_scans(regions: DataFrame, least: float = T3_LEAST) -> DataFrame:
    """(pair_id, left_region, right_region, channel, score) of region pairs that the four scans of the source propose.

    regions: (pair_id, side LEFT or RIGHT, region_id, kind, t1, t2, stmts), arrays of source tokens, normalised tokens and normalised statements.
    Whole files meet whole files only. Equal keys, shared tokens and shared statements are equi-joins within the file pair; what shares nothing can
    reach no threshold, so no pair of regions is listed for being there. Tokens are counted before the second shuffle; statements are aligned only where
    the lengths allow the score.

    Defined results: null arrays are empty; two empty arrays of normalised tokens or of statements are alike (score 1.0), two empty ones of source tokens
    are no candidate; repeated rows count once; further columns take no part; an empty table gives an empty result.
    """
    keys = ("pair_id", "region_id")
    empty = F.array().cast("array<string>")
    base = regions.select(*keys, "side", (F.col("kind") == "FILE").alias("whole"), *[F.coalesce(F.col(c), empty).alias(c) for c in ("t1", "t2", "stmts")]).dropDuplicates(["pair_id", "side", "region_id"])
    both = ["pair_id", "whole"]

    def met(rows: DataFrame, on: list[str], *carried: str) -> DataFrame:
        a, b = (rows.where(F.col("side") == side.upper()).select(*on, F.col("region_id").alias(f"{side}_region"), *[F.col(c).alias(f"{side}_{c}") for c in carried]) for side in ("left", "right"))
        return a.join(b, on)

    def told(found: DataFrame, channel: str, score: Column) -> DataFrame:
        return found.select("pair_id", "left_region", "right_region", F.lit(channel).alias("channel"), score.alias("score"))

    one = F.lit(1.0)
    same = [told(met(base.where(F.size(c) > 0), [*both, c]), channel, one) for c, channel in (("t1", "EXACT_TEXT_SCAN"), ("t2", "NORMALIZED_AST_SCAN"))]
    none = [told(met(base.where(F.size(c) == 0), both), channel, one) for c, channel in (("t2", "NORMALIZED_TOKEN_OVERLAP_SCAN"), ("stmts", "STATEMENT_DIFF_SCAN"))]
    tokens = base.select(*both, "side", "region_id", F.array_distinct("t2").alias("t")).select("*", F.size("t").alias("n")).select(*both, "side", "region_id", "n", F.explode("t").alias("token"))
    counted = met(tokens, [*both, "token"], "n").where(F.least("left_n", "right_n") >= least * F.greatest("left_n", "right_n"))
    counted = counted.groupBy("pair_id", "left_region", "right_region", "left_n", "right_n").agg(F.count("*").alias("c"))
    overlap = F.col("c") / (F.col("left_n") + F.col("right_n") - F.col("c"))
    lines = base.select(*both, "side", "region_id", F.size("stmts").alias("n"), F.explode(F.array_distinct("stmts")).alias("stmt"))
    near = met(lines, [*both, "stmt"], "n").where(F.least("left_n", "right_n") >= least * F.greatest("left_n", "right_n"))
    # Distinct shared statements bound the alignment from below only, so pairs are made distinct and aligned.
    near = near.select("pair_id", "left_region", "right_region").distinct()
    for side in ("left", "right"):
        near = near.join(base.where(F.col("side") == side.upper()).select("pair_id", F.col("region_id").alias(f"{side}_region"), F.col("stmts").alias(f"{side}_stmts")), ["pair_id", f"{side}_region"])
    aligned = near.withColumn("_s", lcs_similarity_column(F.col("left_stmts"), F.col("right_stmts")))
    found = [*same, *none, told(counted.where(overlap >= least), "NORMALIZED_TOKEN_OVERLAP_SCAN", overlap), told(aligned.where(F.col("_s") >= least), "STATEMENT_DIFF_SCAN", F.col("_s"))]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def merge_candidates(sources: DataFrame, keys: tuple[str, ...] = ("pair_id", "left_region", "right_region")) -> DataFrame:
    """One row a candidate from rows a source: best score of each channel, channels sorted."""
    per = sources.groupBy(*keys, "channel").agg(F.max("score").alias("score"))
    return per.groupBy(*keys).agg(F.max("score").alias("best"), F.count("*").alias("n_channels"), F.array_sort(F.collect_list("channel")).alias("channels"))


def kind_priority(left: Column, right: Column) -> Column:
    m, body = "METHOD", "METHOD_BODY_REGION"
    either = lambda k: (left == k) | (right == k)
    return (
        F.when((left == m) & (right == m), 1.0)
        .when((left == body) & (right == body), 0.92)
        .when(left.isin(m, body) & right.isin(m, body), 0.88)
        .when(either("BLOCK_SEQUENCE_REGION"), 0.70)
        .when(either("CONTROL_REGION"), 0.62)
        .when(either("STATEMENT_WINDOW_REGION"), 0.45)
        .otherwise(0.50)
    )


def rank_candidates(merged: DataFrame) -> DataFrame:
    """Adds rank_score and place within the pair; needs left_kind, right_kind, left_tokens, right_tokens."""
    score = (
        0.42 * F.col("best")
        + 0.22 * F.least(F.lit(1.0), F.col("n_channels") / 4)
        + 0.18 * F.least(F.lit(1.0), (F.col("left_tokens") + F.col("right_tokens")) / 120)
        + 0.18 * kind_priority(F.col("left_kind"), F.col("right_kind"))
        + F.when(F.array_contains("channels", "CFG_KNN_SCAN"), 0.12).otherwise(0.0)
    )
    scored = merged.withColumn("rank_score", F.round(score, 9))
    order = Window.partitionBy("pair_id").orderBy(F.desc("rank_score"), "left_region", "right_region")
    return scored.withColumn("place", F.row_number().over(order))


_COMPARED = T.StructType([T.StructField("similarity", T.DoubleType()), T.StructField("deleted", T.IntegerType()), T.StructField("inserted", T.IntegerType()), T.StructField("modified", T.IntegerType())])


def compare_column(left_tokens: Column, right_tokens: Column, left_stmts: Column, right_stmts: Column) -> Column:
    """struct(similarity, deleted, inserted, modified): the lesser LCS similarity of tokens and statements, and the edit script's counts."""

    def run(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        rows = []
        for p, q, r, s in zip(*(x.to_pylist() for x in (a, b, c, d)), strict=True):
            p, q, r, s = p or [], q or [], r or [], s or []
            kinds = [k for k, *_ in edit_script(r, s)]
            rows.append({"similarity": min(lcs_similarity(p, q), lcs_similarity(r, s)), "deleted": kinds.count("DELETED"), "inserted": kinds.count("INSERTED"), "modified": kinds.count("MODIFIED")})
        return pa.array(rows, pa.struct([("similarity", pa.float64()), ("deleted", pa.int32()), ("inserted", pa.int32()), ("modified", pa.int32())]))

    return F.arrow_udf(run, _COMPARED)(left_tokens, right_tokens, left_stmts, right_stmts)


def decide(candidates: DataFrame) -> DataFrame:
    """Adds type and strength.

    Needs t1_left/right, t2_left/right, stmts_left/right (normalised), left_kind, right_kind, channels, and the evidence columns
    proven, sampled (booleans) and region_coverage. Order of decision: T1, T2, T3, proof, sampling, structural region.
    """
    c = F.col
    told = candidates.withColumn("_c", compare_column(c("t2_left"), c("t2_right"), c("stmts_left"), c("stmts_right")))
    told = told.withColumn("similarity", c("_c.similarity")).withColumn("edits", c("_c.deleted") + c("_c.inserted") + c("_c.modified"))
    unit = c("left_kind").isin(*UNITS) | c("right_kind").isin(*UNITS)
    outside = F.size(F.array_except("channels", F.array(*map(F.lit, SOURCE_CHANNELS)))) > 0
    t1 = (F.size("t1_left") > 0) & (c("t1_left") == c("t1_right"))
    t2 = (F.size("t2_left") > 0) & (c("t2_left") == c("t2_right")) & (c("edits") == 0)
    t3 = (c("edits") > 0) & (c("similarity") >= T3_LEAST) & (unit | outside)
    kind = (
        F.when(t1, "T1").when(t2, "T2").when(t3, "T3").when(c("proven"), "T4_CONFIRMED").when(c("sampled"), "T4_DYNAMIC_EVIDENCE")
        .when((c("region_coverage") >= REGION_COVERAGE) | F.array_contains("channels", "CROSS_METHOD_REGION"), "POSSIBLE_T4_CANDIDATE").otherwise("NON_CLONE")
    )
    strong = F.when(c("similarity") >= 0.90, "VST3").when(c("similarity") >= 0.70, "ST3").otherwise("MT3")
    out = told.withColumn("type", kind).withColumn("strength", F.when(c("type") == "T3", strong).otherwise("NONE"))
    return out.withColumn("similarity", F.when(c("type").isin("T1", "T2"), F.lit(1.0)).otherwise(c("similarity"))).drop("_c")


_REGION = ("left_begin", "left_end", "right_begin", "right_end")


def select_regions(decisions: DataFrame) -> DataFrame:
    """Drops decisions that an earlier one of the pair (by place) covers on both sides: 0.80 of the lines, or a lower kind inside.

    The choice depends on those before it, so a pair is folded in order; a pair's decisions are few (they are ranked candidates).
    """

    def overlaps(b: int, e: int, kind: str, kept: tuple[int, int, str]) -> bool:
        shared = min(e, kept[1]) - max(b, kept[0]) + 1
        if shared <= 0:
            return False
        return shared / (e - b + 1) >= REDUNDANT or (KIND_ORDER.get(kind, 0) < KIND_ORDER.get(kept[2], 0) and b >= kept[0] and e <= kept[1])

    def fold(table: pa.Table) -> pa.Table:
        rows = table.sort_by("place").to_pylist()
        kept: list[tuple] = []
        for r in rows:
            left, right = (r["left_begin"], r["left_end"], r["left_kind"]), (r["right_begin"], r["right_end"], r["right_kind"])
            if not any(overlaps(*left, x) and overlaps(*right, y) for x, y in kept):
                kept.append((left, right))
                r["selected"] = True
            else:
                r["selected"] = False
        return pa.Table.from_pylist(rows, schema=table.schema.append(pa.field("selected", pa.bool_())))

    shown = decisions.where("type <> 'NON_CLONE'")
    schema = T.StructType([*shown.schema.fields, T.StructField("selected", T.BooleanType())])
    return shown.groupBy("pair_id").applyInArrow(fold, schema)


def covered_lines(decisions: DataFrame) -> DataFrame:
    """(pair_id, side, line, type_rank): each covered line with its strongest type (1 is T1)."""
    strength = F.array_position(F.array(*map(F.lit, TYPES)), F.col("type")).cast("int")
    sides = [
        decisions.select("pair_id", F.lit(s.upper()).alias("side"), strength.alias("type_rank"), F.explode(F.sequence(f"{s}_begin", f"{s}_end")).alias("line")) for s in ("left", "right")
    ]
    both = sides[0].unionByName(sides[1]).where("type_rank > 0")
    return both.groupBy("pair_id", "side", "line", "type_rank").agg(F.count("*").alias("n"))


def type_coverage(decisions: DataFrame, files: DataFrame) -> DataFrame:
    """(pair_id, side, type, covered, exclusive) as shares of the file's lines; files: (pair_id, side, lines)."""
    lines = covered_lines(decisions)
    first = F.min("type_rank").over(Window.partitionBy("pair_id", "side", "line"))
    per = lines.withColumn("_own", (F.col("type_rank") == first).cast("int")).groupBy("pair_id", "side", "type_rank").agg(F.count("*").alias("n"), F.sum("_own").alias("own"))
    share = lambda x: F.least(F.lit(1.0), F.col(x) / F.col("lines"))
    named = F.element_at(F.array(*map(F.lit, TYPES)), F.col("type_rank"))
    return per.join(files, ["pair_id", "side"]).select("pair_id", "side", named.alias("type"), "type_rank", share("n").alias("covered"), share("own").alias("exclusive"))


def file_summary(decisions: DataFrame, files: DataFrame) -> DataFrame:
    """Relationship, shape and priority of each pair: granular evidence before whole-file evidence."""
    c = F.col
    shown = decisions.where("type <> 'NON_CLONE'")
    whole = (c("left_kind") == "FILE") & (c("right_kind") == "FILE")
    fine = F.max((~whole).cast("int")).over(Window.partitionBy("pair_id"))
    shown = shown.withColumn("_fine", fine).where((c("_fine") == 0) | ~whole)
    cover = type_coverage(shown, files)
    lines = covered_lines(shown).groupBy("pair_id", "side").agg(F.countDistinct("line").alias("n")).join(files, ["pair_id", "side"])
    side = lambda s: F.coalesce(F.max(F.when(c("side") == s, F.least(F.lit(1.0), c("n") / c("lines")))), F.lit(0.0))
    matched = lines.groupBy("pair_id").agg(side("LEFT").alias("left"), side("RIGHT").alias("right"))
    best = cover.groupBy("pair_id", "type", "type_rank").agg(F.max("covered").alias("x")).groupBy("pair_id").agg(F.max_by("type", F.struct("x", -c("type_rank"))).alias("dominant"), F.count("*").alias("n_types"))
    units = shown.groupBy("pair_id").agg(F.max((c("left_kind").isin(*UNITS) | c("right_kind").isin(*UNITS)).cast("int")).alias("unit"), F.count("*").alias("n"))
    joined = files.select("pair_id").distinct().join(matched, "pair_id", "left").join(best, "pair_id", "left").join(units, "pair_id", "left")
    joined = joined.select("pair_id", F.coalesce("left", F.lit(0.0)).alias("left"), F.coalesce("right", F.lit(0.0)).alias("right"), F.coalesce("dominant", F.lit("NON_CLONE")).alias("dominant"), F.coalesce("n_types", F.lit(0)).alias("n_types"), F.coalesce("unit", F.lit(0)).alias("unit"), F.coalesce("n", F.lit(0)).alias("n"))
    low, high = F.least("left", "right"), F.greatest("left", "right")
    partial = F.when(c("dominant") == "T3", "PARTIAL_T3").otherwise("PARTIAL_T2")
    relation = (
        F.when(c("n_types") == 0, "NON_CLONE").when(low < PART, "MOSTLY_NON_CLONE").when(c("n_types") > 1, "MIXED_CLONE_TYPES")
        .when(~c("dominant").isin("T1", "T2", "T3"), "POSSIBLE_SEMANTIC_RELATION").when(low >= FULL, F.concat(F.lit("FULL_FILE_"), c("dominant"))).otherwise(partial)
    )
    shape = (
        F.when((c("n") == 0) | (high < PART), "NO_SIGNIFICANT_OVERLAP").when(c("unit") == 0, "LOCAL_SIMILARITIES_ONLY").when(low >= FULL, "FULL_OVERLAP")
        .when((c("left") >= FULL) & (c("right") >= PART), "LEFT_EMBEDDED_IN_RIGHT").when((c("right") >= FULL) & (c("left") >= PART), "RIGHT_EMBEDDED_IN_LEFT")
        .when(low >= PART, "PARTIAL_OVERLAP").otherwise("LOCAL_SIMILARITIES_ONLY")
    )
    urgent = (
        F.when(c("shape") == "NO_SIGNIFICANT_OVERLAP", "NONE").when(c("shape") == "LOCAL_SIMILARITIES_ONLY", F.when(high >= FULL, "MEDIUM").otherwise("LOW"))
        .when(c("shape").isin("FULL_OVERLAP", "LEFT_EMBEDDED_IN_RIGHT", "RIGHT_EMBEDDED_IN_LEFT"), "HIGH").when(low >= PART, "MEDIUM").otherwise("LOW")
    )
    told = joined.withColumn("relationship", relation).withColumn("shape", shape)
    return told.withColumn("priority", urgent).withColumn("unrelated", 1 - low).drop("unit")


def overlapping(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of ranges (pair_id, id, first, last) of two relations that share a line; dealt by pair and by blocks of lines."""
    block = 64
    deal = lambda df, s: df.select("pair_id", F.col("id").alias(f"{s}_id"), F.col("first").alias(f"{s}_first"), F.col("last").alias(f"{s}_last"), F.explode(F.sequence(F.floor(F.col("first") / block), F.floor(F.col("last") / block))).alias("_b"))
    met = deal(a, "a").join(deal(b, "b"), ["pair_id", "_b"]).where("a_first <= b_last and b_first <= a_last")
    once = F.col("_b") == F.floor(F.greatest("a_first", "b_first") / block)
    return met.where(once).select("pair_id", "a_id", "b_id", (F.least("a_last", "b_last") - F.greatest("a_first", "b_first") + 1).alias("lines"))


def largest_remainder(parts: DataFrame, target: int = 100, key: str = "pair_id", value: str = "share", name: str = "type") -> DataFrame:
    """Whole percents that add up to target: floors, and one more for the largest fractions."""
    total = F.sum(value).over(Window.partitionBy(key))
    exact = parts.withColumn("_x", F.round(F.col(value) / total * target, 9)).withColumn("_f", F.floor("_x"))
    left = F.lit(target) - F.sum("_f").over(Window.partitionBy(key))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.round(F.col("_x") - F.col("_f"), 9)), name))
    return exact.withColumn("_left", left).withColumn("_p", place).select(key, name, (F.col("_f") + F.when(F.col("_p") <= F.col("_left"), 1).otherwise(0)).cast("long").alias("percent"))
