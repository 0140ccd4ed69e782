"""Reports as text and JSON columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHECK_FIRST, REVIEW_NEEDED, MAX_REGIONS = 90, 60, 20


def percent(x: Column) -> Column:
    return F.format_string("%.2f%%", (x * 100).cast("double"))


def severity(score: Column) -> Column:
    """Bucket of a 0..100 score."""
    return F.when(score >= CHECK_FIRST, "CHECK FIRST").when(score >= REVIEW_NEEDED, "REVIEW NEEDED").otherwise("LIGHT REVIEW")


def verdict_json(verdict: DataFrame) -> DataFrame:
    """(pair_id, json): version, summary, and scores of a verdict."""
    body = F.struct(
        F.lit("1.0").alias("version"),
        F.struct("clone_type", "scope", "direction", F.format_string("%.4f", F.col("confidence")).alias("confidence"), F.col("confidence_level").alias("level")).alias("summary"),
        F.struct(*[F.format_string("%.4f", F.col(x)).alias(x) for x in ("t1", "t2", "t3", "t4", "non_clone")]).alias("scores"),
        F.col("flags").alias("flags"),
    )
    return verdict.select("pair_id", F.to_json(body).alias("json"))


def verdict_text(verdict: DataFrame) -> DataFrame:
    line = F.format_string("Pair %s: %s, scope %s (%s), confidence %.4f", F.col("pair_id").cast("string"), "clone_type", "scope", "direction", "confidence")
    return verdict.select("pair_id", F.concat_ws("\n", line, F.concat(F.lit("Coverage: "), percent(F.col("coverage_a")), F.lit(" / "), percent(F.col("coverage_b"))), F.concat(F.lit("Flags: "), F.array_join("flags", ", "))).alias("text"))


def region_json(regions: DataFrame, most: int = MAX_REGIONS) -> DataFrame:
    """(pair_id, total, json): the first regions of a pair by place, with severity."""
    row = F.struct("place", "type", F.format_string("%.4f", F.col("score")).alias("score"), severity(F.col("score") * 100).alias("severity"))
    grouped = regions.groupBy("pair_id").agg(F.array_sort(F.collect_list(row)).alias("r"), F.count("*").alias("total"))
    return grouped.select("pair_id", "total", F.to_json(F.slice("r", 1, most)).alias("json"))
