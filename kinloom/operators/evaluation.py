"""Scoring of verdicts against labels, and the relational work around benchmark extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DETECTED = 0.70
# Channel decisions.
KEEP, REVIEW = (0.90, 0.50), (0.70, 0.20)


def threshold_sweep(scored: DataFrame, first: int = 5, last: int = 95, step: int = 5) -> DataFrame:
    """Counts and precision, recall, F1 at each threshold from (score 0..100, positive). Scores are first counted by threshold bin, so rows are not multiplied."""
    bins = scored.where("score is not null").groupBy(F.floor(F.col("score") / step).alias("b"), "positive").agg(F.count("*").alias("n"))
    marks = scored.sparkSession.range(first, last + 1, step).select(F.col("id").alias("threshold"))
    met = marks.join(F.broadcast(bins))  # at most one bin a threshold and class
    over = F.col("b") >= F.col("threshold") / step
    count = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long")
    per = met.groupBy("threshold").agg(count(over & F.col("positive")).alias("tp"), count(~over & F.col("positive")).alias("fn"), count(over & ~F.col("positive")).alias("fp"), count(~over & ~F.col("positive")).alias("tn"))
    safe = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    p, r = safe(F.col("tp"), F.col("tp") + F.col("fp")), safe(F.col("tp"), F.col("tp") + F.col("fn"))
    return per.withColumn("precision", p).withColumn("recall", r).withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def auc_pr(curve: DataFrame) -> DataFrame:
    """Trapezoid area under distinct (recall, precision) points with (0, 1) and (1, 0) added; ties on recall by precision."""
    ends = curve.sparkSession.range(2).select(F.col("id").cast("double").alias("recall"), (1 - F.col("id")).cast("double").alias("precision"))
    points = curve.select("recall", "precision").unionByName(ends).distinct()
    order = Window.orderBy("recall", "precision")  # a point a threshold
    laid = points.select("recall", "precision", F.lag("recall").over(order).alias("r0"), F.lag("precision").over(order).alias("p0"))
    return laid.agg(F.sum((F.col("recall") - F.col("r0")) * (F.col("precision") + F.col("p0")) / 2).alias("auc"))


def dual_metric(labels: DataFrame, results: DataFrame) -> DataFrame:
    """A row a group (band, else expected type): pairs, detected, type hits, errors, partly covered, mean and median time.

    Duplicate results of a pair count once; unlabelled results are left out. A negative is hit when it isn't detected.
    """
    c = F.col
    found = results.dropDuplicates(["pair_id"]).join(labels, "pair_id")
    over = c("coverage") >= DETECTED
    negative = c("expected_type") == "NON_CLONE"
    marked = found.select(
        F.coalesce("band", "expected_type").alias("group"), "wall_ms", (c("status") != "OK").alias("err"), ((c("status") == "OK") & over).alias("det"),
        F.when(negative, ~over).otherwise(over & (c("found_type") == c("expected_type"))).alias("hit"), ((c("status") == "OK") & ~over & (c("coverage") > 0)).alias("part"),
    )
    n = lambda x: F.sum(c(x).cast("long"))
    return marked.groupBy("group").agg(F.count("*").alias("pairs"), n("det").alias("detected"), n("hit").alias("type_hits"), n("err").alias("errors"), n("part").alias("sub_coverage"), F.avg("wall_ms").alias("mean_ms"), F.percentile("wall_ms", F.lit(0.5)).alias("median_ms"))


def accuracy(results: DataFrame, by: str, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Share of rows where each (expected, found) column pair agrees, and the mean time."""
    return results.groupBy(by).agg(F.count("*").alias("pairs"), *[F.avg((F.col(a) == F.col(b)).cast("double")).alias(n) for n, (a, b) in pairs.items()], F.avg("runtime_ms").alias("mean_ms"))


def channel_stability(values: DataFrame) -> DataFrame:
    """Mean and population deviation of the Jaccard similarity of a channel's values between variants, its coverage and distinct values.

    values: (channel, variant, value). Pairs of variants come from counts of shared values: an equi-join on (channel, value).
    """
    sets = values.select("channel", "variant", "value").distinct()
    sizes = sets.groupBy("channel", "variant").agg(F.count("*").alias("n"))
    a, b = (sets.select("channel", "value", F.col("variant").alias(f"v{i}")) for i in (1, 2))
    shared = a.join(b, ["channel", "value"]).where("v1 < v2").groupBy("channel", "v1", "v2").agg(F.count("*").alias("inter"))
    left, right = (sizes.select("channel", F.col("variant").alias(f"v{i}"), F.col("n").alias(f"n{i}")) for i in (1, 2))
    pairs = left.join(right, "channel").where("v1 < v2").join(shared, ["channel", "v1", "v2"], "left")
    alike = F.coalesce("inter", F.lit(0)) / (F.col("n1") + F.col("n2") - F.coalesce("inter", F.lit(0)))
    per = pairs.groupBy("channel").agg(F.avg(alike).alias("avg_stability"), F.stddev_pop(alike).alias("stability_std"), F.count("*").alias("pair_count"))
    variants = values.select(F.countDistinct("variant").alias("all"))
    seen = sets.groupBy("channel").agg(F.countDistinct("variant").alias("k"), F.countDistinct("value").alias("distinct_values")).join(F.broadcast(variants))
    return per.join(seen, "channel").select("channel", "avg_stability", "stability_std", (F.col("k") / F.col("all")).alias("coverage"), "distinct_values", "pair_count")


def channel_decision(stability: Column, coverage: Column) -> Column:
    return F.when((stability >= KEEP[0]) & (coverage >= KEEP[1]), "KEEP").when((stability >= REVIEW[0]) & (coverage >= REVIEW[1]), "REVIEW").otherwise("DROP")


def similarity_band(a: Column, b: Column) -> Column:
    """Clone band by the lesser of two similarities."""
    low = F.least(a, b)
    return F.when(low >= 0.90, "VST3").when(low >= 0.70, "ST3").when(low >= 0.50, "MT3").otherwise("WT3T4")


def star_join(clones: DataFrame, functions: DataFrame, least_size: int) -> DataFrame:
    """Clone pairs with both functions' data and bands; filters go below the joins."""
    f = lambda s: functions.select(F.col("id").alias(f"{s}_id"), F.col("name").alias(f"{s}_name"), F.col("lines").alias(f"{s}_lines"))
    kept = clones.where(F.col("min_size") >= least_size).withColumn("band", similarity_band(F.col("sim_line"), F.col("sim_token")))
    return kept.join(f("one"), "one_id").join(f("two"), "two_id")


def stratified(rows: DataFrame, stratum: str, key: str, n: int, seed: str = "0") -> DataFrame:
    """n rows of each stratum in a seeded hash order: the same rows every time."""
    order = F.row_number().over(Window.partitionBy(stratum).orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed))), key))
    return rows.withColumn("place", order).where(F.col("place") <= n)


def shards(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Round robin in key order: row i goes to shard i modulo n. Ordered through range partitions: counts of the partitions before, plus a local number."""
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), key).sortWithinPartitions(key).withColumn("_m", F.monotonically_increasing_id())
    ranged = ranged.withColumn("_p", F.shiftright("_m", 33).cast("int")).withColumn("_i", F.col("_m").bitwiseAND((1 << 33) - 1))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    return ranged.join(F.broadcast(before), "_p").withColumn("shard", F.pmod(F.col("_before") + F.col("_i"), F.lit(n)).cast("int")).drop("_m", "_p", "_i", "_before")


def in_all_variants(rows: DataFrame, key: str, variant: str, least: str | None = None, value: int = 5) -> DataFrame:
    """Keys present in every variant, with at least ``value`` of ``least`` in each."""
    total = rows.select(F.countDistinct(variant).alias("_all"))
    kept = rows.where(F.col(least) >= value) if least else rows
    return kept.groupBy(key).agg(F.countDistinct(variant).alias("variants")).join(F.broadcast(total)).where("variants = _all").drop("_all")


def expectation(expected: Column, found: Column, coverage: Column) -> Column:
    """PASS, EXPLORATORY, RESTRAINED or FAIL of a verdict against its label."""
    return (
        F.when(expected == "NON_CLONE", F.when(coverage < 0.20, "RESTRAINED").otherwise("FAIL"))
        .when(expected.startswith("T4"), F.when(found == expected, "PASS").otherwise("EXPLORATORY"))
        .when(found == expected, "PASS").otherwise("FAIL")
    )


def recall_at(regions: DataFrame, truth: DataFrame, k: int = 3, least: float = 1.0) -> DataFrame:
    """Recall and false positives of the k best regions of each case."""
    place = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("priority"), "region"))
    top = regions.withColumn("place", place).where((F.col("place") <= k) & (F.col("coverage") >= least)).groupBy("case_id").agg(F.max("hits").alias("hit"))
    met = truth.join(top, "case_id", "left").select("positive", (F.coalesce("hit", F.lit(0)) > 0).alias("found"), F.col("hit").isNotNull().alias("any"))
    return met.agg(F.count_if("positive").alias("positives"), F.count_if(F.col("positive") & F.col("found")).alias("recalled"), F.count_if(~F.col("positive") & F.col("any")).alias("false_positives"))
