"""Mixing sources to target weights by weighted fair queueing.

Every document may be sent ``max_epochs`` times. Documents of a source stand in a
shuffled (hash) order; a sending's virtual finish time is the source's cumulative
words divided by the source's weight. Sendings are sorted by that time over all
sources, range by range, and cut where the running sum reaches the budget.

Defined results: sizes of null or wordless texts are 0 and nothing is taken of them;
null is a source of its own and comes last; repeated rows are mixed as separate
documents; an empty table gives an empty result. Sources may hold any share of
the rows: running sums are cut into hash buckets within a source, and the global
order into ranges of time, so neither a source nor the whole is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinloom.llm._store import materialize

#: Words: runs of anything but these; the same class everywhere in this subpackage.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, EPOCHS = (3.0, 1.0, 2.0), 1.5, 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size): a row a source.

    Water filling: sources sorted by epochs * size / weight fill up one after
    another; the level is what the budget leaves for the rest, by weight. Weights repeat over sources
    by code point, null last. One task holds the sources, never documents.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    every = Window.partitionBy()
    cap = F.col("source_size") * F.lit(float(epochs))
    fill = Window.orderBy("_full_at", F.col("source").isNull(), "source")
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    laid = sizes.withColumn("weight", cycle).withColumn("_full_at", cap / F.col("weight")).withColumn("_budget", F.sum("source_size").over(every) * F.lit(share))
    level = (F.col("_budget") - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("weight").over(after)
    # The level is right at the first source that it doesn't fill; where all fill up, the last cap.
    laid = laid.withColumn("_level", level).withColumn("_open", F.when(F.col("_level") <= F.col("_full_at"), F.col("_level")))
    level_at = F.coalesce(F.max("_open").over(every), F.max("_full_at").over(every))
    return laid.withColumn("_at", level_at).select("source", "source_size", "weight", F.least(cap, F.col("weight") * F.col("_at")).alias("target"), F.col("_at").alias("level"), F.col("_budget").alias("budget"))


def mix_plan(docs: DataFrame, seed: str = "mix", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, finish1, finish2, copies for every row: copies times the row is sent."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    slim = materialize(slim.withColumn("key", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed)))), "sizes")
    return plan_sizes(slim, weights, share)


def plan_sizes(slim: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """mix_plan() from (doc_id, source, size, key), which should be a written table: it is read a few times."""
    spark = slim.sparkSession
    by_source = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    targets = materialize(source_targets(by_source.drop("_rows"), weights, share), "targets")
    head = targets.agg(F.max("level"), F.max("budget")).first()
    level, budget = float(head[0] or 0), float(head[1] or 0)
    rows = slim.count()
    bits = max(4, min(24, (rows // 256).bit_length()))
    # Running words within a source: buckets by leading bits of the hash, a running sum in each, plus what the buckets before hold.
    bucket = F.shiftright(F.conv(F.substring("key", 1, 6), 16, 10).cast("int"), 24 - bits)
    filed = slim.withColumn("_b", bucket)
    held = filed.groupBy("source", "_b").agg(F.sum("size").alias("_held"))
    offset = F.sum("_held").over(Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = held.select(F.col("source").alias("_s"), F.col("_b").alias("_ob"), F.coalesce(offset, F.lit(0)).alias("_before"))
    within = F.sum("size").over(Window.partitionBy("source", "_b").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    run = filed.withColumn("_in", within).join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_ob")))
    per = targets.select(F.col("source").alias("_t"), "source_size", "weight", "target")
    per = F.broadcast(per) if targets.count() <= 10_000 else per
    run = run.join(per, F.col("source").eqNullSafe(F.col("_t"))).withColumn("_cum", F.col("_before") + F.col("_in"))
    timed = run.select(
        "doc_id", "source", "size", "key", "source_size", "target",
        (F.col("_cum") / F.col("weight")).alias("finish1"), ((F.col("_cum") + F.col("source_size")) / F.col("weight")).alias("finish2"),
    )
    timed = materialize(timed, "times")
    if not rows or level <= 0:
        return timed.withColumn("copies", F.lit(0)).drop("key")
    # Global order: ranges of equal virtual time. Totals by range show where the budget ends; only that range is sorted in full.
    ranges = max(16, min(65536, rows // 200))
    rng = lambda c: F.least(F.floor(F.col(c) / F.lit(level) * ranges), F.lit(2 * ranges)).cast("int")
    sent = timed.where("size > 0").select("size", F.explode(F.array(rng("finish1"), rng("finish2"))).alias("_r"))
    totals = sent.groupBy("_r").agg(F.sum("size").alias("_n"))
    upto = totals.select("_r", "_n", F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"))
    cut = upto.where(F.col("_upto") > budget).orderBy("_r").select("_r", (F.col("_upto") - F.col("_n")).alias("_base")).first()
    if cut is None:
        return timed.withColumn("copies", F.when(F.col("size") > 0, EPOCHS).otherwise(0)).drop("key")
    edge = timed.where("size > 0").select(
        "size", F.explode(F.array(*[F.struct(F.col(f"finish{e}").alias("f"), "key", "doc_id", F.lit(e).alias("e"), "size", rng(f"finish{e}").alias("r")) for e in (1, 2)])).alias("x")
    ).select("x.f", "x.key", "x.doc_id", "x.e", "x.size", "x.r").where(F.col("r") == cut["_r"])
    total = F.sum("size").over(Window.partitionBy("r").orderBy("f", "key", "doc_id", "e", "size").rowsBetween(Window.unboundedPreceding, 0))
    last = edge.withColumn("run", total).where(F.col("run") + F.lit(cut["_base"]) <= budget).orderBy(F.desc("f"), F.desc("key"), F.desc("doc_id"), F.desc("e")).first()
    def taken(e: int) -> Column:
        inside = rng(f"finish{e}") < cut["_r"]
        if last is None:
            return inside
        here = F.struct(F.col(f"finish{e}").alias("f"), "key", F.lit(e).alias("e"))
        there = F.struct(F.lit(last["f"]).alias("f"), F.lit(last["key"]).alias("key"), F.lit(last["e"]).alias("e"))
        return inside | ((rng(f"finish{e}") == cut["_r"]) & (here <= there))
    copies = F.when(F.col("size") > 0, taken(1).cast("int") + taken(2).cast("int")).otherwise(0)
    return timed.withColumn("copies", copies).drop("key")


def mix_sources(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: columns of docs, each row repeated as often as it is sent, range-sorted by virtual finish time.

    Rows that agree in id, source and size are sent alike, as often as the most sent of them.
    """
    how = {"seed": "mix"} | how
    source, doc_id, text = (how.get(k, k) for k in ("source", "doc_id", "text"))
    plan = mix_plan(docs, **how)
    plan = plan.where("copies > 0").groupBy("doc_id", "source", "size").agg(F.max("finish1").alias("_f1"), F.max("finish2").alias("_f2"), F.max("copies").alias("_c"))
    plan = plan.select(F.col("doc_id").alias("_id"), F.col("source").alias("_src"), F.col("size").alias("_size"), "_f1", "_f2", "_c")
    on = F.col(doc_id).eqNullSafe(F.col("_id")) & F.col(source).eqNullSafe(F.col("_src")) & (word_count(F.col(text)) == F.col("_size"))
    sent = docs.join(plan, on).withColumn("_f", F.explode(F.slice(F.array("_f1", "_f2"), F.lit(1), F.col("_c"))))
    return sent.repartitionByRange("_f").sortWithinPartitions("_f").select(*docs.columns)


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || 'mix') AS key FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS weight FROM totals),
laid AS (SELECT *, 2.0::DOUBLE * source_size / weight AS full_at, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM weighed),
levels AS (
  SELECT *, (budget - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM laid),
targets AS (
  SELECT source, source_size, weight, budget,
    least(2.0::DOUBLE * source_size, weight * coalesce(max(level) FILTER (WHERE level <= full_at) OVER (), max(full_at) OVER ())) AS target FROM levels),
run AS (
  SELECT s.doc_id, s.size, s.key, t.source_size, t.target, t.weight, t.budget,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS cum
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
sent AS (
  SELECT doc_id, key, size, e, budget, (cum + (e - 1) * source_size) / weight AS finish FROM run, (VALUES (1), (2)) v(e) WHERE size > 0),
ordered AS (SELECT *, sum(size) OVER (ORDER BY finish, key, doc_id, e ROWS UNBOUNDED PRECEDING) AS upto FROM sent),
kept AS (SELECT doc_id, size, count(*) AS copies FROM ordered WHERE upto <= budget GROUP BY doc_id, size)
SELECT r.doc_id, CAST(r.size AS BIGINT) AS size, r.source_size, r.target, CAST(r.size * coalesce(k.copies, 0) AS BIGINT) AS taken
FROM run r LEFT JOIN kept k ON r.doc_id = k.doc_id AND r.size = k.size
"""
