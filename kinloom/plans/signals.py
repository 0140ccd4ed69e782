"""Five similarity signals of file pairs, from source text to a score.

S1: fingerprints of what is outside methods; S2: subtree hashes; S3: fingerprints of methods, best matches both ways; S4: tree edit
distance of methods, likewise; S5: names of external calls, -1 where neither file has any.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom.functions import hashing, lexical
from kinloom.operators import fingerprint, pairs, programs, sequence, syntax

FILE_K, FILE_W, METHOD_K, METHOD_W = 6, 5, 4, 3
_TREE = T.StructType([T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("post", T.ArrayType(T.StructType([T.StructField("leaf", T.IntegerType()), T.StructField("label", T.StringType())])))])


def _prints(labels: Column, k: int, w: int) -> Column:
    return F.array_distinct(F.transform(hashing.fingerprints_column(labels, k, w), lambda x: x["hash"]))


def _trees(rows: Column) -> Column:
    """struct(hashes, post) of pre-order nodes."""

    def run(lists: pa.Array) -> pa.Array:
        signed = lambda h: h - (1 << 64) if h >> 63 else h
        out = []
        for x in lists.to_pylist():
            x = x or []
            out.append({"hashes": sorted(signed(h) for h in syntax.subtree_hashes(x)), "post": [{"leaf": a, "label": b} for a, b in syntax.postorder(x)]})
        return pa.array(out, pa.struct([("hashes", pa.list_(pa.int64())), ("post", pa.list_(pa.struct([("leaf", pa.int32()), ("label", pa.string())])))]))

    return F.arrow_udf(run, _TREE)(rows)


def method_trees(nodes: DataFrame) -> DataFrame:
    """(file_id, method, size, prints, hashes, post): a method's subtree, by pre-order numbers within the file."""
    m = nodes.where("label = 'MethodDeclaration'").select("file_id", F.col("node_id").alias("method"), F.col("subtree_size").alias("size"))
    inside = nodes.join(m, "file_id").where("node_id >= method and node_id < method + size")
    words = F.concat(F.array(F.concat(F.lit("N:"), "label")), F.transform("tokens", lambda t: F.concat(F.lit("L:"), t)))
    row = F.struct("node_id", "depth", "label", words.alias("words"))
    per = inside.groupBy("file_id", "method", "size").agg(F.array_sort(F.collect_list(row)).alias("x"))
    laid = per.select("file_id", "method", "size", _prints(F.flatten(F.transform("x", lambda r: r["words"])), METHOD_K, METHOD_W).alias("prints"), _trees(F.transform("x", lambda r: F.struct(r["depth"].alias("depth"), r["label"].alias("label")))).alias("t"))
    return laid.select("file_id", "method", "size", "prints", "t.hashes", "t.post")


def _by_file(df: DataFrame, side: str, names: list[str]) -> DataFrame:
    return df.select(F.col("file_id").alias(f"file_{side}"), *[F.col(n).alias(f"{n}_{side}") for n in names])


def five_signals(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pair_id, s1 .. s5, token_layer, overall) of wanted (pair_id, file_a, file_b); files: (file_id, text)."""
    nodes = syntax.ast_nodes(files)
    outside = syntax.linearised(nodes, outside_methods=True).select("file_id", _prints(F.col("labels"), FILE_K, FILE_W).alias("prints"))
    calls = syntax.external_calls(files.select("file_id", lexical.raw_tokens(F.col("text")).alias("tokens")), nodes).groupBy("file_id").agg(F.collect_set("call").alias("calls"))
    per_file = files.select("file_id").join(outside, "file_id", "left").join(calls, "file_id", "left").select("file_id", *[F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("prints", "array<bigint>"), ("calls", "array<string>"))])
    base = wanted
    for side in "ab":
        base = base.join(_by_file(per_file, side, ["prints", "calls"]), f"file_{side}")
    none = (F.size("calls_a") == 0) & (F.size("calls_b") == 0)
    base = base.select("pair_id", "file_a", "file_b", fingerprint.set_jaccard(F.col("prints_a"), F.col("prints_b")).alias("s1"), F.when(none, F.lit(-1.0)).otherwise(fingerprint.set_jaccard(F.col("calls_a"), F.col("calls_b"))).alias("s5"))
    trees = method_trees(nodes)
    met = base.select("pair_id", "file_a", "file_b")
    for side in "ab":
        met = met.join(_by_file(trees, side, ["method", "size", "prints", "hashes", "post"]), f"file_{side}")
    far = sequence.tree_distance_column(F.col("post_a"), F.col("post_b"))
    scored = met.select(
        "pair_id", "method_a", "method_b", "size_a", "size_b", fingerprint.set_jaccard(F.col("hashes_a"), F.col("hashes_b")).alias("s2"), fingerprint.set_jaccard(F.col("prints_a"), F.col("prints_b")).alias("s3"),
        F.greatest(F.lit(0.0), 1 - far / F.greatest("size_a", "size_b")).alias("s4"),
    )
    out = base.select("pair_id", "s1", "s5")
    for s in ("s2", "s3", "s4"):
        best = programs.directional_average(scored.withColumn("score", F.col(s))).select("pair_id", F.col("average").alias(s))
        out = out.join(best, "pair_id", "left").withColumn(s, F.coalesce(s, F.lit(0.0)))
    return pairs.combine_signals(out).select("pair_id", "s1", "s2", "s3", "s4", "s5", "token_layer", "overall")
