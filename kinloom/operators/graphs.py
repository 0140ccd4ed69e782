"""Control-flow and dependence graphs held as node and edge relations."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom.functions.hashing import md5_60

# What an aligned node of an operation is worth.
SUBSTANCE = {"CALL": 0.8, "ASSIGNMENT": 0.6, "RETURN": 0.1, "CONSTANT": 0.1, "OTHER": 0.1}
BRIDGE_DEPTH, MIN_PAIRS, MAX_BLOCK_DISTANCE, BUDGET = 6, 2, 0.5, 16


def in_degree(calls: DataFrame, target: str = "target") -> DataFrame:
    return calls.groupBy(target).agg(F.count("*").alias("in_degree"))


def degrees(edges: DataFrame) -> DataFrame:
    """(graph_id, node, in_degree, out_degree): both ends in one aggregation."""
    ends = edges.select("graph_id", F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("graph_id", "e.node").agg(F.sum(1 - F.col("e.o")).alias("in_degree"), F.sum("e.o").alias("out_degree"))


def wl_labels(nodes: DataFrame, edges: DataFrame, rounds: int = 3) -> DataFrame:
    """(graph_id, node, label0 .. label<rounds>): each round hashes a node's label with the sorted labels around it, by edge kind and direction."""
    both = edges.select("graph_id", F.explode(F.array(F.struct(F.col("src").alias("at"), F.col("dst").alias("of"), F.concat(F.lit("o"), "kind").alias("way")), F.struct(F.col("dst").alias("at"), F.col("src").alias("of"), F.concat(F.lit("i"), "kind").alias("way")))).alias("e")).select("graph_id", "e.at", "e.of", "e.way")
    labels = nodes.select("graph_id", "node", md5_60(F.col("label")).alias("label0"))
    for k in range(rounds):
        around = both.join(labels.select("graph_id", F.col("node").alias("of"), F.col(f"label{k}").alias("l")), ["graph_id", "of"])
        told = around.groupBy("graph_id", F.col("at").alias("node")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "way", F.col("l").cast("string")))), ",").alias("near"))
        labels = labels.join(told, ["graph_id", "node"], "left").withColumn(f"label{k + 1}", md5_60(F.concat_ws("|", F.col(f"label{k}").cast("string"), F.coalesce("near", F.lit(""))))).drop("near")
    return labels


def seeds(left: DataFrame, right: DataFrame, passes: list[tuple[str, float, str]]) -> DataFrame:
    """(pair_id, left_node, right_node, strength, evidence): hash equi-joins, one for each (column, strength, name); 0 and null match nothing."""
    found = None
    for column, strength, name in passes:
        a = left.select("pair_id", F.col("node").alias("left_node"), F.col(column).alias("h")).where("h is not null and h <> 0")
        b = right.select("pair_id", F.col("node").alias("right_node"), F.col(column).alias("h"))
        hit = a.join(b, ["pair_id", "h"]).select("pair_id", "left_node", "right_node", F.lit(strength).alias("s"), F.lit(name).alias("e"))
        found = hit if found is None else found.unionByName(hit)
    return found.groupBy("pair_id", "left_node", "right_node").agg(F.max("s").alias("strength"), F.array_sort(F.collect_set("e")).alias("evidence"))


def agreement(left_value: Column, right_value: Column, left_wl: Column, right_wl: Column) -> Column:
    return F.when((left_value != 0) & (left_value == right_value), 1.0).when(left_wl == right_wl, 0.8).otherwise(0.5)


def greedy_matching(pairs: list[tuple[float, str, str]]) -> list[tuple[str, str, float]]:
    """One-to-one matches, most alike first; ties by names."""
    left, right, out = set(), set(), []
    for distance, a, b in sorted(pairs):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            out.append((a, b, distance))
    return out


_MATCHED = T.StructType([T.StructField("pair_id", T.LongType()), T.StructField("left_block", T.StringType()), T.StructField("right_block", T.StringType()), T.StructField("distance", T.DoubleType())])


def match_blocks(distances: DataFrame) -> DataFrame:
    """Greedy one-to-one block matching within each pair of methods (pair_id, left_block, right_block, distance)."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        found = greedy_matching([(r["distance"], r["left_block"], r["right_block"]) for r in rows])
        return pa.Table.from_pylist([{"pair_id": rows[0]["pair_id"], "left_block": a, "right_block": b, "distance": d} for a, b, d in found], schema=pa.schema([("pair_id", pa.int64()), ("left_block", pa.string()), ("right_block", pa.string()), ("distance", pa.float64())]))

    return distances.select("pair_id", "left_block", "right_block", "distance").groupBy("pair_id").applyInArrow(run, _MATCHED)


def cfg_score(method_distance: Column, block_similarity: Column, preserved: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.30 * (1 - method_distance) + 0.45 * block_similarity + 0.25 * preserved))


def common_subgraph(distance: dict[tuple[str, str], float], left_edges: set[tuple[str, str]], right_edges: set[tuple[str, str]], blocks: tuple[int, int]) -> float:
    """Distance of two graphs by a bounded branch-and-bound search for a common induced subgraph over block pairs at most 0.5 apart.

    1 - (matched - sum of distances) / larger size; the search stops after 16 steps for each block of the larger graph.
    """
    larger = max(blocks)
    if larger == 0:
        return 0.0
    pairs = sorted((d, a, b) for (a, b), d in distance.items() if d <= MAX_BLOCK_DISTANCE)
    best, steps = 0.0, 0

    def fits(a: str, b: str, chosen: list[tuple[str, str]]) -> bool:
        return all(a != x and b != y and ((a, x) in left_edges) == ((b, y) in right_edges) and ((x, a) in left_edges) == ((y, b) in right_edges) for x, y in chosen)

    stack: list[tuple[int, list[tuple[str, str]], float]] = [(0, [], 0.0)]
    while stack and steps < BUDGET * larger:
        at, chosen, gain = stack.pop()
        steps += 1
        best = max(best, gain)
        if at == len(pairs) or gain + min(len(pairs) - at, min(blocks) - len(chosen)) <= best:
            continue
        d, a, b = pairs[at]
        stack.append((at + 1, chosen, gain))
        if fits(a, b, chosen):
            stack.append((at + 1, [*chosen, (a, b)], gain + 1 - d))
    return 1 - best / larger


def grow_regions(seed_pairs: list[tuple[int, int]], left: dict[int, dict], right: dict[int, dict]) -> list[list[tuple[int, int, float]]]:
    """Aligned regions as lists of (left, right, agreement), grown from seeds in order.

    A node is a dict with label, value, wl, kind, op, out and in (neighbour ids). From an aligned pair, neighbours in
    one direction are reached through returns and parameters up to six steps; nearest first, then best agreement, then id.
    Nodes of an accepted region (two pairs or more) are not used again.
    """

    def reach(graph: dict[int, dict], start: int, way: str) -> dict[int, int]:
        depth, queue = {start: 0}, deque([start])
        while queue:
            node = queue.popleft()
            passes = node == start or graph[node]["kind"] in ("RETURN", "PARAM") or graph[node]["op"] == "RETURN"
            if passes and depth[node] < BRIDGE_DEPTH:
                for other in graph[node][way]:
                    if other in graph and other not in depth:
                        depth[other] = depth[node] + 1
                        queue.append(other)
        del depth[start]
        return depth

    def agree(a: int, b: int) -> float:
        x, y = left[a], right[b]
        return 1.0 if x["value"] and x["value"] == y["value"] else 0.8 if x["wl"] == y["wl"] else 0.5

    regions, gone_left, gone_right = [], set(), set()
    for seed in seed_pairs:
        if seed[0] in gone_left or seed[1] in gone_right:
            continue
        aligned, used, queue = {seed[0]: seed[1]}, {seed[1]}, deque([seed])
        while queue:
            a, b = queue.popleft()
            for way in ("out", "in"):
                near, far = reach(left, a, way), reach(right, b, way)
                for x in sorted(near, key=lambda n: (near[n], n)):
                    if x in aligned or x in gone_left:
                        continue
                    open_ = [y for y in far if y not in used and y not in gone_right and left[x]["label"] == right[y]["label"]]
                    if open_:
                        y = min(open_, key=lambda n: (far[n], -agree(x, n), n))
                        aligned[x] = y
                        used.add(y)
                        queue.append((x, y))
        if len(aligned) >= MIN_PAIRS:
            gone_left |= set(aligned)
            gone_right |= set(aligned.values())
            regions.append([(x, y, agree(x, y)) for x, y in aligned.items()])
    return regions


def region_totals(aligned: DataFrame) -> DataFrame:
    """Strength, coverage and priority of regions from (pair_id, region, op, agreement)."""
    worth = F.coalesce(*[F.when(F.col("op") == k, v) for k, v in SUBSTANCE.items()], F.lit(1.0))
    per = aligned.groupBy("pair_id", "region").agg(F.count("*").alias("pairs"), F.avg("agreement").alias("strength"), F.sum(worth).alias("coverage"))
    return per.withColumn("priority", F.col("coverage") * (0.5 + 0.5 * F.col("strength")))


def loops(edges: list[tuple[str, str]]) -> int:
    """Loops of a graph: strongly connected components of two nodes or more, and self loops outside them (Kosaraju, without recursion)."""
    out, into, nodes = {}, {}, set()
    for a, b in edges:
        out.setdefault(a, []).append(b)
        into.setdefault(b, []).append(a)
        nodes |= {a, b}

    def walk(start: str, graph: dict, seen: set) -> list[str]:
        order, stack = [], [(start, iter(graph.get(start, ())))]
        seen.add(start)
        while stack:
            node, rest = stack[-1]
            nxt = next((x for x in rest if x not in seen), None)
            if nxt is None:
                stack.pop()
                order.append(node)
            else:
                seen.add(nxt)
                stack.append((nxt, iter(graph.get(nxt, ()))))
        return order

    seen: set = set()
    finish = [x for n in sorted(nodes) if n not in seen for x in walk(n, out, seen)]
    seen, count = set(), 0
    for n in reversed(finish):
        if n not in seen:
            part = walk(n, into, seen)
            count += len(part) > 1 or n in out.get(n, ())
    return count


def tree_levels(nodes: DataFrame, depth: int) -> DataFrame:
    """(tree_id, node_id, depth, hash): subtree hashes bottom-up, a join a level; nodes: (tree_id, node_id, parent_id, ordinal, label, depth)."""
    done = nodes.where(F.col("depth") == depth).select("tree_id", "node_id", "parent_id", "ordinal", "depth", md5_60(F.col("label")).alias("hash"), F.lit(1).cast("long").alias("size"))
    out = done
    for level in range(depth - 1, -1, -1):
        kids = done.groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "hash"))), lambda x: x["hash"].cast("string")), ",").alias("kids"), F.sum("size").alias("below")
        )
        here = nodes.where(F.col("depth") == level).join(kids, ["tree_id", "node_id"], "left")
        done = here.select("tree_id", "node_id", "parent_id", "ordinal", "depth", md5_60(F.concat_ws("|", "label", "kids")).alias("hash"), (1 + F.coalesce("below", F.lit(0))).alias("size"))
        out = out.unionByName(done)
    return out
