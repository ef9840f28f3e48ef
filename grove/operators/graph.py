"""Edge tables and the subgraphs that workloads are built from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grove.operators.scans import top_per_group
from grove.storage import cut


def edges_of(df: DataFrame, source: str, target: str) -> DataFrame:
    """Distinct edges (source, target) as longs."""
    return df.select(F.col(source).cast("long").alias("source"), F.col(target).cast("long").alias("target")).dropna().distinct()


def out_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("source").agg(F.count(F.lit(1)).alias("degree"))


def hub_edges(edges: DataFrame, hubs: int, middle_cap: int, leaf_cap: int) -> DataFrame:
    """Edges below the best hubs, at most `middle_cap` a hub and `leaf_cap` a middle node.

    A node's score is the sum, over its middle_cap best children, of the square of min(leaf_cap, the child's out-degree).
    """
    degrees = out_degrees(edges).select(F.col("source").alias("target"), F.least("degree", F.lit(leaf_cap)).cast("long").alias("reach"))
    valued = edges.join(degrees, "target")
    best = top_per_group(valued, middle_cap, ["source"], [F.desc("reach"), "target"])
    score = best.groupBy("source").agg(F.sum(F.col("reach") * F.col("reach")).alias("score"))
    chosen = score.orderBy(F.desc("score"), "source").limit(hubs).select("source")
    top = best.join(F.broadcast(chosen), "source").select("source", "target")  # `hubs` rows
    middle = top.select(F.col("target").alias("source")).distinct()
    leaves = top_per_group(edges.join(middle, "source", "left_semi"), leaf_cap, ["source"], ["target"])
    return top.union(leaves.select("source", "target")).distinct()


def kout_core(edges: DataFrame, k: int, rounds: int = 200) -> DataFrame:
    """The largest subgraph in which every node has at least k edges out: nodes with fewer are peeled until none is left."""
    now, n = cut(edges, "core"), None
    for _ in range(rounds):
        size = now.count()
        if size == n:
            return now
        n = size
        stay = now.groupBy("source").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") >= k).select(F.col("source").alias("node"))
        inside = now.join(stay, now["source"] == stay["node"], "left_semi")
        now = cut(inside.join(stay, inside["target"] == stay["node"], "left_semi"), "core")
    raise RuntimeError(f"the core did not settle in {rounds} rounds")


def degree_aliases(edges: DataFrame, degrees: list[int]) -> list[DataFrame]:
    """For each degree an alias of the edge table with at most so many edges a node, the smallest targets first."""
    number = F.row_number().over(Window.partitionBy("source").orderBy("target"))
    numbered = edges.withColumn("__n", number)
    return [numbered.where(F.col("__n") <= d).drop("__n") for d in degrees]


def mixed_degrees(relations: int, k: int) -> list[int]:
    """Degrees 3 for the first k relations and 2 for the others."""
    return [3] * k + [2] * (relations - k)


def sampled_degree(edges: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """k edges a node (all where it has fewer), drawn by a hash of seed and target."""
    return top_per_group(edges, k, ["source"], [F.xxhash64(F.lit(seed), F.col("target")), F.col("target")])


def _colours(nodes: DataFrame, edges: DataFrame, seed: int, rounds: int) -> DataFrame:
    """(node, colour): of the nodes that a node is reached from, itself included, the first in an order drawn by the seed."""
    drawn = F.struct(F.xxhash64(F.lit(seed), F.col("node")).alias("draw"), F.col("node").alias("name"))
    now = cut(nodes.select("node", drawn.alias("colour")), "colours")
    for _ in range(rounds):
        heard = now.join(edges, now["node"] == edges["source"]).groupBy(F.col("target").alias("node")).agg(F.min("colour").alias("heard"))
        new = now.join(heard, "node", "left").select("node", F.least("colour", F.coalesce("heard", "colour")).alias("colour"), (F.col("heard") < F.col("colour")).alias("moved"))
        new = cut(new, "colours")
        now = new.select("node", "colour")
        if not new.where("moved").limit(1).count():
            return now.select("node", F.col("colour.name").alias("colour"))
    raise RuntimeError(f"colours did not settle in {rounds} rounds")


def _among(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends among the nodes."""
    keep = nodes.select("node")
    edges = edges.join(keep, edges["source"] == keep["node"], "left_semi")
    return edges.join(keep, edges["target"] == keep["node"], "left_semi")


def strong_components(edges: DataFrame, rounds: int = 500) -> DataFrame:
    """(node, component) of all nodes, the component named by its smallest node.

    Divide and conquer in a drawn order: a node takes the colour of the first node that reaches it. A component never
    spans two colours, so edges between colours go, and what reaches a colour's first node back is that node's component.
    Components are taken out and the rest goes again under a new draw; the rounds expected grow with the logarithm of the
    number of nodes, whatever the graph's shape. Nodes without an edge in or without one out are components by themselves
    and are taken out before. A round spreads colours edge by edge, so its passes are bounded by the longest shortest way.
    An answer is whole or there is none: RuntimeError after `rounds` rounds, or as many passes of one round.
    """
    left = cut(edges.where("source <> target").distinct(), "edges")
    nodes = cut(edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct(), "nodes")
    found: list[DataFrame] = []
    for seed in range(rounds):
        if not nodes.limit(1).count():
            break
        both = left.select(F.col("source").alias("node")).intersect(left.select(F.col("target").alias("node")))
        inner = cut(both, "inner")
        found.append(cut(nodes.join(inner, "node", "left_anti").select("node", F.col("node").alias("component")), "component"))
        left = cut(_among(left, inner), "edges")
        colour = _colours(inner, left, seed, rounds)
        a = colour.select(F.col("node").alias("source"), F.col("colour").alias("c1"))
        b = colour.select(F.col("node").alias("target"), F.col("colour").alias("c2"))
        left = cut(left.join(a, "source").join(b, "target").where("c1 = c2").select("source", "target"), "edges")
        back = left.select(F.col("target").alias("source"), F.col("source").alias("target"))
        reach = cut(colour.where("node = colour").select("node"), "reach")
        for _ in range(rounds):
            size = reach.count()
            more = back.join(reach, back["source"] == reach["node"], "left_semi").select(F.col("target").alias("node"))
            reach = cut(reach.union(more).distinct(), "reach")
            if reach.count() == size:
                break
        else:
            raise RuntimeError(f"components did not settle in {rounds} passes")
        done = reach.join(colour, "node")
        names = done.groupBy("colour").agg(F.min("node").alias("component"))
        found.append(cut(done.join(names, "colour").select("node", "component"), "component"))
        nodes = cut(inner.join(reach, "node", "left_anti"), "nodes")
        left = cut(_among(left, nodes), "edges")
    else:
        if nodes.limit(1).count():
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return reduce(DataFrame.union, found, nodes.select("node", F.col("node").alias("component")))


def sink_component(edges: DataFrame) -> DataFrame:
    """The edges of the largest strong component without an edge out of it; of equals the one with the smallest node."""
    named = cut(strong_components(edges), "components")
    a = named.select(F.col("node").alias("source"), F.col("component").alias("c1"))
    b = named.select(F.col("node").alias("target"), F.col("component").alias("c2"))
    both = edges.join(a, "source").join(b, "target")
    leaving = both.where("c1 <> c2").select(F.col("c1").alias("component")).distinct()
    sizes = named.join(leaving, "component", "left_anti").groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    best = sizes.orderBy(F.desc("n"), "component").limit(1).select(F.col("component").alias("c1"))
    return both.where("c1 = c2").join(F.broadcast(best), "c1", "left_semi").select("source", "target")


def key_shape(df: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys, the largest count, and the Gini coefficient of the counts.

    Keys of equal counts are handled together, so the running sums go over distinct counts and not over keys.
    """
    sizes = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    by_size = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("keys"))
    w = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    ranked = by_size.withColumn("before", F.coalesce(F.sum("keys").over(w), F.lit(0)))
    # ranks before + 1 .. before + keys, each with weight n
    ranks = F.col("keys") * F.col("before") + F.col("keys") * (F.col("keys") + 1) / 2
    sums = ranked.agg(F.sum("keys").alias("k"), F.max("n").alias("m"), F.sum(F.col("n") * F.col("keys")).alias("t"), F.sum(F.col("n") * ranks).alias("r"))
    return sums.select(
        F.coalesce("k", F.lit(0)).alias("n_keys"),
        F.coalesce("m", F.lit(0)).alias("max_count"),
        F.when(F.coalesce("k", F.lit(0)) > 0, 2 * F.col("r") / (F.col("k") * F.col("t")) - (F.col("k") + 1) / F.col("k")).otherwise(0.0).alias("gini"),
    )
