"""Connected components of a distributed edge table by alternating large-star and small-star rounds.

Nothing but two numbers a round reaches the driver. A round's minimum of each node is aggregated before the shuffle, and
the join that spreads it is one whose large partitions Spark can split, so a node with very many links is no bottleneck.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.storage import cut


def _star(edges: DataFrame) -> DataFrame:
    """edges (u, v) with m, the least of u and its neighbours."""
    # written, so that the join's large partitions, those of nodes with very many links, can be split
    least = cut(edges.groupBy("u").agg(F.min("v").alias("least")), "least")
    return edges.join(least, "u").withColumn("m", F.least("u", "least"))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """edges (a, b) of longs -> (node, root), root the smallest node that can be reached; nodes without edges are absent."""
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = cut(now, "edges")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first())
    before = mark(now)
    for _ in range(rounds):
        if not before[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(_star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large-star")
        small = _star(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = cut(small, "edges")
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
