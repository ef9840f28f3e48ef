"""Exact sizes of tree joins without joining: counts from the leaves up, contributions from the root down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.functions.expressions import MOST, times, total
from grove.operators.reduce import counting_semi_join
from grove.plans.tree import JoinTree


class CountOverflow(OverflowError):
    """A count has reached the largest long."""


def with_counts(tree: JoinTree, frames: list[DataFrame]) -> list[DataFrame]:
    """Each relation with __u<child>, the join rows of the child's subtree that match, and __delta, their product.

    A row's __delta is the number of join rows of its own subtree that it is part of; one key aggregation and one join an
    edge, whatever the size of the result.
    """
    out = list(frames)
    for i in reversed(tree.bfs()):
        for c in tree.children(i):
            out[i] = counting_semi_join(out[i], out[c], tree.in_parent[c], tree.in_child[c], "__delta", f"__u{c}")
        out[i] = out[i].withColumn("__delta", times(*[F.col(f"__u{c}") for c in tree.children(i)]))
    return out


def output_size(tree: JoinTree, frames: list[DataFrame]) -> DataFrame:
    """One row, n: the number of rows of the join, saturating."""
    return with_counts(tree, frames)[tree.root].agg(total(F.col("__delta")).alias("n"))


def count(tree: JoinTree, frames: list[DataFrame], on_overflow: str = "saturate") -> int:
    n = output_size(tree, frames).first()["n"]
    if on_overflow == "error" and n == MOST:
        raise CountOverflow("the join has more rows than a long can count")
    return n


def exceeds(tree: JoinTree, frames: list[DataFrame], threshold: int) -> bool:
    return count(tree, frames) > threshold


def contributions(tree: JoinTree, frames: list[DataFrame]) -> list[DataFrame]:
    """Each relation with __contribution, the number of result rows that a row is part of."""
    counted = with_counts(tree, frames)
    counted[tree.root] = counted[tree.root].withColumn("__outside", F.lit(1).cast("long"))
    for p, c in tree.edges():
        siblings = [F.col(f"__u{s}") for s in tree.children(p) if s != c]
        above = counted[p].withColumn("__share", times(F.col("__outside"), *siblings))
        counted[c] = counting_semi_join(counted[c], above, tree.in_child[c], tree.in_parent[c], "__share", "__outside")
    return [df.select(*f.columns, times(F.col("__outside"), F.col("__delta")).alias("__contribution")) for f, df in zip(frames, counted)]


def sensitivity(tree: JoinTree, frames: list[DataFrame]) -> int:
    """The largest contribution of any row of any relation."""
    return max(df.agg(F.max("__contribution").alias("m")).first()["m"] or 0 for df in contributions(tree, frames))


def max_degree(df: DataFrame, *columns: str) -> DataFrame:
    """One row, n: the largest number of rows that agree on the columns; all rows where no column is given."""
    if not columns:
        return df.agg(F.count(F.lit(1)).alias("n"))
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"))
