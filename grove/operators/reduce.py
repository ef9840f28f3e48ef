"""Semi-joins and the full reducer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grove.functions.expressions import total
from grove.plans.tree import JoinTree


def _condition(left: DataFrame, on: tuple[str, ...], right: DataFrame, to: tuple[str, ...]) -> Column:
    out = None
    for a, b in zip(on, to):
        each = left[a] == right[b]
        out = each if out is None else out & each
    return out


def _keys(right: DataFrame, to: tuple[str, ...]) -> DataFrame:
    return right.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(to)])


def semi_join(left: DataFrame, right: DataFrame, on: tuple[str, ...], to: tuple[str, ...]) -> DataFrame:
    """Rows of left with a match in right."""
    keys = _keys(right, to)
    return left.join(keys, _condition(left, on, keys, tuple(keys.columns)), "left_semi")


def anti_join(left: DataFrame, right: DataFrame, on: tuple[str, ...], to: tuple[str, ...]) -> DataFrame:
    """Rows of left without a match in right."""
    keys = _keys(right, to)
    return left.join(keys, _condition(left, on, keys, tuple(keys.columns)), "left_anti")


def counting_semi_join(left: DataFrame, right: DataFrame, on: tuple[str, ...], to: tuple[str, ...], value: str | None = None, name: str = "n") -> DataFrame:
    """left with the number of its matches in right, or the sum of a non-negative column over them; 0 without a match.

    right is aggregated by key first, so the join never multiplies rows, and a hot key of right is one row in the shuffle.
    """
    keys = right.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(to)], *([F.col(value).alias("__v")] if value else []))
    made = keys.groupBy(*[f"__k{i}" for i in range(len(to))]).agg((total(F.col("__v")) if value else F.count(F.lit(1))).alias("__n"))
    met = left.join(made, _condition(left, on, made, tuple(f"__k{i}" for i in range(len(to)))), "left")
    return met.select(*left.columns, F.coalesce("__n", F.lit(0)).cast("long").alias(name))


def reduce_up(tree: JoinTree, frames: list[DataFrame]) -> list[DataFrame]:
    """From the leaves up: each relation keeps rows that have a match in all its subtrees."""
    out = list(frames)
    for p, c in reversed(tree.edges()):
        out[p] = semi_join(out[p], out[c], tree.in_parent[c], tree.in_child[c])
    return out


def reduce_down(tree: JoinTree, frames: list[DataFrame]) -> list[DataFrame]:
    """From the root down: each relation keeps rows that have a match in its parent."""
    out = list(frames)
    for p, c in tree.edges():
        out[c] = semi_join(out[c], out[p], tree.in_child[c], tree.in_parent[c])
    return out


def full_reduce(tree: JoinTree, frames: list[DataFrame]) -> list[DataFrame]:
    """Only rows that are part of at least one result row."""
    return reduce_down(tree, reduce_up(tree, frames))


def reduce_by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def annotate(df: DataFrame, counts: DataFrame, *keys: str) -> DataFrame:
    """df with the columns of aggregated counts; rows whose key has none go."""
    return df.join(counts, list(keys), "inner")


def augment(left: DataFrame, right: DataFrame, on: str, to: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of a binary join, each with its key's number of rows on either side (a1, a2), unmatched rows left out."""
    a1 = left.groupBy(F.col(on).alias("__k")).agg(F.count(F.lit(1)).alias("a1"))
    a2 = right.groupBy(F.col(to).alias("__k")).agg(F.count(F.lit(1)).alias("a2"))
    both = a1.join(a2, "__k")
    return left.join(both, left[on] == both["__k"]).drop("__k"), right.join(both, right[to] == both["__k"]).drop("__k")
