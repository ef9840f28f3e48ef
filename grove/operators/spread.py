"""Joins and copies dealt to tasks by the rows that they give, not by the bytes that they read.

Spark sizes its tasks by what is read. A few thousand rows of a few keys on either side give billions of rows, and then one
task makes them all. Here keys are counted first. A heavy key's rows are split into blocks on either side, each left block is
copied for each right block and the other way round, and both copies get the place at which the two meet: expansion and
alignment, of blocks. Every pair of rows meets at one place, so results are exact whatever the sizes of blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block, and rows that a task gives, about.
BLOCK, EACH = 1024, 1 << 21
#: Tasks of a join at most; beyond that each gives more.
TASKS = 20_000

#: A row's copies are made in arrays of this many, so that no array grows with the weight.
COPIES = 1 << 16


def copies(df: DataFrame, weight: Column, ordinal: str, deal: float = 0, size: int = COPIES) -> DataFrame:
    """df, each row as often as its weight says, with the number of the copy from 0. deal: the sum of weights, if known.

    Where that is more than a task's worth, arrays are dealt over tasks before they are made.
    """
    some = df.withColumn("__w", weight.cast("long")).where("__w > 0")
    blocks = some.withColumn("__b", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__w - 1) div {size}"))))
    blocks = dealt(blocks, deal)
    last = F.least(F.lit(size).cast("long"), F.col("__w") - F.col("__b") * size) - 1
    made = blocks.withColumn("__o", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return made.select(*df.columns, (F.col("__o") + F.col("__b") * size).alias(ordinal))


def dealt(df: DataFrame, rows: float, *by: str) -> DataFrame:
    """df over as many tasks as so many rows need, which adaptive execution leaves as they are; by: columns, else by turns."""
    return df.repartition(min(TASKS, int(rows // EACH) + 1), *by) if rows > EACH else df


def meet(left: DataFrame, right: DataFrame, on: list[str], to: list[str], pairs: float, only: Column | None = None) -> DataFrame:
    """The join of two sides that carry __g1 and __g2, their key's blocks on either side, and __mine, the row's own block."""
    place = F.col("__mine") * F.col("__g2") + F.col("__i")
    a = copies(left, F.col("__g2"), "__i").withColumn("__place", place).drop("__mine", "__i", "__g1", "__g2")
    place = F.col("__i") * F.col("__g2") + F.col("__mine")
    b = copies(right, F.col("__g1"), "__i").withColumn("__there", place).drop("__mine", "__i", "__g1", "__g2")
    condition = F.col("__place") == F.col("__there")
    for x, y in zip(on, to):
        condition = condition & (F.col(f"`{x}`") == F.col(f"`{y}`"))
    a, b = dealt(a, pairs, *[f"`{x}`" for x in on], "__place"), dealt(b, pairs, *[f"`{y}`" for y in to], "__there")
    # copies are not in Spark's estimate of a side's size, so that no side may be broadcast by it
    return a.join(b.hint("merge"), condition if only is None else condition & only).drop("__place", "__there")


def key_counts(left: DataFrame, right: DataFrame, on: list[str], to: list[str]) -> DataFrame:
    """The keys that both sides have, as __k0, __k1, ..., with their rows on either side (__a1, __a2)."""
    keyed = lambda df, names, n: df.groupBy(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(names)]).agg(F.count(F.lit(1)).alias(n))
    return keyed(left, on, "__a1").join(keyed(right, to, "__a2"), [f"__k{i}" for i in range(len(on))])


def blocks_of(rows: Column) -> Column:
    return F.ceil(rows / F.lit(BLOCK)).cast("long")


def spread_join(left: DataFrame, right: DataFrame, on: list[str], to: list[str], only: Column | None = None) -> DataFrame:
    """The inner join of two sides with distinct column names; only: a further condition on pairs.

    Keys are counted by an action. Where pairs are not many more than rows the join is Spark's own. Else the rows of a heavy
    key are put into blocks by a hash of all their columns (rows that are equal in all of them share one).
    """
    keys = key_counts(left, right, on, to)
    product = F.col("__a1").cast("double") * F.col("__a2")
    sums = keys.agg(F.sum(product).alias("pairs"), F.sum(F.col("__a1") + F.col("__a2")).alias("rows")).first()
    pairs = sums["pairs"] or 0
    if pairs <= max(EACH, 4 * (sums["rows"] or 0)):
        condition = F.lit(True) if only is None else only
        for x, y in zip(on, to):
            condition = condition & (F.col(f"`{x}`") == F.col(f"`{y}`"))
        return left.join(right, condition)
    heavy = keys.where(product > BLOCK * BLOCK).withColumns({"__g1": blocks_of(F.col("__a1")), "__g2": blocks_of(F.col("__a2"))}).drop("__a1", "__a2")

    def blocked(df: DataFrame, names: list[str], own: str) -> DataFrame:
        known = df.join(heavy, [F.col(f"`{c}`") == F.col(f"__k{i}") for i, c in enumerate(names)], "left").drop(*[f"__k{i}" for i in range(len(names))])
        known = known.withColumns({g: F.coalesce(g, F.lit(1).cast("long")) for g in ("__g1", "__g2")})
        return known.withColumn("__mine", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.col(own)))

    return meet(blocked(left, on, "__g1"), blocked(right, to, "__g2"), on, to, pairs, only)
