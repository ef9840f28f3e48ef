"""Output positions of a tree join traced to the rows they stand for, for all positions, a range, or a sample.

Counts are known before anything is joined. A root row owns as many positions as join rows it is part of; a position's
offset within the row is a mixed-radix number with one digit a child; a child's digit falls into the interval of counts of
one of the child's rows with that key. So each edge is one join, on the key and a bin of positions, and work is in
proportion to the positions asked for, not to the join. Ranges of positions are traced as runs: they become single positions
only at the last leaf.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grove.functions.expressions import times
from grove.operators.counting import with_counts
from grove.operators.scans import expand, global_fill_down, global_prefix_sum
from grove.operators.spread import spread_join
from grove.plans.tree import JoinTree


def _numbered_root(tree: JoinTree, counted: DataFrame, columns: list[str]) -> DataFrame:
    return global_prefix_sum(counted.where("__delta > 0"), "__delta", columns, "__start")


#: Positions of a bin, of one where runs of positions are traced, and bins that one row reaches into at most, about.
BIN, RUN_BIN, REACH = 64, 1024, 1024


def _bin(tree: JoinTree, child: int, counted: DataFrame, least: int) -> int:
    if not tree.children(child):
        return least
    return max(least, (counted.agg(F.max("__delta").alias("m")).first()["m"] or 0) // REACH)


def _trace(tree: JoinTree, frames: list[DataFrame], counted: list[DataFrame], out: DataFrame, runs: bool = False) -> DataFrame:
    """out: root rows with __pos and __l<root>, the offset within the row; with runs also __n, for the positions from there on.

    A run is cut only where a digit other than that of a node's last child changes, so it is traced as one row through the
    other children, and goes on in the last child's subtree. It ends as single positions at the last leaf.
    """
    root = tree.root
    named = lambda i: [F.col(f"`{c}`").alias(f"r{i}__{c}") for c in frames[i].columns]
    us = lambda i: [F.col(f"__u{c}") for c in tree.children(i)]
    div = lambda x, y: F.call_function("div", x, y)
    state = out.select("__pos", f"__l{root}", *(["__n"] if runs else []), *named(root), *us(root))
    running = root if runs else None
    for i in tree.bfs():
        kids = tree.children(i)
        if kids and i == running:
            running, u, at, n = kids[-1], F.col(f"__u{kids[-1]}"), F.col(f"__l{i}"), F.col("__n")
            state = state.withColumn("__many", div(at + n - 1, u) - div(at, u) + 1)
            state = expand(state, "__many", "__o", even=i == root).drop("__many")
            low = F.greatest(at, (div(at, u) + F.col("__o")) * u)
            high = F.least(at + n, (div(at, u) + F.col("__o") + 1) * u)
            state = state.withColumns({"__pos": F.col("__pos") + low - at, f"__l{i}": low, "__n": high - low}).drop("__o")
        for k, c in enumerate(kids):
            later = times(*[F.col(f"__u{s}") for s in kids[k + 1 :]])
            state = state.withColumn(f"__d{c}", div(F.col(f"__l{i}"), later) % F.col(f"__u{c}"))
        for c in kids:
            key, run = list(tree.in_child[c]), c == running
            w = Window.partitionBy(*key).orderBy(*[F.col(f"`{x}`") for x in frames[c].columns]).rowsBetween(Window.unboundedPreceding, 0)
            # a subtree's counts sum to a long: those that do not cannot be positions
            rows = counted[c].where("__delta > 0").withColumn("__end", F.sum("__delta").over(w))
            rows = rows.select(*named(c), *us(c), "__end", (F.col("__end") - F.col("__delta")).alias("__from"))
            # bins of positions: a key's positions and rows meet bin by bin, not all with all, and a hot key is many join keys
            size = F.lit(_bin(tree, c, counted[c], RUN_BIN if run else BIN)).cast("long")
            rows = rows.withColumn("__cell", F.explode(F.sequence(div(F.col("__from"), size), div(F.col("__end") - 1, size))))
            digit, start, end = F.col(f"__d{c}"), F.col("__from"), F.col("__end")
            on, to = [f"r{i}__{a}" for a in tree.in_parent[c]] + ["__bin"], [f"r{c}__{b}" for b in tree.in_child[c]] + ["__cell"]
            if not run:
                state = state.withColumn("__bin", div(digit, size))
                met = (digit >= start) & (digit < end)
                for a, b in zip(on, to):
                    met = met & (F.col(f"`{a}`") == F.col(f"`{b}`"))
                state = state.join(rows, met).withColumn(f"__l{c}", digit - start)
            else:  # a run in pieces of one bin each, which meet all rows that they overlap
                high = digit + F.col("__n")
                state = state.withColumn("__bin", F.explode(F.sequence(div(digit, size), div(high - 1, size))))
                low, high = F.greatest(digit, F.col("__bin") * size), F.least(high, (F.col("__bin") + 1) * size)
                state = state.withColumns({"__pos": F.col("__pos") + low - digit, f"__d{c}": low, "__n": high - low})
                state = spread_join(state, rows, on, to, (digit < end) & (digit + F.col("__n") > start))
                low, high = F.greatest(digit, start), F.least(digit + F.col("__n"), end)
                state = state.withColumns({"__pos": F.col("__pos") + low - digit, f"__l{c}": low - start, "__n": high - low})
            state = state.drop("__from", "__end", "__bin", "__cell", f"__d{c}")
    return state.drop("__n", *[f"__l{i}" for i in range(len(tree))], *[f"__u{i}" for i in range(len(tree))])


def root_positions(tree: JoinTree, frames: list[DataFrame]) -> DataFrame:
    """The root's rows that are part of the join, with __delta and __start, the first position that each owns."""
    counted = with_counts(tree, frames)[tree.root]
    return _numbered_root(tree, counted, frames[tree.root].columns)


def materialise(tree: JoinTree, frames: list[DataFrame], low: int | None = None, high: int | None = None) -> DataFrame:
    """The join's rows at positions low to high (not included), all by default: __pos and r<i>__<column> of each relation."""
    counted = with_counts(tree, frames)
    root = tree.root
    rows = _numbered_root(tree, counted[root], frames[root].columns)
    first = F.greatest(F.lit(0 if low is None else low).cast("long") - F.col("__start"), F.lit(0).cast("long"))
    last = F.col("__delta") if high is None else F.least(F.col("__delta"), F.lit(high).cast("long") - F.col("__start"))
    rows = rows.withColumn("__first", first).withColumn("__n", last - F.col("__first")).where("__n > 0")
    rows = rows.withColumn(f"__l{root}", F.col("__first")).withColumn("__pos", F.col("__start") + F.col("__first"))
    return _trace(tree, frames, counted, rows, runs=True)


def at_positions(tree: JoinTree, frames: list[DataFrame], positions: DataFrame) -> DataFrame:
    """The join's rows at the positions of a table (column pos); positions beyond the join give nothing."""
    counted = with_counts(tree, frames)
    root = tree.root
    rows = _numbered_root(tree, counted[root], frames[root].columns)
    # positions and first positions in one order: each position belongs to the last row that starts up to it
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    starts = rows.select(F.col("__start").alias("__pos"), F.lit(0).cast("long").alias("__n"), whole.alias("__row"))
    asked = positions.select(F.col("pos").cast("long").alias("__pos")).where("__pos >= 0")
    asked = asked.select("__pos", (F.monotonically_increasing_id() + 1).alias("__n"), F.lit(None).cast(starts.schema["__row"].dataType).alias("__row"))
    met = global_fill_down(starts.unionByName(asked), F.col("__n") == 0, "__row", ["__pos", "__n"], "__owner")
    met = met.where("__n > 0 AND __owner IS NOT NULL").select("__pos", "__owner.*").where(F.col("__pos") < F.col("__start") + F.col("__delta"))
    return _trace(tree, frames, counted, met.withColumn(f"__l{root}", F.col("__pos") - F.col("__start")))


def sample(tree: JoinTree, frames: list[DataFrame], n: int, seed: int = 42) -> DataFrame:
    """n result rows drawn evenly with replacement, without the join."""
    from grove.operators.counting import count

    size = count(tree, frames)
    spark = frames[0].sparkSession
    drawn = spark.range(n if size else 0).select(F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(max(size, 1))).alias("pos"))
    return at_positions(tree, frames, drawn)
