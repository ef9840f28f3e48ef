"""Tree joins: a set of relations and a join tree lowered to one lazy plan.

Strategies give the same rows (a multiset, in no order):

direct      inner joins from the root down; Catalyst reorders and AQE picks the physical joins. The default.
reduced     a full reducer first, so that no intermediate result holds a row that dies later.
binary      two-way joins from the leaves up, each subtree joined before it meets its parent.
spread      as direct, but each edge's keys are counted first, and where a join gives far more rows than it reads, its rows are
            met block by block in tasks that give about as many rows each (grove.operators.spread). For many-to-many trees.
positional  counts first, then every output position is traced to one row of each relation (grove.operators.positions).

Key 0, all-zero rows and repeated rows are ordinary; null keys match nothing; an empty join has no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.operators.counting import count
from grove.operators.reduce import full_reduce
from grove.operators.spread import spread_join
from grove.plans.tree import JoinTree

STRATEGIES = ("direct", "reduced", "binary", "spread", "positional")


class OutputTooLarge(ValueError):
    """The join has more rows than were allowed; rows holds how many."""

    def __init__(self, rows: int, most: int) -> None:
        super().__init__(f"the join has {rows} rows, more than the {most} allowed")
        self.rows = rows


def renamed(tree: JoinTree, frames: list[DataFrame]) -> list[DataFrame]:
    """Columns as r<relation>__<name>: aliases of one table don't clash."""
    return [df.select(*[F.col(f"`{c}`").alias(f"r{i}__{c}") for c in df.columns]) for i, df in enumerate(frames)]


def _on(tree: JoinTree, left: DataFrame, p: int, right: DataFrame, c: int):
    out = None
    for a, b in zip(tree.in_parent[c], tree.in_child[c]):
        each = left[f"r{p}__{a}"] == right[f"r{c}__{b}"]
        out = each if out is None else out & each
    return out


def output_columns(tree: JoinTree, frames: list[DataFrame], keep: list[list[str]] | None = None, order: str = "id") -> list[str]:
    """r<i>__<name> of the payload columns, by relation number or in breadth-first order from the root."""
    ids = range(len(tree)) if order == "id" else tree.bfs()
    return [f"r{i}__{c}" for i in ids for c in (keep[i] if keep else frames[i].columns)]


def tree_join(tree: JoinTree, frames: list[DataFrame], keep: list[list[str]] | None = None, strategy: str = "direct", order: str = "id", max_output_rows: int | None = None) -> DataFrame:
    """The natural join along the tree's edges; keep: the payload columns of each relation, all by default."""
    tree.validate(frames)
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {STRATEGIES}")
    if max_output_rows is not None and (n := count(tree, frames)) > max_output_rows:
        raise OutputTooLarge(n, max_output_rows)
    columns = output_columns(tree, frames, keep, order)
    if strategy == "positional":
        from grove.operators.positions import materialise

        return materialise(tree, frames).select(*columns)
    parts = renamed(tree, full_reduce(tree, frames) if strategy == "reduced" else frames)
    if strategy == "binary":
        for p, c in reversed(tree.edges()):
            parts[p] = parts[p].join(parts[c], _on(tree, parts[p], p, parts[c], c), "inner")
        return parts[tree.root].select(*columns)
    out = parts[tree.root]
    if strategy == "spread":
        for p, c in tree.edges():
            out = spread_join(out, parts[c], [f"r{p}__{a}" for a in tree.in_parent[c]], [f"r{c}__{b}" for b in tree.in_child[c]])
        return out.select(*columns)
    for p, c in tree.edges():
        out = out.join(parts[c], _on(tree, out, p, parts[c], c), "inner")
    return out.select(*columns)
