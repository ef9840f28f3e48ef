"""Join trees: which relation joins which parent on which columns."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame


class InvalidTree(ValueError):
    """The arrays do not describe one tree over the relations given."""


Columns = tuple[str, ...]


@dataclass(frozen=True)
class JoinTree:
    """parent[i] of each relation (-1 for the root), and the columns of the edge on both of its sides."""

    parent: tuple[int, ...]
    in_parent: tuple[Columns, ...]
    in_child: tuple[Columns, ...]

    @classmethod
    def of(cls, parent: list[int], in_parent: list, in_child: list) -> JoinTree:
        """From arrays. A join column is a name, a tuple of names, or a position p, which stands for the name c<p>."""

        def names(x) -> Columns:
            if x is None or x == -1:
                return ()
            if isinstance(x, int):
                return (f"c{x}",)
            return (x,) if isinstance(x, str) else tuple(names(y)[0] for y in x)

        tree = cls(tuple(parent), tuple(map(names, in_parent)), tuple(map(names, in_child)))
        tree.validate()
        return tree

    def __len__(self) -> int:
        return len(self.parent)

    @property
    def root(self) -> int:
        return self.parent.index(-1)

    def children(self, i: int) -> list[int]:
        return [c for c, p in enumerate(self.parent) if p == i]

    def bfs(self) -> list[int]:
        out, queue = [], deque([self.root])
        while queue:
            out.append(queue.popleft())
            queue.extend(self.children(out[-1]))
        return out

    def edges(self) -> list[tuple[int, int]]:
        """(parent, child) from the root down."""
        return [(self.parent[c], c) for c in self.bfs() if c != self.root]

    def depth_of(self, i: int) -> int:
        return 0 if self.parent[i] < 0 else 1 + self.depth_of(self.parent[i])

    @property
    def depth(self) -> int:
        return max(map(self.depth_of, range(len(self))))

    @property
    def branching(self) -> int:
        return max(len(self.children(i)) for i in range(len(self)))

    def validate(self, frames: list[DataFrame] | None = None) -> None:
        """Raises InvalidTree unless there is one root, all are reached from it, and all columns exist."""
        n = len(self.parent)
        if not n or len(self.in_parent) != n or len(self.in_child) != n:
            raise InvalidTree("the arrays need one entry for each relation")
        if self.parent.count(-1) != 1:
            raise InvalidTree("there must be exactly one root")
        for i, p in enumerate(self.parent):
            if p == -1:
                if self.in_parent[i] or self.in_child[i]:
                    raise InvalidTree("the root has no join columns")
            elif not 0 <= p < n or p == i:
                raise InvalidTree(f"relation {i} has parent {p}")
            elif not self.in_parent[i] or len(self.in_parent[i]) != len(self.in_child[i]):
                raise InvalidTree(f"relation {i} needs as many join columns on either side, at least one")
        if len(self.bfs()) != n:
            raise InvalidTree("not all relations are reached from the root")
        if frames is not None:
            if len(frames) != n:
                raise InvalidTree(f"{n} relations are needed, {len(frames)} were given")
            for p, c in self.edges():
                if missing := {*self.in_parent[c]} - {*frames[p].columns} | {*self.in_child[c]} - {*frames[c].columns}:
                    raise InvalidTree(f"edge {p}-{c} names columns that are not there: {sorted(missing)}")


def _tree(parent: list[int], in_parent: list[int], in_child: list[int] | None = None) -> JoinTree:
    return JoinTree.of(parent, in_parent, in_child or [-1 if p < 0 else 0 for p in parent])


#: The query shapes of the published workloads, as arrays by relation number.
SHAPES = {
    "sample": _tree([-1, 0, 0, 0, 3, 3], [-1, 0, 1, 2, 0, 1], [-1, 1, 0, 0, 0, 0]),
    "tpcds_q18": _tree([-1, 0, 0, 0, 0, 4, 4], [-1, 0, 1, 2, 3, 1, 2]),
    "tpcds_q85": _tree([-1, 0, 0, 0, 3, 3, 3, 3], [-1, 0, 1, 2, 1, 2, 3, 4]),
    "tpcds_q85_chain3": _tree([-1, 0, 1], [-1, 0, 1]),
    "tpcds_q85_returns_star": _tree([-1, 0, 0, 0, 0], [-1, 0, 1, 2, 3]),
    "tpch_q9": _tree([-1, 0, 0, 2, 2, 4], [-1, 0, 1, 1, 2, 1]),
    "job_1a": _tree([-1, 0, 0, 0, 3], [-1, 0, 1, 1, 1]),
    "job_13d": _tree([-1, 0, 0, 2, 2, 0, 5, 0, 7], [-1, 1, 0, 1, 2, 0, 1, 0, 1]),
    "balanced7": _tree([-1, 0, 0, 1, 1, 2, 2], [-1, 0, 1, 1, 2, 1, 2]),
    "root2": _tree([2, 0, -1, 2], [1, 0, -1, 0], [0, 1, -1, 1]),
}


def edge_tree(relations: int, depth: int, branching: int) -> JoinTree:
    """A tree over aliases of an edge table (source, target): one path as deep as asked, the rest filled breadth first."""
    if relations < depth + 1 or depth < 0 or branching < 1:
        raise InvalidTree("a tree of that depth needs more relations")
    parent, level = [-1], [0]
    for d in range(depth):
        parent.append(len(parent) - 1 if d else 0)
        level.append(d + 1)
    while len(parent) < relations:
        room = [i for i in range(len(parent)) if level[i] < depth and parent.count(i) < branching]
        if not room:
            raise InvalidTree("no tree of that depth and branching has so many relations")
        at = min(room, key=lambda i: (level[i], i))
        parent.append(at)
        level.append(level[at] + 1)
    return JoinTree.of(parent, [-1 if p < 0 else "target" for p in parent], [-1 if p < 0 else "source" for p in parent])
