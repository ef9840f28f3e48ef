import itertools
import random

import pytest

from grove.operators import counting, positions, reduce, spread
from grove.plans.joins import STRATEGIES, OutputTooLarge, tree_join
from grove.plans.tree import SHAPES, InvalidTree, JoinTree, edge_tree
from grove.sources.readers import frame, sample_tables

BAG4 = ([[(1, 10), (1, 11), (2, 20)], [(1, 100), (1, 101), (2, 200)], [(1, 300), (2, 400), (2, 401)], [(100, 1000), (100, 1001), (101, 1010), (200, 2000)]], JoinTree.of([-1, 0, 0, 1], [-1, 0, 0, 1], [-1, 0, 0, 0]))
TREE6 = (
    [[(1, 10, 100), (2, 20, 200)], [(7, 1), (8, 1), (9, 2)], [(10, 5), (20, 6)], [(100, 3), (200, 4)], [(100, 11), (200, 12)], [(3, 21), (4, 22)]],
    JoinTree.of([-1, 0, 0, 0, 3, 3], [-1, 0, 1, 2, 0, 1], [-1, 1, 0, 0, 0, 0]),
)
BALANCED7 = (
    [[(10, 20, 100), (11, 21, 101)], [(10, 30, 40, 110), (11, 31, 41, 111)], [(20, 50, 60, 120), (21, 51, 61, 121)], [(30, 130), (31, 131)], [(40, 140), (41, 141)], [(50, 150), (51, 151)], [(60, 160), (61, 161)]],
    SHAPES["balanced7"],
)


def brute(tables, tree):
    out = []
    for rows in itertools.product(*tables):
        if all(rows[p][int(tree.in_parent[c][0][1:])] == rows[c][int(tree.in_child[c][0][1:])] for p, c in tree.edges()):
            out.append(tuple(x for r in rows for x in r))
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def frames(spark, tables):
    return [frame(spark, t) for t in tables]


@pytest.mark.parametrize("strategy", STRATEGIES)
@pytest.mark.parametrize("tables,tree,n", [(*BAG4, 8), (*TREE6, 3), (*BALANCED7, 2)])
def test_small_trees(spark, strategy, tables, tree, n):
    got = rows(tree_join(tree, frames(spark, tables), strategy=strategy))
    assert got == brute(tables, tree) and len(got) == n


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_sample(spark, strategy):
    fs, tree = sample_tables(spark), SHAPES["sample"]
    got = rows(tree_join(tree, fs, strategy=strategy))
    assert got == brute([[tuple(r) for r in f.collect()] for f in fs], tree)
    assert len(got) == 20 == counting.count(tree, fs)


def test_sample_counts_and_contributions(spark):
    fs, tree = sample_tables(spark), SHAPES["sample"]
    delta = {tuple(r)[:3]: r["__delta"] for r in counting.with_counts(tree, fs)[0].collect()}
    assert delta == {(15, 10, 3): 6, (8, 7, 5): 0, (9, 10, 1): 2, (8, 9, 3): 12}
    got = [{tuple(r)[:-1]: r[-1] for r in df.collect()} for df in counting.contributions(tree, fs)]
    assert got[0] == delta
    assert got[2] == {(7, 15): 0, (7, 16): 0, (10, 17): 8, (9, 18): 12}
    assert got[4] == {(1, 1): 1, (3, 2): 9, (3, 3): 9, (1, 4): 1}
    assert counting.sensitivity(tree, fs) == 12


def test_random_trees_with_another_root(spark):
    rng, tree = random.Random(7), SHAPES["root2"]
    for trial in range(6):
        tables = [[(v, v, trial * 10 + i) for i in range(3) for v in [rng.randint(0, 3)]] for _ in range(4)]
        fs = frames(spark, tables)
        want = brute(tables, tree)
        for strategy in STRATEGIES:
            assert rows(tree_join(tree, fs, strategy=strategy)) == want
        assert counting.count(tree, fs) == len(want)


def test_empty_child_and_limits(spark):
    tree = JoinTree.of([-1, 0], [-1, 0], [-1, 0])
    empty = [frame(spark, [(1, 2)]), frame(spark, [], 2)]
    for strategy in STRATEGIES:
        assert rows(tree_join(tree, empty, strategy=strategy)) == []
    two = [frame(spark, [(1,)]), frame(spark, [(1,), (1,)])]
    with pytest.raises(OutputTooLarge) as e:
        tree_join(tree, two, max_output_rows=1)
    assert e.value.rows == 2


def test_null_keys_and_repeated_rows(spark):
    tree = JoinTree.of([-1, 0], [-1, 0], [-1, 0])
    fs = [frame(spark, [(None, 1), (0, 0), (0, 0)]), frame(spark, [(None, 2), (0, 0)])]
    for strategy in STRATEGIES:
        assert rows(tree_join(tree, fs, strategy=strategy)) == [(0, 0, 0, 0)] * 2


def test_counts_saturate(spark):
    tree = JoinTree.of([-1, *[0] * 4], [-1, 0, 0, 0, 0], [-1, 0, 0, 0, 0])
    fs = [frame(spark, [(1,)])] + [spark.range(100_000).selectExpr("1 AS c0")] * 4
    assert counting.count(tree, fs) == (1 << 63) - 1
    with pytest.raises(counting.CountOverflow):
        counting.count(tree, fs, "error")


def test_invalid_trees():
    for parent in ([1, 0], [-1, -1], [-1, 5], [], [-1, 1]):
        with pytest.raises(InvalidTree):
            JoinTree.of(parent, [-1 if p < 0 else 0 for p in parent], [-1 if p < 0 else 0 for p in parent])
    assert edge_tree(9, 3, 3).depth == 3 and len(edge_tree(9, 3, 3)) == 9 and edge_tree(9, 3, 3).branching <= 3
    with pytest.raises(InvalidTree):
        edge_tree(2, 3, 1)


def test_reducers(spark):
    tables, tree = BAG4
    tables = [tables[0] + [(9, 9)], *tables[1:3], tables[3] + [(7, 7)]]
    out = reduce.full_reduce(tree, frames(spark, tables))
    assert (9, 9) not in rows(out[0]) and (7, 7) not in rows(out[3]) and len(rows(out[3])) == 4


def test_positions_cover_the_join_once(spark):
    tables, tree = BAG4
    fs = frames(spark, tables)
    whole = [tuple(r) for r in positions.materialise(tree, fs).orderBy("__pos").collect()]
    assert [r[0] for r in whole] == list(range(8))
    part = [tuple(r) for r in positions.materialise(tree, fs, 3, 6).orderBy("__pos").collect()]
    assert part == whole[3:6]
    some = spark.createDataFrame([(0,), (7,), (7,), (8,)], "pos long")
    assert sorted(r["__pos"] for r in positions.at_positions(tree, fs, some).collect()) == [0, 7, 7]


@pytest.mark.parametrize("tables,tree", [BAG4, BALANCED7, (None, SHAPES["sample"])])
def test_runs_are_traced_as_single_positions_are(spark, monkeypatch, tables, tree):
    monkeypatch.setattr(positions, "RUN_BIN", 2)
    monkeypatch.setattr(spread, "BLOCK", 2)
    monkeypatch.setattr(spread, "EACH", 5)
    fs = frames(spark, tables) if tables else sample_tables(spark)
    n = counting.count(tree, fs)
    single = rows(positions.at_positions(tree, fs, spark.range(n).selectExpr("id AS pos")))
    assert [r[0] for r in single] == list(range(n))
    for low, high in ((None, None), (1, n - 1), (n // 2, n + 9)):
        assert rows(positions.materialise(tree, fs, low, high)) == single[low or 0 : n if high is None else high]


def test_runs_are_dealt_by_positions(spark):
    """Nine million positions of a star: a row for each run of positions is shuffled, and tasks are counted by positions."""
    tree = JoinTree.of([-1, 0, 0], [-1, 0, 0], [-1, 0, 0])
    many = lambda n: spark.range(n).selectExpr("id % 4 AS c0", "id AS c1")
    got = positions.materialise(tree, [many(4), many(240), many(150_000)])
    assert got.rdd.getNumPartitions() == 5
    sums = got.selectExpr("count(*)", "min(__pos)", "max(__pos)", "sum(__pos)", "sum(r1__c1 * r2__c1)").first()
    pairs = sum(sum(range(k, 240, 4)) * sum(range(k, 150_000, 4)) for k in range(4))
    assert tuple(sums) == (9_000_000, 0, 8_999_999, 8_999_999 * 4_500_000, pairs)
