import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from grove.functions.expressions import MOST, hash_sample, times
from grove.operators import graph, padding, positions, scans, spread
from grove.operators.sensitivity import Bounds, Lattice, beta, evaluations, largest_k, residual, smooth_sensitivity
from grove.plans.joins import tree_join
from grove.plans.tree import SHAPES, JoinTree
from grove.sources import readers, writers

STAR = JoinTree.of([-1, 0, 0], [-1, 0, 0], [-1, 0, 0])


def frames(spark):
    one = [(1,), (1,), (2,)]
    return [readers.frame(spark, x) for x in (one, [(1,), (2,), (2,)], [(1,), (1,)])]


@pytest.mark.parametrize("eps,f,b,k", [(1, 332.26606322753935, 0.02281395224668429, [225, 269, 314, 359]), (4, 97.05894476061107, 0.08541017783145433, [64, 77, 89, 102]), (8, 56.152998027747486, 0.15737861976215423, [37, 45, 52, 59])])
def test_padding_formulae(eps, f, b, k):
    assert math.isclose(padding.factor(eps, 1e-9), f, rel_tol=1e-9)
    assert math.isclose(beta(eps, 1e-9), b, rel_tol=1e-9)
    assert [largest_k(m, b) for m in (6, 7, 8, 9)] == k


def test_evaluations():
    assert math.isclose(evaluations(225, 6), 2.278e7, rel_tol=1e-3)
    assert math.isclose(evaluations(45, 7), 2.392e6, rel_tol=1e-3)


def test_padding(spark):
    fs = frames(spark)
    got = padding.padded_join(STAR, fs, rows=10)
    assert got.count() == 10 and got.where("is_dummy").count() == 6
    assert got.where("is_dummy").first()["r0__c0"] == padding.DUMMY
    with pytest.raises(padding.PaddingTooLarge):
        padding.pad(got, 11, most=10)
    s = padding.padding_stats(STAR, fs, epsilon=4.0)
    assert s.exact == 4 and s.source == "smooth" and s.target == 4 + math.ceil(s.factor * s.sensitivity)
    assert padding.padding_stats(STAR, fs, rows=2).target == 4
    assert padding.size_holds(5, 5) and padding.size_holds(6, 5, True) and not padding.size_holds(6, 5) and padding.size_holds(0, -1)


def test_padding_of_a_large_result(spark):
    """A result above the bound on protected sizes is padded all the same; only a bound that is given refuses."""
    got = padding.pad(spark.range(padding.MAX_PROTECTED_ROWS), padding.MAX_PROTECTED_ROWS + 500, have=padding.MAX_PROTECTED_ROWS)
    assert got.groupBy("is_dummy").count().orderBy("is_dummy").collect() == [(False, padding.MAX_PROTECTED_ROWS), (True, 500)]


def test_padding_beyond_an_int(spark):
    two = JoinTree.of([-1, 0], [-1, 0], [-1, 0])
    many = spark.range(70_000).select(F.lit(1).alias("c0"))
    s = padding.padding_stats(two, [many, many], smooth=False)
    assert s.exact == 4_900_000_000 and s.padding == math.ceil(s.factor * 70_000) and s.target == s.exact + s.padding
    with pytest.raises(padding.PaddingTooLarge):
        padding.padded_join(two, [many, many])


def test_residual_against_enumeration():
    bounds = {frozenset(x): v for x, v in (((), 1), ((0,), 3), ((1,), 2), ((2,), 5), ((0, 1), 4), ((0, 2), 9), ((1, 2), 7))}
    b = 0.3
    most = largest_k(3, b)
    best = 0.0
    for out in range(3):
        p, q = [j for j in range(3) if j != out]
        for x in range(most + 1):
            for y in range(most + 1 - x):
                v = x * y + bounds[frozenset([q])] * x + bounds[frozenset([p])] * y + bounds[frozenset([p, q])]
                best = max(best, math.exp(-b * (x + y)) * v)
    assert residual(bounds, 3, b) == math.ceil(best)


def test_smooth_sensitivity_bounds(spark):
    fs = frames(spark)
    s = smooth_sensitivity(STAR, fs, 8.0)
    assert s.status == "ok" and 4 <= s.value <= s.ceiling == 9
    assert smooth_sensitivity(SHAPES["tpcds_q85"], [None] * 8, 1.0).status == "tooExpensive"


def test_bounds_against_joined_rows(spark):
    """Counts are the largest number of joined rows that agree on the boundary; degrees are never below them."""
    rng = np.random.default_rng(3)
    tables = [[tuple(int(x) for x in rng.integers(0, 3, 2)) for _ in range(7)] for _ in range(3)]
    chain = JoinTree.of([-1, 0, 1], [-1, "x0", "y1"], [-1, "x1", "x2"])
    at = Bounds(chain, [spark.createDataFrame(rows, f"x{i} int, y{i} int") for i, rows in enumerate(tables)])
    joins = {(0, 1): lambda a, b: a[0] == b[0], (1, 2): lambda a, b: a[1] == b[0]}
    for chosen in ((0,), (1,), (2,), (0, 1), (1, 2), (0, 2)):
        rows = [r for r in itertools.product(*[tables[i] for i in chosen]) if all(f(*(r[chosen.index(i)] for i in pair)) for pair, f in joins.items() if set(pair) <= set(chosen))]
        sides = {0: ((0, 1), lambda r: r[0]), 1: ((1, 0), lambda r: r[0]), 2: ((1, 2), lambda r: r[1]), 3: ((2, 1), lambda r: r[0])}
        edge = [(i, f) for (i, other), f in sides.values() if i in chosen and other not in chosen]
        most = max(Counter(tuple(f(r[chosen.index(i)]) for i, f in edge) for r in rows).values(), default=0)
        inside = frozenset(chosen)
        counts = at.by_counts(inside, at.boundary(inside))
        assert counts in (most, None) and at.by_degrees(inside, at.boundary(inside)) >= most
    tight = Lattice(at)
    assert all(tight.tightest(e).size <= n for e, n in tight.degrees().items())


def test_scans(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 2, 0), ("a", 3, 70_000), ("b", 1, None)], "k string, o int, w int")
    out = scans.expand(df, "w", "i")
    assert out.count() == 70_002 and out.where("o = 3").agg(F.countDistinct("i"), F.max("i")).first()[:] == (70_000, 69_999)
    assert scans.expand(df, "w", least=1).where("k = 'b' OR o = 2").count() == 2
    assert scans.global_prefix_sum(df.limit(0), "w", ["k"], "s").count() == 0
    numbered = scans.multi_number(spark.createDataFrame([(1,), (1,), (1,)], "a int"), "n", F.lit(2))
    assert sorted(r["n"] for r in numbered.collect()) == [1, 1, 2]


def test_expand_deals_copies(spark):
    """One row of nine million copies is several tasks of about as many copies each."""
    out = scans.expand(spark.createDataFrame([("a", 9_000_000), ("b", 1), ("c", None)], "k string, w int"), "w", "i", even=True)
    assert out.groupBy("k").agg(F.count("i").alias("n"), F.max("i"), F.sum("i")).orderBy("k").collect() == [("a", 9_000_000, 8_999_999, 40_499_995_500_000), ("b", 1, 0, 0)]
    tasks = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) == 5 and max(tasks) < 3_000_000


def test_global_fill_down(spark):
    rows = [(i, i * i if i % 7 == 3 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "o int, v int").repartition(6)
    got = {r["o"]: r["last"] for r in scans.global_fill_down(df, F.col("v").isNotNull(), "v", ["o"], "last").collect()}
    assert got == {i: next((j * j for j in range(i, -1, -1) if j % 7 == 3), None) for i in range(200)}
    assert scans.global_fill_down(df.limit(0), F.col("v").isNotNull(), "v", ["o"], "last").count() == 0


def test_sized_results(spark):
    df = spark.createDataFrame([(1, 2), (2, 0), (3, 5)], "o int, w int")
    copies = lambda n: sorted((r["o"], r["k"], r["is_dummy"]) for r in scans.expand_to(df, "w", n, ["o"], "k").where("NOT is_dummy").collect())
    assert copies(5) == [(1, 0, False), (1, 1, False), (2, 0, False), (3, 0, False), (3, 1, False)]
    assert scans.expand_to(df, "w", 20, ["o"]).where("is_dummy").count() == 12
    assert [scans.compact(df, F.col("w") > 0, n, ["o"], pad=True).count() for n in (1, 2, 9)] == [1, 2, 9]
    left, right = spark.createDataFrame([(k % 3 or None, k) for k in range(40)], "k int, a int"), spark.createDataFrame([(1, 7), (1, 7), (2, 9), (None, 1), (5, 5)], "q int, b int")
    want = sorted((k % 3, k, q, b) for k in range(40) for q, b in ((1, 7), (1, 7), (2, 9)) if k % 3 == q)
    assert sorted(map(tuple, scans.zip_join(left, right, "k", "q", (["a"], ["b"])).collect())) == want
    assert scans.zip_join(left, right, "k", "q", (["a"], ["b"]), 100).where("is_dummy").count() == 100 - len(want)


def test_zip_join_of_blocks(spark, monkeypatch):
    """Blocks of two rows and tasks of five: each pair once, in the order of key and ranks where the result is cut."""
    monkeypatch.setattr(spread, "BLOCK", 2)
    monkeypatch.setattr(spread, "EACH", 5)
    a, b = [(k % 3 or None, k) for k in range(31)], [(k % 4 or None, 100 + k) for k in range(27)]
    left, right = spark.createDataFrame(a, "k int, a int"), spark.createDataFrame(b, "q int, b int")
    want = sorted((k, x, q, y) for k, x in a for q, y in b if k is not None and k == q)
    assert sorted(map(tuple, scans.zip_join(left, right, "k", "q", (["a"], ["b"])).collect())) == want
    for size in (0, 1, 6, 7, 8, 75, len(want), len(want) + 3):
        got = scans.zip_join(left, right, "k", "q", (["a"], ["b"]), size)
        assert sorted(tuple(r)[:4] for r in got.where("NOT is_dummy").collect()) == want[:size] and got.count() == size


def test_zip_join_is_dealt_by_pairs(spark):
    """Ten million pairs of two keys are tasks of two million; of ten billion pairs only those of the cut are made."""
    sides = lambda n, m: (spark.range(n).selectExpr("id % 2 AS k", "id AS a"), spark.range(m).selectExpr("id % 2 AS q", "id AS b"))
    got = scans.zip_join(*sides(4000, 5000), "k", "q", (["a"], ["b"]))
    assert got.count() == 10_000_000 and got.rdd.getNumPartitions() == 5
    cut = scans.zip_join(*sides(200_000, 100_000), "k", "q", (["a"], ["b"]), 60_000)
    assert cut.where("NOT is_dummy").groupBy("a").agg(F.count("b").alias("n"), F.max("b").alias("m")).orderBy("a").collect() == [(0, 50_000, 99_998), (2, 10_000, 19_998)]


def test_spread_join(spark, monkeypatch):
    """Blocks of two rows and tasks of five, for keys with many rows on both sides, on one, equal rows and nulls."""
    monkeypatch.setattr(spread, "BLOCK", 2)
    monkeypatch.setattr(spread, "EACH", 5)
    a, b = [(k % 3 or None, k % 9) for k in range(60)] + [(7, 1), (8, 1)], [(k % 4 or None, 100 + k) for k in range(50)] + [(7, k) for k in range(9)]
    left, right = spark.createDataFrame(a, "k int, a int"), spark.createDataFrame(b, "q int, b int")
    for only, holds in ((None, lambda x, y: True), (F.col("a") * 13 < F.col("b"), lambda x, y: x * 13 < y)):
        want = sorted((k, x, q, y) for k, x in a for q, y in b if k is not None and k == q and holds(x, y))
        got = spread.spread_join(left, right, ["k"], ["q"], only)
        assert sorted(map(tuple, got.collect())) == want and set(got.columns) == {"k", "a", "q", "b"}


def test_spread_star_is_dealt_by_rows(spark):
    """Nine million rows of a star are tasks of about two million."""
    many = lambda n: spark.range(n).selectExpr("id % 4 AS c0", "id AS c1")
    got = tree_join(STAR, [many(4), many(240), many(150_000)], strategy="spread")
    assert got.count() == 9_000_000 and got.rdd.getNumPartitions() == 5


def test_interval_join(spark):
    a, b = [(k % 2, k * 7 % 50 - 25) for k in range(40)] + [(None, 1)], [(k % 3, k * 11 % 60 - 30) for k in range(40)] + [(None, 1)]
    left, right = spark.createDataFrame(a, "k int, x int"), spark.createDataFrame(b, "q int, y int")
    for width in (1, 4, 100):
        want = sorted((k, x, q, y) for k, x in a for q, y in b if k is not None and k == q and x <= y < x + width)
        assert sorted(map(tuple, scans.interval_join(left, right, ("k", "q"), "x", "y", width).collect())) == want


def test_positions_of_a_skewed_root(spark):
    """One root row owns nearly all positions: the others' are found, and asked positions that repeat all get their row."""
    tree = JoinTree.of([-1, 0], [-1, 0], [-1, 0])
    root = spark.range(500).select((F.col("id") + 1).cast("int").alias("c0"))
    child = spark.range(3000).select(F.when(F.col("id") < 500, F.col("id") + 1).otherwise(250).cast("int").alias("c0"))
    asked = spark.createDataFrame([(p,) for p in [0, 5, 248, 249, 250, 2748, 2749, 2750, 2750, 2999, 3000, -1, 10**12]], "pos long")
    got = sorted((r["__pos"], r["r0__c0"]) for r in positions.at_positions(tree, [root, child], asked).collect())
    assert got == [(0, 1), (5, 6), (248, 249), (249, 250), (250, 250), (2748, 250), (2749, 250), (2750, 251), (2750, 251), (2999, 500)]


def test_expressions(spark):
    row = spark.range(1).select(times(F.lit(1 << 40), F.lit(1 << 40)).alias("a"), times(F.lit(3).cast("long"), F.lit(4).cast("long")).alias("b")).first()
    assert (row["a"], row["b"]) == (MOST, 12)
    ids = spark.range(1000).select("id")
    small, large = ({r["id"] for r in ids.where(hash_sample(F.col("id"), p)).collect()} for p in (20, 40))
    assert small < large and 100 < len(small) < 300


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1), (7, 7)], "source long, target long")
    found = {r["node"]: r["component"] for r in graph.strong_components(e).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7}
    assert sorted(map(tuple, graph.sink_component(e).collect())) == [(4, 5), (5, 4)]
    order = spark.createDataFrame([(a, b) for a in range(30) for b in range(a + 1, 30)] + [(40, 41), (41, 40), (29, 40)], "source long, target long")
    assert {r["node"]: r["component"] for r in graph.strong_components(order, rounds=12).collect()} == {n: n for n in range(30)} | {40: 40, 41: 40}
    with pytest.raises(RuntimeError):
        graph.strong_components(spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 1)], "source long, target long"), rounds=1)
    k = spark.createDataFrame([(1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2), (4, 1), (4, 2), (1, 4), (5, 1)], "source long, target long")
    core = sorted(map(tuple, graph.kout_core(k, 2).collect()))
    assert (5, 1) not in core and (4, 1) in core and len(core) == 9
    assert graph.key_shape(spark.createDataFrame([(1,), (1,), (1,), (2,)], "k int"), "k").first()[:] == (2, 3, 0.25)
    assert graph.key_shape(e.limit(0), "source").first()["n_keys"] == 0


def test_tree_workload_round_trip(spark, tmp_path):
    fs, tree = readers.sample_tables(spark), SHAPES["sample"]
    writers.write_tree_workload(tree, fs, 20, f"file://{tmp_path}/w")
    again, tables, expected = readers.tree_workload(spark, f"file://{tmp_path}/w")
    assert again == tree and expected == 20 == tree_join(again, tables).count()


@pytest.mark.parametrize("lines", [["0 -1 -1 -1 2", "2 0 0 0 2"], ["0 -1 -1 -1 2", "1 -1 -1 -1 2"], ["0 -1 0 -1 2"], ["0 -1 -1 -1 2", "1 0 5 0 2"]])
def test_bad_tree_files(spark, tmp_path, lines):
    (tmp_path / "tree.txt").write_text("\n".join(lines))
    with pytest.raises(readers.BadInput):
        readers.tree_file(spark, f"file://{tmp_path}/tree.txt")


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 2\n\n3 4 x 5\n  6\t7\n")
    assert sorted(map(tuple, readers.ints(spark, f"file://{tmp_path}/a.txt", 2).collect())) == [(1, 2), (3, 4), (6, 7)]
    with pytest.raises(readers.BadInput):
        readers.required(spark, f"file://{tmp_path}/a.txt", 2)
    (tmp_path / "b.tbl").write_text("1|x||\n2||3|\n")
    assert [tuple(r) for r in readers.bar_separated(spark, f"file://{tmp_path}/b.tbl", "a int, b string, c int", "").collect()] == [(1, "x", None), (2, None, 3)]
    (tmp_path / "c.csv").write_text('1,"a\\"b,c"\n')
    assert tuple(readers.escaped_csv(spark, f"file://{tmp_path}/c.csv", "a int, b string").first()) == (1, 'a"b,c')
    (tmp_path / "e.txt").write_text("# comment\n1\t2\n3 4 9\n")
    assert sorted(map(tuple, readers.edge_list(spark, f"file://{tmp_path}/e.txt").collect())) == [(1, 2), (3, 4)]
    assert readers.expected_rows(spark, f"file://{tmp_path}/none.txt") == -1
    df = spark.createDataFrame([(1, "a"), (2, ""), (3, None)], "a int, b string")
    assert readers.cleaned(df).count() == 1
    writers.write_ints(df.select("a"), f"file://{tmp_path}/out", ["a", "a"])
    assert readers.ints(spark, f"file://{tmp_path}/out").count() == 3
    writers.discard(df)
    assert writers.count_only(df) == (3, 2) and len(writers.head(df, 2)) == 2


def test_answer_and_encryption(spark, tmp_path):
    from grove.functions.encryption import decrypted, encrypted
    from grove.operators.changes import deleted, updated

    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    writers.answer(df, f"file://{tmp_path}/answer")
    assert sorted(r["value"] for r in spark.read.text(f"file://{tmp_path}/answer").collect()) == ["1|a", "2|", "k|v"]
    sealed = encrypted(df, ["k", "v"], b"x" * 16)
    assert dict(sealed.dtypes) == {"k": "binary", "v": "binary"}
    assert sorted(map(tuple, decrypted(sealed, {"k": "int", "v": "string"}, b"x" * 16).collect())) == [(1, "a"), (2, None)]
    keys = spark.createDataFrame([(1,), (None,)], "k int")
    assert [r["k"] for r in deleted(df, keys, ["k"]).collect()] == [2]
    assert sorted(map(tuple, updated(df, spark.createDataFrame([(2, "z")], "k int, v string"), ["k"], ["v"]).collect())) == [(1, "a"), (2, "z")]
