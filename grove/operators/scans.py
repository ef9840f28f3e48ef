"""Scans over ordered rows: segmented sums and products, fill-down, expansion, compaction, ranks and numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from grove.functions.expressions import times
from grove.operators import spread
from grove.operators.spread import blocks_of, copies, key_counts, meet
from grove.storage import cut


def prefix_sum(df: DataFrame, value: str, segment: list[str], order: list[Column | str], out: str, exclusive: bool = False) -> DataFrame:
    """The sum of value over the rows of the segment up to this one, or before it."""
    w = Window.partitionBy(*segment).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))


def suffix_sum(df: DataFrame, value: str, segment: list[str], order: list[Column | str], out: str, exclusive: bool = False) -> DataFrame:
    """The sum of value over the rows of the segment from this one on, or after it."""
    w = Window.partitionBy(*segment).orderBy(*order).rowsBetween(1 if exclusive else 0, Window.unboundedFollowing)
    return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))


def suffix_product(df: DataFrame, value: str, segment: list[str], order: list[Column | str], out: str) -> DataFrame:
    """The product of value over the rows of the segment from this one on."""
    w = Window.partitionBy(*segment).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn(out, F.product(F.col(value)).over(w))


def segment_total(df: DataFrame, value: str, segment: list[str], out: str) -> DataFrame:
    """The segment's sum on each of its rows. Aggregates before it joins, so a large segment is no single task."""
    totals = df.groupBy(*[F.col(c).alias(f"__s{i}") for i, c in enumerate(segment)]).agg(F.sum(value).alias(out))
    on = [F.col(c).eqNullSafe(F.col(f"__s{i}")) for i, c in enumerate(segment)]
    return df.join(totals, on, "inner").select(*df.columns, out)


def global_prefix_sum(df: DataFrame, value: str, order: list[str], out: str) -> DataFrame:
    """The exclusive prefix sum over the whole table in an order, without one task that holds it.

    Rows are sorted by range into partitions and written; each partition is scanned by itself from the total before it.
    Only one number a partition reaches the driver. The order should cover all columns, so that ties are equal rows.
    """
    placed = df.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    placed = cut(placed, "ordered")
    sums = sorted((r["__part"], r["s"] or 0) for r in placed.groupBy("__part").agg(F.sum(value).alias("s")).collect())
    before, run = {}, 0
    for part, s in sums:
        before[part] = run
        run += s
    within = F.coalesce(F.sum(value).over(Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if not before:
        return placed.withColumn(out, F.lit(0).cast("long")).drop("__part", "__at")
    book = df.sparkSession.createDataFrame(list(before.items()), "`__part` int, `__before` bigint")
    return placed.withColumn(out, within).join(F.broadcast(book), "__part").withColumn(out, F.col(out) + F.col("__before")).drop("__part", "__at", "__before")


def fill_down(df: DataFrame, marked: Column, columns: list[str], segment: list[str], order: list[Column | str]) -> DataFrame:
    """Rows that are not marked take the columns of the last marked row before them in the segment, null where none is."""
    w = Window.partitionBy(*segment).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(marked, F.struct(*columns)), ignorenulls=True).over(w)
    return df.withColumn("__held", held).select(*[F.col(f"__held.{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def global_fill_down(df: DataFrame, marked: Column, held: str, order: list[str], out: str) -> DataFrame:
    """df with the column `held` of the last marked row up to this one in an order over the whole table, as `out`.

    Rows are sorted by range into partitions and written; each is scanned by itself from the last marked row before it. One
    value a partition reaches the driver. The order should cover enough columns that equal rows may be parted.
    """
    placed = df.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    placed = cut(placed.withColumn("__held", F.when(marked, F.struct(held))), "ordered")
    last = placed.where("__held IS NOT NULL").groupBy("__part").agg(F.max_by("__held", "__at").alias("h")).orderBy("__part").collect()
    parts = [r["__part"] for r in placed.select("__part").distinct().orderBy("__part").collect()]
    carried, now, book = iter(last), None, []
    ahead = next(carried, None)
    for part in parts:
        while ahead is not None and ahead["__part"] < part:
            now, ahead = ahead["h"], next(carried, None)
        book.append((part, now))
    before = df.sparkSession.createDataFrame(book, StructType([StructField("__part", IntegerType()), StructField("__carried", placed.schema["__held"].dataType)]))
    w = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    filled = placed.withColumn("__last", F.last("__held", ignorenulls=True).over(w)).join(F.broadcast(before), "__part")  # a row a partition
    return filled.withColumn(out, F.coalesce("__last", "__carried")[held]).select(*df.columns, out)


def expand(df: DataFrame, weight: str, ordinal: str | None = None, least: int = 0, even: bool = False) -> DataFrame:
    """Each row as often as its weight says (at least `least`); ordinal: a column for the number of the copy, from 0.

    even: weights are added up by an action first and the copies dealt over tasks, for a few rows of very large weights.
    """
    n = F.greatest(F.col(weight), F.lit(least)).cast("long")
    total = (df.agg(F.sum(n.cast("double")).alias("n")).first()["n"] or 0) if even else 0
    return copies(df, n, ordinal or "__copy", total).select(*df.columns, *([ordinal] if ordinal else []))


def compact(df: DataFrame, keep: Column, n: int | None = None, order: list[Column | str] = (), pad: bool = False) -> DataFrame:
    """The rows to keep; with n, the first n of them in an order; with pad, rows of nulls after them up to n, told by is_dummy."""
    out = df.where(keep)
    out = out if n is None else out.orderBy(*order).limit(n)
    return _filled(out, n) if pad and n is not None else out


def _filled(df: DataFrame, n: int, have: int | None = None) -> DataFrame:
    have = df.count() if have is None else have
    dummies = df.sparkSession.range(max(0, n - have)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema], F.lit(True).alias("is_dummy"))
    return df.withColumn("is_dummy", F.lit(False)).unionByName(dummies)


def expand_to(df: DataFrame, weight: str, size: int, order: list[Column | str], ordinal: str = "__copy") -> DataFrame:
    """Each row as often as its weight says, once at least; the first `size` copies in an order, padded to that size.

    Weights are added up before anything is copied, so a copy that would be cut is not made.
    """
    names = [f"__o{i}" for i in range(len(order))]
    keyed = df.withColumns({n: F.col(o) if isinstance(o, str) else o for n, o in zip(names, order)})
    keyed = keyed.withColumn("__w", F.greatest(F.col(weight), F.lit(1)).cast("long"))
    summed = global_prefix_sum(keyed, "__w", names, "__first").where(F.col("__first") < size)
    some = summed.withColumn("__w", F.least(F.col("__w"), F.lit(size).cast("long") - F.col("__first")))
    return _filled(expand(some, "__w", ordinal).select(*df.columns, ordinal), size)


def zip_join(left: DataFrame, right: DataFrame, on: str, to: str, order: tuple[list[str], list[str]], size: int | None = None) -> DataFrame:
    """The inner join of two sides with distinct column names by expansion and alignment, without matching all with all.

    Keys carry how many rows both sides have of them. Each side's rows of a key are ranked and cut into blocks; a left block is
    copied once for each right block, a right block once for each left one, and both copies get the place in their key at
    which they meet: one equal place for each pair of blocks. The zip is an equi-join on key and place, so a hot key is as many
    join keys as it has pairs of blocks, and only blocks are copied, not pairs. size: the result is cut or padded to so many
    rows, in the order of key, left rank and right rank; pairs of the keys are added up first, and rows beyond are not matched.
    """
    a1, a2 = F.col("__a1"), F.col("__a2")
    keys = key_counts(left, right, [on], [to])
    have = None
    if size is not None:
        keys = global_prefix_sum(keys.withColumn("__pairs", times(a1, a2)), "__pairs", ["__k0"], "__first").where(F.col("__first") < size)
        keys = keys.withColumn("__room", F.least(F.col("__pairs"), F.lit(size).cast("long") - F.col("__first"))).drop("__pairs", "__first")
        have = keys.agg(F.sum("__room").alias("n")).first()["n"] or 0
        # only so many left rows, and right ones, are in the room that the key has
        keys = keys.withColumns({"__width": a2, "__a1": F.expr("(__room + __a2 - 1) div __a2"), "__a2": F.least("__a2", "__room")})
    pairs = keys.agg(F.sum(a1.cast("double") * a2).alias("n")).first()["n"] or 0
    keys = keys.withColumns({"__g1": blocks_of(a1), "__g2": blocks_of(a2)})

    def side(df: DataFrame, key: str, by: list[str], rows: str, rank: str, more: list[str]) -> DataFrame:
        ranked = df.withColumn(rank, (F.row_number().over(Window.partitionBy(key).orderBy(*by)) - 1).cast("long"))
        ranked = ranked.join(keys.select("__k0", rows, "__g1", "__g2", *more), F.col(key) == F.col("__k0")).where(F.col(rank) < F.col(rows))
        return ranked.withColumn("__mine", F.expr(f"{rank} div {spread.BLOCK}")).drop("__k0", rows)

    a = side(left, on, order[0], "__a1", "__c1", [] if size is None else ["__room", "__width"])
    b = side(right, to, order[1], "__a2", "__c2", [])
    only = None if size is None else F.col("__c1") * F.col("__width") + F.col("__c2") < F.col("__room")
    met = meet(a, b, [on], [to], pairs, only).select(*left.columns, *right.columns)
    return met if size is None else _filled(met, size, have)


def child_rank(df: DataFrame, key: list[str], delta: str, order: list[Column | str], out: str = "rank") -> DataFrame:
    """The first ordinal that each row owns among its key's copies."""
    return prefix_sum(df, delta, key, order, out, exclusive=True)


def multi_number(df: DataFrame, out: str, modulo: Column | None = None) -> DataFrame:
    """Numbers identical rows from 1, around again after `modulo` if given."""
    w = Window.partitionBy(*df.columns).orderBy(F.lit(1))
    n = F.row_number().over(w)
    return df.withColumn(out, n if modulo is None else (n - 1) % modulo + 1)


def align_ordinal(df: DataFrame, key: list[str], order: list[Column | str], a1: str, a2: str, out: str = "q") -> DataFrame:
    """Where a row of the second side goes so that the two expanded sides of a join can be zipped."""
    c = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1
    return df.withColumn("__c", c).withColumn(out, F.expr(f"__c div {a1}") + F.col("__c") % F.col(a1) * F.col(a2)).drop("__c")


def top_per_group(df: DataFrame, k: int, group: list[str], order: list[Column | str]) -> DataFrame:
    """The first k rows of each group."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("__n", n).where(F.col("__n") <= k).drop("__n")


def interval_join(left: DataFrame, right: DataFrame, key: tuple[str, str], at: str, there: str, width: int) -> DataFrame:
    """Pairs of one key whose right place is in [left place, left place + width), places being integers.

    Places are cut into bins of that width and a left row is entered in the two bins that its interval may reach into, so a
    key's rows meet bin by bin and not all with all.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(width))
    entered = left.withColumn("__cell", F.explode(F.array(cell(at), cell(at) + 1)))
    binned = right.withColumn("__bin", cell(there))
    on = (F.col(key[0]) == F.col(key[1])) & (F.col("__cell") == F.col("__bin"))
    met = entered.join(binned, on & (F.col(there) >= F.col(at)) & (F.col(there) < F.col(at) + width))
    return met.drop("__cell", "__bin")


def composite_ids(left: DataFrame, right: DataFrame, on: list[str], to: list[str], out: str) -> tuple[DataFrame, DataFrame]:
    """One dense id, from 1, for each combination of key columns that either side has."""
    names = [f"__p{i}" for i in range(len(on))]
    pairs = left.select(*[F.col(c).alias(n) for c, n in zip(on, names)]).union(right.select(*to)).distinct()
    ids = global_prefix_sum(pairs.withColumn("__one", F.lit(1)), "__one", names, out).withColumn(out, (F.col(out) + 1).cast("long")).drop("__one")

    def give(df: DataFrame, keys: list[str]) -> DataFrame:
        return df.join(ids, [df[c].eqNullSafe(ids[n]) for c, n in zip(keys, names)]).drop(*names)

    return give(left, on), give(right, to)


def radix_state(position: Column, totals: list[Column]) -> list[Column]:
    """The digit of each child: which of its subtree's join rows an output position stands for."""
    return [F.call_function("div", position, times(*totals[i + 1 :])) % t for i, t in enumerate(totals)]
