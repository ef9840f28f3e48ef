"""Writers of the workloads' file formats, and result sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.plans.tree import JoinTree


def write_ints(df: DataFrame, path: str, columns: list[str] | None = None, limit: int | None = None) -> None:
    """Columns (repeated ones too) between blanks; limit: the first rows only."""
    out = df if limit is None else df.limit(limit)
    out.select(F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in columns or df.columns]).alias("value")).write.text(path)


def write_tree_workload(tree: JoinTree, frames: list[DataFrame], expected: int, folder: str) -> None:
    """tree.txt, tables.tbl and expected.txt, each a folder of text parts."""
    spark = frames[0].sparkSession
    at = lambda i, names: frames[i].columns.index(names[0]) if names else -1
    lines = [f"{i} {p} {at(p, tree.in_parent[i]) if p >= 0 else -1} {at(i, tree.in_child[i])} {len(frames[i].columns)}" for i, p in enumerate(tree.parent)]
    one = lambda rows, name: spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.text(f"{folder}/{name}")
    one(lines, "tree.txt")
    one([str(expected)], "expected.txt")
    packed = [df.select(F.concat_ws(" ", F.lit(str(i)), *[F.col(f"`{c}`").cast("string") for c in df.columns]).alias("value")) for i, df in enumerate(frames)]
    reduce(DataFrame.union, packed).write.text(f"{folder}/tables.tbl")


def write_stats(values: dict, spark, path: str) -> None:
    """key=value lines."""
    spark.createDataFrame([(f"{k}={v}",) for k, v in values.items()], "value string").coalesce(1).write.text(path)


def write_suite(cases: DataFrame, path: str) -> None:
    """One line a case under a header."""
    cases.coalesce(1).write.option("header", True).csv(path)


def load_table(df: DataFrame, name: str) -> None:
    """Bulk load into a table of the catalog."""
    df.write.mode("append").saveAsTable(name)


def count_only(df: DataFrame) -> tuple[int, int]:
    """Rows and columns of a result that is not kept."""
    return df.count(), len(df.columns)


def discard(df: DataFrame) -> None:
    """Runs a plan to its end and keeps nothing."""
    df.write.format("noop").mode("overwrite").save()


def head(df: DataFrame, n: int = 20) -> list[tuple]:
    """The first rows of a result, for printing."""
    return [tuple(r) for r in df.limit(n).collect()]


def answer(df: DataFrame, path: str) -> None:
    """A query's answer as one text: the column names, then a line a row, fields between bars."""
    spark = df.sparkSession
    head = spark.createDataFrame([("|".join(df.columns),)], "value string").withColumn("__n", F.lit(0))
    fields = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
    body = df.select(F.concat_ws("|", *fields).alias("value"), F.lit(1).alias("__n"))
    head.unionByName(body).coalesce(1).sortWithinPartitions("__n").select("value").write.text(path)
