"""Readers of the workloads' file formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grove.plans.tree import InvalidTree, JoinTree


class BadInput(ValueError):
    """A file does not have the form that its workload asks for."""


def ints(spark: SparkSession, path: str, columns: int | None = None) -> DataFrame:
    """Integers between blanks, one row a line: c0, c1, ... Blank lines are skipped; a line ends at its first other word."""
    words = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    whole = lambda w: w.rlike(r"^[+-]?\d+$")
    bad = F.array_position(F.transform(words, whole), False)
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.when(bad > 0, F.slice(words, 1, (bad - 1).cast("int"))).otherwise(words).alias("v"))
    if columns is None:
        columns = lines.agg(F.max(F.size("v")).alias("n")).first()["n"] or 0
    return lines.select(*[F.get("v", F.lit(i)).cast("int").alias(f"c{i}") for i in range(columns)])


def required(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """ints(), with at least one row and the same number of columns on every line."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    shape = lines.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.size(F.split(F.trim("value"), r"\s+")) != columns, 1).otherwise(0)).alias("bad")).first()
    if not shape["n"] or shape["bad"]:
        raise BadInput(f"{path}: {shape['n']} rows, {shape['bad'] or 0} of them without {columns} columns")
    return ints(spark, path, columns)


def tree_file(spark: SparkSession, path: str) -> tuple[JoinTree, list[int]]:
    """tree.txt: on each line id, parent, the parent's and the child's join column, and the number of columns."""
    rows = sorted(tuple(map(int, r["value"].split())) for r in spark.read.text(path).where(F.trim("value") != "").collect())
    if [r[0] for r in rows] != list(range(len(rows))) or any(len(r) != 5 for r in rows):
        raise BadInput(f"{path}: ids must be consecutive, five numbers a line")
    width = [r[4] for r in rows]
    for i, p, a, b, n in rows:
        if p == -1 and (a, b) != (-1, -1):
            raise BadInput(f"{path}: the root's join columns are -1")
        if p != -1 and (not 0 <= p < len(rows) or not 0 <= a < width[p] or not 0 <= b < n):
            raise BadInput(f"{path}: relation {i} joins on a column that is not there")
    try:
        return JoinTree.of([r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows]), width
    except InvalidTree as e:
        raise BadInput(f"{path}: {e}") from e


def tree_workload(spark: SparkSession, folder: str) -> tuple[JoinTree, list[DataFrame], int]:
    """A folder with tree.txt, tables.tbl (relation id and values on each line) and expected.txt."""
    tree, width = tree_file(spark, f"{folder}/tree.txt")
    words = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(f"{folder}/tables.tbl").where(F.trim("value") != "").select(words[0].cast("int").alias("r"), F.slice(words, 2, 1 << 20).alias("v"))
    seen = {r["r"]: (r["lo"], r["hi"]) for r in lines.groupBy("r").agg(F.min(F.size("v")).alias("lo"), F.max(F.size("v")).alias("hi")).collect()}
    if {*seen} != set(range(len(tree))) or any(seen[i] != (n, n) for i, n in enumerate(width)):
        raise BadInput(f"{folder}: each relation needs rows, all of its own width")
    frames = [lines.where(F.col("r") == i).select(*[F.col("v")[j].cast("int").alias(f"c{j}") for j in range(n)]) for i, n in enumerate(width)]
    return tree, frames, expected_rows(spark, f"{folder}/expected.txt", required=True)


def expected_rows(spark: SparkSession, path: str, required: bool = False) -> int:
    """The number in expected.txt, -1 where there is no such file."""
    from pyspark.errors import AnalysisException

    try:
        return int(spark.read.text(path).first()["value"])
    except AnalysisException as e:
        if required:
            raise BadInput(f"{path} is missing") from e
        return -1


def bar_separated(spark: SparkSession, path: str, schema: T.StructType | str, null: str | None = None) -> DataFrame:
    """Fields each followed by a bar, as benchmark generators write them; null: what stands for a null ("" in .dat files)."""
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    wide = T.StructType([*fields.fields, T.StructField("__end", T.StringType())])
    reader = spark.read.option("sep", "|").option("mode", "FAILFAST").schema(wide)
    reader = reader.option("nullValue", null) if null is not None else reader.option("emptyValue", "")
    return reader.csv(path).drop("__end")


def escaped_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with double quotes and a backslash as escape; a folder, a file, or gzip files."""
    return spark.read.option("quote", '"').option("escape", "\\").option("multiLine", True).schema(schema).csv(path)


def edge_list(spark: SparkSession, path: str) -> DataFrame:
    """Edges (source, target) from lines of two or more integers; lines that begin with # are comments."""
    words = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    return lines.select(F.try_element_at(words, F.lit(1)).cast("int").alias("source"), F.try_element_at(words, F.lit(2)).cast("int").alias("target"))


def sample_tables(spark: SparkSession) -> list[DataFrame]:
    """The built-in sample of six small relations (fixed values)."""
    tables = [
        [(15, 10, 3), (8, 7, 5), (9, 10, 1), (8, 9, 3)],
        [(10, 8), (11, 9), (12, 8), (13, 15)],
        [(7, 15), (7, 16), (10, 17), (9, 18)],
        [(1, 1), (3, 4), (3, 2), (5, 1)],
        [(1, 1), (3, 2), (3, 3), (1, 4)],
        [(1, 5), (2, 6), (4, 7), (4, 8)],
    ]
    return [frame(spark, rows) for rows in tables]


def frame(spark: SparkSession, rows: list[tuple], columns: int | None = None) -> DataFrame:
    """Rows of integers with columns c0, c1, ..."""
    n = columns if columns is not None else len(rows[0])
    return spark.createDataFrame(rows, ", ".join(f"c{i} int" for i in range(n)))


def cleaned(df: DataFrame, n: int = 2000, seed: int = 42) -> DataFrame:
    """Rows without an empty field, at most n of them, drawn by a hash of the row."""
    whole = df.dropna("any")
    for f in df.schema:
        if isinstance(f.dataType, T.StringType):
            whole = whole.where(F.col(f"`{f.name}`") != "")
    return whole.orderBy(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns])).limit(n)
