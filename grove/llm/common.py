"""What the operators of this subpackage share: words, tables, sizes, bound variables in SQL lambdas."""

from __future__ import annotations

import ctypes
import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters outside this class.
SPACES = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def first_of_each(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """The row of each class with the smallest (doc_id, th), with all its columns; rows without an id all stay.

    rooted has doc_id, th and root of each row with an id: the hash of its text and the name of its class. Rows with one id
    and one text are one.
    """
    least = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("one")).select("one.doc_id", F.col("one.th").alias("__th"))
    keyed = docs.withColumn("__th", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = keyed.join(least, ["doc_id", "__th"], "left_semi").dropDuplicates(["doc_id", "__th"])
    return kept.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of all texts of a column: what the number of buckets is derived from."""
    return df.agg(F.sum(F.octet_length(F.col(column))).alias("n")).first()["n"] or 0


def buckets_for(size: int, each: int, least: int = 12) -> int:
    """So many buckets that one holds about `each` bytes."""
    return max(least, math.ceil(size / each))


@lru_cache(maxsize=1)
def _trimmer():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library: there is nothing to give back
        return lambda _: 0


#: Bytes of a batch of rows on its way to Python, about; a longer text is a batch of its own.
BATCH = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session that sends rows to Python by bytes and not by ten thousands, so that long texts don't pile up."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    return df


def give_back() -> None:
    """Returns a worker's freed memory to the system; for use after work on large arrays."""
    _trimmer()(0)
