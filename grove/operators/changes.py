"""Inserts, deletes and updates as new tables: a plain table format has no changes in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inserted(df: DataFrame, rows: DataFrame) -> DataFrame:
    """df and more rows, columns matched by name."""
    return df.unionByName(rows)


def deleted(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """df without the rows whose key columns are among those of keys; a null key deletes nothing."""
    return df.join(keys.select(*on), on, "left_anti")


def updated(df: DataFrame, changes: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """df with columns taken from the row of changes that has its key; changes has one row a key, its nulls included."""
    found = changes.select(*on, F.struct(*columns).alias("__new"))
    met = df.join(found, on, "left")
    return met.select(*[_or_old(c, df[c]) if c in columns else df[c] for c in df.columns])


def _or_old(name: str, old: Column) -> Column:
    return F.when(F.col("__new").isNotNull(), F.col(f"__new.{name}")).otherwise(old).alias(name)
