"""Column expressions that more than one operator needs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The largest count: products and sums stop there.
MOST = (1 << 63) - 1
WIDE = "decimal(38,0)"


def saturated(wide: Column) -> Column:
    """A wide decimal as a long, the largest long where it is larger."""
    return F.least(wide, F.lit(MOST).cast(WIDE)).cast("long")


def times(*counts: Column) -> Column:
    """The product of non-negative longs, saturating after each step."""
    return reduce(lambda a, b: saturated(a.cast(WIDE) * b.cast(WIDE)), counts, F.lit(1).cast("long"))


def total(count: Column) -> Column:
    """The saturating sum of non-negative longs, 0 over no rows."""
    return saturated(F.coalesce(F.sum(count.cast("decimal(28,0)")).cast(WIDE), F.lit(0).cast(WIDE)))


def hash_bucket(key: Column, buckets: int = 100) -> Column:
    """The bucket of an integer key by multiplicative hashing; keys up to 3.4e9 in size stay within a long."""
    return F.pmod((key.cast("long") * F.lit(2654435761)).bitwiseAND(F.lit(4294967295)), F.lit(buckets))


def hash_sample(key: Column, percent: int) -> Column:
    """Whether a key is in the sample of so many percent; samples are nested."""
    return hash_bucket(key) < percent


def suffix_products(counts: list[Column]) -> list[Column]:
    """For each of a row's counts the product of those after it."""
    return [times(*counts[i + 1 :]) for i in range(len(counts))]


def digit(position: Column, later: Column, radix: Column) -> Column:
    """A digit of a mixed-radix number: later is the product of the radices after this one."""
    return F.call_function("div", position, later) % radix


def text_contains(column: Column, *words: str) -> Column:
    """Whether a text contains every one of some words."""
    return reduce(lambda a, b: a & b, [column.contains(w) for w in words])
