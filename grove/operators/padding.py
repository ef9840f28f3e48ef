"""Protected output sizes: how many rows a result is padded to, and the padded result."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.functions.expressions import MOST
from grove.operators.counting import count, sensitivity
from grove.operators.sensitivity import smooth_sensitivity
from grove.plans.joins import tree_join
from grove.plans.tree import JoinTree

#: The value of every column of a dummy row (fixed value of the format).
DUMMY = 100000007
#: Protected sizes above this are refused where padded_join makes their rows; sizes as such have no bound below a long's.
MAX_PROTECTED_ROWS = 50_000_000


class PaddingTooLarge(ValueError):
    """The padded result would be larger than allowed."""


@dataclass(frozen=True)
class PaddingStats:
    exact: int
    sensitivity: int
    source: str
    factor: float
    padding: int
    target: int
    epsilon: float
    delta: float


def factor(epsilon: float, delta: float) -> float:
    """How many times the sensitivity is added."""
    grown = 2 * math.exp(epsilon) - 2 * math.exp(epsilon / 2)
    return 2 * math.exp(2) / epsilon * (1 + math.log(1 + grown / delta))


def padding_stats(tree: JoinTree, frames: list[DataFrame], rows: int = 0, epsilon: float = 1.0, delta: float = 1e-9, smooth: bool = True) -> PaddingStats:
    """The protected size: `rows` if that is given and not below the exact size, else the exact size and scaled sensitivity.

    The target is a long, saturating, and never below the exact size.
    """
    exact = count(tree, frames)
    if rows > 0:
        return PaddingStats(exact, 0, "given", 0.0, max(exact, rows) - exact, max(exact, rows), epsilon, delta)
    found = smooth_sensitivity(tree, frames, epsilon, delta) if smooth else None
    if found is not None and found.status == "ok":
        s, source = found.value, "smooth"
    else:
        s, source = sensitivity(tree, frames), "contribution"
    f = factor(epsilon, delta)
    target = min(MOST, max(1, exact + math.ceil(f * max(1, s))))
    return PaddingStats(exact, s, source, f, target - exact, target, epsilon, delta)


def pad(result: DataFrame, target: int, most: int | None = None, have: int | None = None) -> DataFrame:
    """result with is_dummy, and dummy rows up to `target`; never fewer rows than result has. most: targets above are refused."""
    if most is not None and target > most:
        raise PaddingTooLarge(f"{target} rows are asked for, {most} allowed")
    have = result.count() if have is None else have
    spark = result.sparkSession
    dummies = spark.range(max(0, target - have)).select(*[F.lit(DUMMY).cast(f.dataType).alias(f.name) for f in result.schema], F.lit(True).alias("is_dummy"))
    return result.withColumn("is_dummy", F.lit(False)).unionByName(dummies)


def padded_join(tree: JoinTree, frames: list[DataFrame], rows: int = 0, epsilon: float = 1.0, delta: float = 1e-9, **how) -> DataFrame:
    stats = padding_stats(tree, frames, rows, epsilon, delta)
    return pad(tree_join(tree, frames, **how), stats.target, MAX_PROTECTED_ROWS, have=stats.exact)


def size_holds(rows: int, expected: int, padded: bool = False) -> bool:
    """Whether a result has the rows expected of it; padded ones may have more."""
    return expected < 0 or (rows >= expected if padded else rows == expected)
