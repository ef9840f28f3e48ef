"""The published workloads as join trees over raw benchmark tables: one projection a relation, filters at the leaves.

Each workload takes the raw tables by name, their columns c0, c1, ... in file order, and gives a tree and its relations.
Keys of two columns are joined as two columns; no numbering pass is needed. Missing keys are null and match nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.functions.expressions import hash_sample, text_contains
from grove.operators.counting import count
from grove.operators.reduce import semi_join
from grove.plans.tree import JoinTree

Tables = dict[str, DataFrame]
Workload = tuple[JoinTree, list[DataFrame]]


def _pick(tables: Tables, table: str, **columns: int) -> DataFrame:
    return tables[table].select(*[F.col(f"c{i}").cast("long").alias(name) for name, i in columns.items()])


def tpcds_q18(tables: Tables) -> Workload:
    """catalog_sales with its date, item and demographics, and the buyer with demographics and address of their own."""
    tree = JoinTree.of([-1, 0, 0, 0, 0, 4, 4], [-1, "sold_date", "item", "bill_cdemo", "bill_customer", "current_cdemo", "current_addr"], [-1, "date", "item", "cdemo", "customer", "cdemo", "address"])
    return tree, [
        _pick(tables, "catalog_sales", sold_date=0, item=15, bill_cdemo=4, bill_customer=3),
        _pick(tables, "date_dim", date=0),
        _pick(tables, "item", item=0),
        _pick(tables, "customer_demographics", cdemo=0),
        _pick(tables, "customer", customer=0, current_cdemo=2, current_addr=4),
        _pick(tables, "customer_demographics", cdemo=0),
        _pick(tables, "customer_address", address=0),
    ]


def _web_returns(tables: Tables) -> DataFrame:
    return _pick(tables, "web_returns", item=2, order=13, refunded_cdemo=4, returning_cdemo=8, refunded_addr=6, reason=12)


def tpcds_q85(tables: Tables) -> Workload:
    """web_sales with page, date and return; the return with both demographics, address and reason."""
    pair = ("item", "order")
    tree = JoinTree.of(
        [-1, 0, 0, 0, 3, 3, 3, 3],
        [-1, "web_page", "sold_date", pair, "refunded_cdemo", "returning_cdemo", "refunded_addr", "reason"],
        [-1, "web_page", "date", pair, "cdemo", "cdemo", "address", "reason"],
    )
    dims = [("customer_demographics", "cdemo"), ("customer_demographics", "cdemo"), ("customer_address", "address"), ("reason", "reason")]
    return tree, [
        _pick(tables, "web_sales", web_page=12, sold_date=0, item=3, order=17),
        _pick(tables, "web_page", web_page=0),
        _pick(tables, "date_dim", date=0),
        _web_returns(tables),
        *[_pick(tables, t, **{c: 0}) for t, c in dims],
    ]


def tpcds_q85_chain3(tables: Tables) -> Workload:
    """web_sales to its return to the refunded demographics."""
    pair = ("item", "order")
    tree = JoinTree.of([-1, 0, 1], [-1, pair, "refunded_cdemo"], [-1, pair, "cdemo"])
    return tree, [_pick(tables, "web_sales", item=3, order=17, web_page=12), _web_returns(tables).select(*pair, "refunded_cdemo"), _pick(tables, "customer_demographics", cdemo=0)]


def tpcds_q85_returns_star(tables: Tables) -> Workload:
    """Returns with both demographics, address and reason."""
    tree = JoinTree.of([-1, 0, 0, 0, 0], [-1, "refunded_cdemo", "returning_cdemo", "refunded_addr", "reason"], [-1, "cdemo", "cdemo", "address", "reason"])
    dims = [("customer_demographics", "cdemo"), ("customer_demographics", "cdemo"), ("customer_address", "address"), ("reason", "reason")]
    return tree, [_web_returns(tables).drop("item", "order"), *[_pick(tables, t, **{c: 0}) for t, c in dims]]


def tpch_q9(tables: Tables, green_only: bool = False) -> Workload:
    """lineitem with its order and its supplied part; the latter with part, supplier and the supplier's nation."""
    parts = tables["part"].where(text_contains(F.col("c1"), "green")) if green_only else tables["part"]
    pair = ("part", "supplier")
    tree = JoinTree.of([-1, 0, 0, 2, 2, 4], [-1, "order", pair, "part", "supplier", "nation"], [-1, "order", pair, "part", "supplier", "nation"])
    return tree, [
        _pick(tables, "lineitem", order=0, part=1, supplier=2),
        _pick(tables, "orders", order=0),
        _pick(tables, "partsupp", part=0, supplier=1),
        parts.select(F.col("c0").cast("long").alias("part")),
        _pick(tables, "supplier", supplier=0, nation=3),
        _pick(tables, "nation", nation=0),
    ]


def _ids(tables: Tables, table: str, column: int, value: str, name: str = "id") -> DataFrame:
    return tables[table].where(F.col(f"c{column}") == value).select(F.col("c0").cast("long").alias(name))


def job_1a(tables: Tables) -> Workload:
    """Companies' part in top films: company and title of movie_companies, and the title's ranks."""
    note = F.col("c4")
    chosen = ~text_contains(note, "(as Metro-Goldwyn-Mayer Pictures)") & (text_contains(note, "(co-production)") | text_contains(note, "(presents)"))
    tree = JoinTree.of([-1, 0, 0, 0, 3], [-1, "company_type", "movie", "movie", "info_type"], [-1, "id", "id", "movie", "id"])
    return tree, [
        _pick({"m": tables["movie_companies"].where(chosen)}, "m", company_type=3, movie=1),
        _ids(tables, "company_type", 1, "production companies"),
        _pick(tables, "title", id=0),
        _pick(tables, "movie_info_idx", movie=1, info_type=2),
        _ids(tables, "info_type", 1, "top 250 rank"),
    ]


def job_13d(tables: Tables, percent: int = 100) -> Workload:
    """Ratings and release dates of films by American producers, for a nested sample of titles."""
    titles = _pick(tables, "title", id=0, kind=3)
    titles = titles if percent >= 100 else titles.where(hash_sample(F.col("id"), percent))
    of = lambda df: semi_join(df, titles, ("movie",), ("id",)) if percent < 100 else df
    tree = JoinTree.of([-1, 0, 0, 2, 2, 0, 5, 0, 7], [-1, "kind", "id", "company", "company_type", "id", "info_type", "id", "info_type"], [-1, "id", "movie", "id", "id", "movie", "id", "movie", "id"])
    return tree, [
        titles,
        _ids(tables, "kind_type", 1, "movie"),
        of(_pick(tables, "movie_companies", movie=1, company=2, company_type=3)),
        _ids(tables, "company_name", 2, "[us]"),
        _ids(tables, "company_type", 1, "production companies"),
        of(_pick(tables, "movie_info", movie=1, info_type=2)),
        _ids(tables, "info_type", 1, "release dates"),
        of(_pick(tables, "movie_info_idx", movie=1, info_type=2)),
        _ids(tables, "info_type", 1, "rating"),
    ]


WORKLOADS: dict[str, Callable[[Tables], Workload]] = {f.__name__: f for f in (tpcds_q18, tpcds_q85, tpcds_q85_chain3, tpcds_q85_returns_star, tpch_q9, job_1a, job_13d)}


def stats(tree: JoinTree, frames: list[DataFrame]) -> dict[str, int]:
    """Rows of each relation, and of the join."""
    return {f"R{i}": df.count() for i, df in enumerate(frames)} | {"expected": count(tree, frames)}
