import itertools

import pytest

from grove.plans.joins import tree_join
from grove.sources.workloads import WORKLOADS, job_13d, stats, tpch_q9


def raw(spark, rows, width=20):
    full = [tuple(str(r.get(i)) if r.get(i) is not None else None for i in range(width)) for r in rows]
    return spark.createDataFrame(full, ", ".join(f"c{i} string" for i in range(width)))


@pytest.fixture(scope="module")
def tables(spark):
    dim = lambda *ids: raw(spark, [{0: i} for i in ids])
    return {
        "catalog_sales": raw(spark, [{0: 1, 15: 5, 4: 7, 3: 9}, {0: 1, 15: 5, 4: 7, 3: None}, {0: 2, 15: 5, 4: 7, 3: 9}]),
        "date_dim": dim(1), "item": dim(5), "customer_demographics": dim(7, 8), "customer_address": dim(3), "reason": dim(4), "web_page": dim(6),
        "customer": raw(spark, [{0: 9, 2: 8, 4: 3}]),
        "web_sales": raw(spark, [{12: 6, 0: 1, 3: 5, 17: 100}, {12: 6, 0: 1, 3: 5, 17: 101}]),
        "web_returns": raw(spark, [{2: 5, 13: 100, 4: 7, 8: 8, 6: 3, 12: 4}, {2: 5, 13: 101, 4: 7, 8: None, 6: 3, 12: 4}]),
        "lineitem": raw(spark, [{0: 1, 1: 2, 2: 3}, {0: 1, 1: 4, 2: 3}]), "orders": dim(1), "partsupp": raw(spark, [{0: 2, 1: 3}, {0: 4, 1: 3}]),
        "part": raw(spark, [{0: 2, 1: "dark green"}, {0: 4, 1: "red"}]), "supplier": raw(spark, [{0: 3, 3: 0}]), "nation": dim(0),
        "company_type": raw(spark, [{0: 1, 1: "production companies"}, {0: 2, 1: "distributors"}]),
        "info_type": raw(spark, [{0: 1, 1: "top 250 rank"}, {0: 2, 1: "release dates"}, {0: 3, 1: "rating"}]),
        "kind_type": raw(spark, [{0: 1, 1: "movie"}]), "company_name": raw(spark, [{0: 11, 2: "[us]"}, {0: 12, 2: "[gb]"}]),
        "title": raw(spark, [{0: i, 3: 1} for i in range(1, 41)]),
        "movie_companies": raw(spark, [{1: i, 2: 11 + i % 2, 3: 1, 4: n} for i, n in zip(range(1, 41), itertools.cycle(["(presents)", "(co-production) (as Metro-Goldwyn-Mayer Pictures)", ""]))]),
        "movie_info": raw(spark, [{1: i, 2: 2} for i in range(1, 41)]),
        "movie_info_idx": raw(spark, [{1: i, 2: 1 + 2 * (i % 2)} for i in range(1, 41)] + [{1: 2, 2: 3}]),
    }


@pytest.mark.parametrize("name,n", [("tpcds_q18", 1), ("tpcds_q85", 1), ("tpcds_q85_chain3", 2), ("tpcds_q85_returns_star", 1), ("tpch_q9", 2), ("job_1a", 7), ("job_13d", 1)])
def test_workload_sizes(tables, name, n):
    tree, frames = WORKLOADS[name](tables)
    assert tree_join(tree, frames).count() == n == stats(tree, frames)["expected"]


def test_variants(tables):
    assert tree_join(*tpch_q9(tables, green_only=True)).count() == 1
    small, large = (job_13d(tables, p)[1][0] for p in (20, 60))
    assert {r["id"] for r in small.collect()} < {r["id"] for r in large.collect()}
