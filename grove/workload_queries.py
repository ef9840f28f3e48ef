"""The published workloads as registered queries: raw benchmark tables made from the driver's tables, joined along their trees.

RAW holds one text for each raw table, columns c0, c1, ... at the positions of the published formats; Spark and the oracle
both read it. The oracle's joins are written out by relation and edge and share nothing else with the engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grove import sqlcorpus
from grove.operators import graph
from grove.plans.joins import tree_join
from grove.plans.tree import edge_tree
from grove.sources.workloads import WORKLOADS, tpch_q9

RAW = {
    "date_dim": "SELECT DISTINCT year(o_orderdate) * 100 + month(o_orderdate) AS c0 FROM orders WHERE month(o_orderdate) <= 9",
    "item": "SELECT p_partkey AS c0 FROM part WHERE p_size <= 40",
    "customer_demographics": "SELECT s_suppkey AS c0 FROM supplier WHERE s_nationkey < 20",
    "customer_address": "SELECT n_nationkey AS c0 FROM nation WHERE n_regionkey < 4",
    "customer": "SELECT c_custkey AS c0, c_custkey % 7 + 1 AS c2, c_nationkey AS c4 FROM customer",
    "catalog_sales": "SELECT year(o_orderdate) * 100 + month(o_orderdate) AS c0, CASE WHEN l_linenumber < 7 THEN o_custkey END AS c3, l_suppkey AS c4, l_partkey AS c15 FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "web_sales": "SELECT year(o_orderdate) * 100 + month(o_orderdate) AS c0, l_partkey AS c3, l_linenumber AS c12, l_orderkey AS c17 FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "web_returns": "SELECT l_partkey AS c2, l_suppkey AS c4, l_linenumber AS c6, l_suppkey % 9 + 1 AS c8, l_linenumber AS c12, l_orderkey AS c13 FROM lineitem WHERE l_returnflag = 'R'",
    "web_page": "SELECT n_nationkey AS c0 FROM nation WHERE n_nationkey < 6",
    "reason": "SELECT n_nationkey AS c0 FROM nation WHERE n_nationkey % 2 = 1",
    "lineitem": "SELECT l_orderkey AS c0, l_partkey AS c1, l_suppkey AS c2 FROM lineitem",
    "orders": "SELECT o_orderkey AS c0 FROM orders",
    "partsupp": "SELECT DISTINCT l_partkey AS c0, l_suppkey AS c1 FROM lineitem",
    "part": "SELECT p_partkey AS c0, CASE WHEN p_size % 5 = 0 THEN concat('green ', p_name) ELSE p_name END AS c1 FROM part",
    "supplier": "SELECT s_suppkey AS c0, s_nationkey AS c3 FROM supplier",
    "nation": "SELECT n_nationkey AS c0 FROM nation",
    "title": "SELECT o_orderkey AS c0, o_custkey % 3 AS c3 FROM orders",
    "kind_type": "SELECT n_nationkey AS c0, CASE WHEN n_nationkey = 1 THEN 'movie' ELSE 'episode' END AS c1 FROM nation WHERE n_nationkey < 3",
    "company_type": "SELECT n_nationkey AS c0, CASE WHEN n_nationkey < 5 THEN 'production companies' ELSE 'distributors' END AS c1 FROM nation",
    "company_name": "SELECT s_suppkey AS c0, CASE WHEN s_nationkey < 8 THEN '[us]' ELSE '[gb]' END AS c2 FROM supplier",
    "info_type": "SELECT n_nationkey AS c0, CASE n_nationkey WHEN 1 THEN 'top 250 rank' WHEN 2 THEN 'release dates' WHEN 3 THEN 'rating' ELSE 'other' END AS c1 FROM nation",
    "movie_companies": "SELECT l_orderkey AS c1, l_suppkey AS c2, l_linenumber AS c3, CASE WHEN l_returnflag = 'R' THEN '(presents)' WHEN l_returnflag = 'A' THEN '(co-production) (as Metro-Goldwyn-Mayer Pictures)' ELSE '(co-production)' END AS c4 FROM lineitem",
    "movie_info": "SELECT l_orderkey AS c1, l_linenumber AS c2 FROM lineitem",
    "movie_info_idx": "SELECT l_orderkey AS c1, l_linenumber AS c2 FROM lineitem WHERE l_quantity > 10",
}

_DEMO, _ADDRESS = "SELECT c0 AS cdemo FROM raw_customer_demographics", "SELECT c0 AS address FROM raw_customer_address"
_RETURN = "c2 AS item, c13 AS \"order\", c4 AS refunded_cdemo, c8 AS returning_cdemo, c6 AS refunded_addr, c12 AS reason"

#: For each workload its relations as SQL, and its edges as conditions on r0, r1, ...
JOINS: dict[str, tuple[list[str], list[str]]] = {
    "tpcds_q18": (
        ["SELECT c0 AS sold_date, c15 AS item, c4 AS bill_cdemo, c3 AS bill_customer FROM raw_catalog_sales", "SELECT c0 AS date FROM raw_date_dim", "SELECT c0 AS item FROM raw_item",
         _DEMO, "SELECT c0 AS customer, c2 AS current_cdemo, c4 AS current_addr FROM raw_customer", _DEMO, _ADDRESS],
        ["r0.sold_date = r1.date", "r0.item = r2.item", "r0.bill_cdemo = r3.cdemo", "r0.bill_customer = r4.customer", "r4.current_cdemo = r5.cdemo", "r4.current_addr = r6.address"],
    ),
    "tpcds_q85": (
        ["SELECT c12 AS web_page, c0 AS sold_date, c3 AS item, c17 AS \"order\" FROM raw_web_sales", "SELECT c0 AS web_page FROM raw_web_page", "SELECT c0 AS date FROM raw_date_dim",
         f"SELECT {_RETURN} FROM raw_web_returns", _DEMO, _DEMO, _ADDRESS, "SELECT c0 AS reason FROM raw_reason"],
        ["r0.web_page = r1.web_page", "r0.sold_date = r2.date", "r0.item = r3.item AND r0.\"order\" = r3.\"order\"", "r3.refunded_cdemo = r4.cdemo", "r3.returning_cdemo = r5.cdemo", "r3.refunded_addr = r6.address", "r3.reason = r7.reason"],
    ),
    "tpcds_q85_chain3": (
        ["SELECT c3 AS item, c17 AS \"order\", c12 AS web_page FROM raw_web_sales", "SELECT c2 AS item, c13 AS \"order\", c4 AS refunded_cdemo FROM raw_web_returns", _DEMO],
        ["r0.item = r1.item AND r0.\"order\" = r1.\"order\"", "r1.refunded_cdemo = r2.cdemo"],
    ),
    "tpcds_q85_returns_star": (
        ["SELECT c4 AS refunded_cdemo, c8 AS returning_cdemo, c6 AS refunded_addr, c12 AS reason FROM raw_web_returns", _DEMO, _DEMO, _ADDRESS, "SELECT c0 AS reason FROM raw_reason"],
        ["r0.refunded_cdemo = r1.cdemo", "r0.returning_cdemo = r2.cdemo", "r0.refunded_addr = r3.address", "r0.reason = r4.reason"],
    ),
    "tpch_q9": (
        ["SELECT c0 AS \"order\", c1 AS part, c2 AS supplier FROM raw_lineitem", "SELECT c0 AS \"order\" FROM raw_orders", "SELECT c0 AS part, c1 AS supplier FROM raw_partsupp",
         "SELECT c0 AS part FROM raw_part", "SELECT c0 AS supplier, c3 AS nation FROM raw_supplier", "SELECT c0 AS nation FROM raw_nation"],
        ["r0.\"order\" = r1.\"order\"", "r0.part = r2.part AND r0.supplier = r2.supplier", "r2.part = r3.part", "r2.supplier = r4.supplier", "r4.nation = r5.nation"],
    ),
    "job_1a": (
        ["SELECT c3 AS company_type, c1 AS movie FROM raw_movie_companies WHERE c4 NOT LIKE '%(as Metro-Goldwyn-Mayer Pictures)%' AND (c4 LIKE '%(co-production)%' OR c4 LIKE '%(presents)%')",
         "SELECT c0 AS id FROM raw_company_type WHERE c1 = 'production companies'", "SELECT c0 AS id FROM raw_title", "SELECT c1 AS movie, c2 AS info_type FROM raw_movie_info_idx", "SELECT c0 AS id FROM raw_info_type WHERE c1 = 'top 250 rank'"],
        ["r0.company_type = r1.id", "r0.movie = r2.id", "r0.movie = r3.movie", "r3.info_type = r4.id"],
    ),
    "job_13d": (
        ["SELECT c0 AS id, c3 AS kind FROM raw_title", "SELECT c0 AS id FROM raw_kind_type WHERE c1 = 'movie'", "SELECT c1 AS movie, c2 AS company, c3 AS company_type FROM raw_movie_companies",
         "SELECT c0 AS id FROM raw_company_name WHERE c2 = '[us]'", "SELECT c0 AS id FROM raw_company_type WHERE c1 = 'production companies'", "SELECT c1 AS movie, c2 AS info_type FROM raw_movie_info",
         "SELECT c0 AS id FROM raw_info_type WHERE c1 = 'release dates'", "SELECT c1 AS movie, c2 AS info_type FROM raw_movie_info_idx", "SELECT c0 AS id FROM raw_info_type WHERE c1 = 'rating'"],
        ["r0.kind = r1.id", "r0.id = r2.movie", "r2.company = r3.id", "r2.company_type = r4.id", "r0.id = r5.movie", "r5.info_type = r6.id", "r0.id = r7.movie", "r7.info_type = r8.id"],
    ),
}


def raw_tables(spark: SparkSession, d: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: sqlcorpus.run(spark, d, RAW[name]) for name in names}


def _needs(relations: list[str]) -> list[str]:
    return sorted({name for name in RAW for r in relations if f"raw_{name} " in f"{r} "})


def written_join(relations: list[str], on: list[str], columns: list[list[str]]) -> str:
    """A join of relations given as SQL: r0 with r1 by on[0], with r2 by on[1] and so on."""
    names = ", ".join(f'CAST(r{i}."{c}" AS BIGINT) AS "r{i}__{c}"' for i, cs in enumerate(columns) for c in cs)
    rest = " ".join(f"JOIN ({r}) AS r{i + 1} ON {c}" for i, (r, c) in enumerate(zip(relations[1:], on)))
    return f"SELECT {names} FROM ({relations[0]}) AS r0 {rest}"


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: tree_join(*WORKLOADS[name](raw_tables(spark, d, _needs(JOINS[name][0]))))


def _columns(relation: str) -> list[str]:
    return [x.split(" AS ")[1].strip('"') for x in relation.split(" FROM ")[0].removeprefix("SELECT ").split(", ")]


def _oracle(name: str) -> str:
    relations, on = JOINS[name]
    raw = ", ".join(f"raw_{x} AS ({RAW[x]})" for x in _needs(relations))
    return f"WITH {raw} {written_join(relations, on, [_columns(r) for r in relations])}"


QUERIES = {f"workload_{name}": _query(name) for name in JOINS}
ORACLE_SQL = {f"workload_{name}": _oracle(name) for name in JOINS}


def workload_tpch_q9_green(spark: SparkSession, d: str) -> DataFrame:
    return tree_join(*tpch_q9(raw_tables(spark, d, _needs(JOINS["tpch_q9"][0])), green_only=True))


QUERIES["workload_tpch_q9_green"] = workload_tpch_q9_green
ORACLE_SQL["workload_tpch_q9_green"] = ORACLE_SQL["workload_tpch_q9"].replace("FROM raw_part)", "FROM raw_part WHERE c1 LIKE '%green%')")

# --- aliases of an edge table along a tree -------------------------------------------------------------------------

#: relations, depth, branching, and the out-edges of a node in each alias, of one tree of each published family
EDGE_TREES = {"edges_depth": (5, 4, 2, 2), "edges_branch": (6, 2, 4, 2), "edges_relations": (7, 2, 3, 2)}


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """From customers to the customers that their orders' numbers fall on."""
    orders, n = spark.read.parquet(f"{d}/orders.parquet"), spark.read.parquet(f"{d}/customer.parquet").count()
    return graph.edges_of(orders.select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") * 7919 % n + 1).alias("b")), "a", "b")


def _edge_query(relations: int, depth: int, branching: int, degree: int) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        aliases = graph.degree_aliases(_edges(spark, d), [degree] * relations)
        rows = tree_join(edge_tree(relations, depth, branching), aliases, [["source", "target"], *[["target"]] * (relations - 1)])
        return rows.groupBy("r0__source").agg(F.count(F.lit(1)).alias("rows"), F.sum(f"r{relations - 1}__target").alias("total"))

    return run


#: The parents of EDGE_TREES' relations, written out.
_PARENTS = {"edges_depth": [0, 1, 2, 3], "edges_branch": [0, 1, 0, 0, 0], "edges_relations": [0, 1, 0, 0, 1, 1]}


def _edge_oracle(name: str) -> str:
    relations, _, _, degree = EDGE_TREES[name]
    joins = " ".join(f"JOIN e AS r{i + 1} ON r{p}.target = r{i + 1}.source" for i, p in enumerate(_PARENTS[name]))
    return f"""
WITH g AS (SELECT DISTINCT CAST(o_custkey AS BIGINT) AS source, CAST(o_orderkey * 7919 % (SELECT count(*) FROM customer) + 1 AS BIGINT) AS target FROM orders),
e AS (SELECT source, target FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY target) AS rn FROM g) AS x WHERE rn <= {degree})
SELECT r0.source AS r0__source, count(*) AS rows, CAST(sum(r{relations - 1}.target) AS BIGINT) AS total FROM e AS r0 {joins} GROUP BY r0.source"""


QUERIES |= {name: _edge_query(*shape) for name, shape in EDGE_TREES.items()}
ORACLE_SQL |= {name: _edge_oracle(name) for name in EDGE_TREES}
