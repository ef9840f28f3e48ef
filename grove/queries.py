"""The registered queries over the driver's tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grove import sqlcorpus, workload_queries
from grove.functions import encryption
from grove.functions.expressions import hash_bucket, hash_sample, suffix_products, text_contains
from grove.operators import changes, counting, graph, padding, positions, reduce, scans
from grove.plans.joins import tree_join
from grove.plans.tree import JoinTree
from grove.sqlcorpus.texts import TEXTS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = dict(TEXTS)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


# --- trees ----------------------------------------------------------------------------------------------------------

Q9 = JoinTree.of([-1, 0, 0, 0, 3], [-1, "l_orderkey", "l_partkey", "l_suppkey", "s_nationkey"], [-1, "o_orderkey", "p_partkey", "s_suppkey", "n_nationkey"])
CHAIN3 = JoinTree.of([-1, 0, 1], [-1, "l_orderkey", "o_custkey"], [-1, "o_orderkey", "c_custkey"])
STAR = JoinTree.of([-1, 0, 0], [-1, "n_nationkey", "n_nationkey"], [-1, "s_nationkey", "c_nationkey"])
DEEP7 = JoinTree.of([-1, 0, 1, 1, 0, 4, 5], [-1, "o_orderkey", "l_partkey", "l_suppkey", "o_custkey", "c_nationkey", "n_regionkey"], [-1, "l_orderkey", "p_partkey", "s_suppkey", "c_custkey", "n_nationkey", "r_regionkey"])


def q9_frames(spark: SparkSession, d: str) -> list[DataFrame]:
    return [
        t(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"),
        t(spark, d, "orders", "o_orderkey"),
        t(spark, d, "part", "p_partkey", "p_size"),
        t(spark, d, "supplier", "s_suppkey", "s_nationkey"),
        t(spark, d, "nation", "n_nationkey"),
    ]


def chain3_frames(spark: SparkSession, d: str) -> list[DataFrame]:
    return [t(spark, d, "lineitem", "l_orderkey", "l_linenumber"), t(spark, d, "orders", "o_orderkey", "o_custkey"), t(spark, d, "customer", "c_custkey", "c_nationkey")]


def star_frames(spark: SparkSession, d: str) -> list[DataFrame]:
    return [t(spark, d, "nation", "n_nationkey"), t(spark, d, "supplier", "s_suppkey", "s_nationkey"), t(spark, d, "customer", "c_custkey", "c_nationkey")]


Q9_SQL = """
SELECT l_orderkey AS r0__l_orderkey, l_partkey AS r0__l_partkey, l_suppkey AS r0__l_suppkey, l_linenumber AS r0__l_linenumber, o_orderkey AS r1__o_orderkey,
  p_partkey AS r2__p_partkey, p_size AS r2__p_size, s_suppkey AS r3__s_suppkey, s_nationkey AS r3__s_nationkey, n_nationkey AS r4__n_nationkey
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"""
STAR_SQL = """
SELECT n_nationkey AS r0__n_nationkey, s_suppkey AS r1__s_suppkey, s_nationkey AS r1__s_nationkey, c_custkey AS r2__c_custkey, c_nationkey AS r2__c_nationkey
FROM nation JOIN supplier ON n_nationkey = s_nationkey JOIN customer ON n_nationkey = c_nationkey"""


@query("""
SELECT n_name, CAST(extract(year FROM o_orderdate) AS BIGINT) AS o_year, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
GROUP BY n_name, extract(year FROM o_orderdate)""")
def tree_q9_revenue(spark: SparkSession, d: str) -> DataFrame:
    frames = [
        t(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount"),
        t(spark, d, "orders", "o_orderkey", "o_orderdate"),
        t(spark, d, "part", "p_partkey"),
        t(spark, d, "supplier", "s_suppkey", "s_nationkey"),
        t(spark, d, "nation", "n_nationkey", "n_name"),
    ]
    rows = tree_join(Q9, frames, [["l_extendedprice", "l_discount"], ["o_orderdate"], [], [], ["n_name"]])
    revenue = F.col("r0__l_extendedprice") * (1 - F.col("r0__l_discount"))
    return rows.groupBy(F.col("r4__n_name").alias("n_name"), F.year("r1__o_orderdate").cast("long").alias("o_year")).agg(F.round(F.sum(revenue), 4).alias("revenue"))


@query(Q9_SQL)
def tree_q9(spark: SparkSession, d: str) -> DataFrame:
    return tree_join(Q9, q9_frames(spark, d))


@query(Q9_SQL)
def tree_reduced_q9(spark: SparkSession, d: str) -> DataFrame:
    return tree_join(Q9, q9_frames(spark, d), strategy="reduced")


@query(Q9_SQL)
def tree_binary_q9(spark: SparkSession, d: str) -> DataFrame:
    return tree_join(Q9, q9_frames(spark, d), strategy="binary")


@query(Q9_SQL)
def positional_join_q9(spark: SparkSession, d: str) -> DataFrame:
    return tree_join(Q9, q9_frames(spark, d), strategy="positional")


@query(STAR_SQL)
def positional_join_star(spark: SparkSession, d: str) -> DataFrame:
    return tree_join(STAR, star_frames(spark, d), strategy="positional")


@query(Q9_SQL)
def tree_bfs_order_q9(spark: SparkSession, d: str) -> DataFrame:
    return tree_join(Q9, q9_frames(spark, d), order="bfs")


@query("""
SELECT l_orderkey AS r0__l_orderkey, l_linenumber AS r0__l_linenumber, o_orderkey AS r1__o_orderkey, o_custkey AS r1__o_custkey, c_custkey AS r2__c_custkey, c_nationkey AS r2__c_nationkey
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""")
def tree_chain3(spark: SparkSession, d: str) -> DataFrame:
    return tree_join(CHAIN3, chain3_frames(spark, d))


@query(STAR_SQL)
def tree_star_m2m(spark: SparkSession, d: str) -> DataFrame:
    return tree_join(STAR, star_frames(spark, d), strategy="spread")


@query("""
SELECT o_orderkey AS r0__o_orderkey, l_linenumber AS r1__l_linenumber, p_partkey AS r2__p_partkey, s_suppkey AS r3__s_suppkey, c_custkey AS r4__c_custkey, n_nationkey AS r5__n_nationkey, r_regionkey AS r6__r_regionkey
FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def tree_deep7(spark: SparkSession, d: str) -> DataFrame:
    frames = [
        t(spark, d, "orders", "o_orderkey", "o_custkey"), t(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), t(spark, d, "part", "p_partkey"),
        t(spark, d, "supplier", "s_suppkey"), t(spark, d, "customer", "c_custkey", "c_nationkey"), t(spark, d, "nation", "n_nationkey", "n_regionkey"), t(spark, d, "region", "r_regionkey"),
    ]
    return tree_join(DEEP7, frames, [["o_orderkey"], ["l_linenumber"], ["p_partkey"], ["s_suppkey"], ["c_custkey"], ["n_nationkey"], ["r_regionkey"]])


# --- reducers and counting ------------------------------------------------------------------------------------------


def _asia(spark: SparkSession, d: str) -> list[DataFrame]:
    frames = chain3_frames(spark, d)
    return [frames[0], frames[1], frames[2].where("c_nationkey < 5")]


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def full_reducer_up(spark: SparkSession, d: str) -> DataFrame:
    return reduce.reduce_up(CHAIN3, _asia(spark, d))[1]


@query("""
SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey < 5 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))""")
def full_reducer_down(spark: SparkSession, d: str) -> DataFrame:
    return reduce.full_reduce(CHAIN3, _asia(spark, d))[2]


@query("SELECT c_custkey, c_nationkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    return reduce.semi_join(t(spark, d, "customer", "c_custkey", "c_nationkey"), t(spark, d, "orders").where("o_orderstatus = 'P'"), ("c_custkey",), ("o_custkey",))


@query("SELECT c_custkey, c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_join(spark: SparkSession, d: str) -> DataFrame:
    return reduce.anti_join(t(spark, d, "customer", "c_custkey", "c_nationkey"), t(spark, d, "orders").where("o_orderstatus = 'P'"), ("c_custkey",), ("o_custkey",))


@query("SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders")
def counting_semi_join(spark: SparkSession, d: str) -> DataFrame:
    return reduce.counting_semi_join(t(spark, d, "orders", "o_orderkey"), t(spark, d, "lineitem"), ("o_orderkey",), ("l_orderkey",))


@query("SELECT o_orderkey, CAST(coalesce((SELECT sum(l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey), 0) AS BIGINT) AS n FROM orders")
def sum_semi_join(spark: SparkSession, d: str) -> DataFrame:
    return reduce.counting_semi_join(t(spark, d, "orders", "o_orderkey"), t(spark, d, "lineitem"), ("o_orderkey",), ("l_orderkey",), "l_linenumber")


@query(f"SELECT count(*) AS n FROM ({STAR_SQL}) AS j")
def count_dp(spark: SparkSession, d: str) -> DataFrame:
    return counting.output_size(STAR, star_frames(spark, d))


@query("SELECT n_nationkey, count(*) AS delta FROM nation JOIN supplier ON n_nationkey = s_nationkey JOIN customer ON n_nationkey = c_nationkey GROUP BY n_nationkey")
def count_dp_per_root(spark: SparkSession, d: str) -> DataFrame:
    counted = counting.with_counts(STAR, star_frames(spark, d))[0]
    return counted.where("__delta > 0").select("n_nationkey", F.col("__delta").alias("delta"))


@query("SELECT c_custkey, (SELECT count(*) FROM supplier WHERE s_nationkey = c_nationkey) AS contribution FROM customer")
def tuple_contribution(spark: SparkSession, d: str) -> DataFrame:
    return counting.contributions(STAR, star_frames(spark, d))[2].select("c_custkey", F.col("__contribution").alias("contribution"))


@query("""
SELECT max(n) AS n FROM (SELECT max(a * b) AS n FROM (SELECT n_nationkey, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS a, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS b FROM nation) AS x
  UNION ALL SELECT max(n) FROM (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier) GROUP BY c_nationkey) AS y
  UNION ALL SELECT max(n) FROM (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer) GROUP BY s_nationkey) AS z) AS u""")
def max_contribution(spark: SparkSession, d: str) -> DataFrame:
    parts = [df.agg(F.max("__contribution").alias("n")) for df in counting.contributions(STAR, star_frames(spark, d))]
    return parts[0].union(parts[1]).union(parts[2]).agg(F.max("n").alias("n"))


@query("SELECT max(n) AS n FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey) AS x")
def max_degree(spark: SparkSession, d: str) -> DataFrame:
    return counting.max_degree(t(spark, d, "lineitem"), "l_suppkey")


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey")
def reduce_by_key(spark: SparkSession, d: str) -> DataFrame:
    return reduce.reduce_by_key(t(spark, d, "lineitem"), "l_partkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, n FROM lineitem JOIN (SELECT p_partkey, p_size AS n FROM part WHERE p_size > 25) AS p ON l_partkey = p_partkey")
def annotate(spark: SparkSession, d: str) -> DataFrame:
    sizes = t(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("n"))
    return reduce.annotate(t(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey"), sizes, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "n")


@query("""
SELECT s_suppkey, s_nationkey, a1, a2 FROM supplier JOIN (SELECT s_nationkey AS k, count(*) AS a1 FROM supplier GROUP BY s_nationkey) AS x ON s_nationkey = x.k
  JOIN (SELECT c_nationkey AS k, count(*) AS a2 FROM customer GROUP BY c_nationkey) AS y ON s_nationkey = y.k""")
def augment(spark: SparkSession, d: str) -> DataFrame:
    left, _ = reduce.augment(t(spark, d, "supplier", "s_suppkey", "s_nationkey"), t(spark, d, "customer", "c_nationkey"), "s_nationkey", "c_nationkey")
    return left.select("s_suppkey", "s_nationkey", "a1", "a2")


# --- scans ----------------------------------------------------------------------------------------------------------

EVENT = ("user_id", "event_id")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events", "user_id", "event_id", "event_type").withColumn("v", (F.col("event_id") % 7).cast("long"))


_E = "(SELECT user_id, event_id, event_type, CAST(event_id % 7 AS BIGINT) AS v FROM events) AS e"


def _window(frame: str, name: str) -> str:
    return f"SELECT user_id, event_id, CAST(coalesce(sum(v) OVER (PARTITION BY user_id ORDER BY event_id {frame}), 0) AS BIGINT) AS {name} FROM {_E}"


@query(_window("ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "s"))
def segmented_prefix_sum(spark: SparkSession, d: str) -> DataFrame:
    return scans.prefix_sum(_events(spark, d), "v", ["user_id"], ["event_id"], "s").select(*EVENT, "s")


@query(_window("ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING", "s"))
def segmented_prefix_sum_exclusive(spark: SparkSession, d: str) -> DataFrame:
    return scans.prefix_sum(_events(spark, d), "v", ["user_id"], ["event_id"], "s", exclusive=True).select(*EVENT, "s")


@query(_window("ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING", "s"))
def suffix_sum(spark: SparkSession, d: str) -> DataFrame:
    return scans.suffix_sum(_events(spark, d), "v", ["user_id"], ["event_id"], "s").select(*EVENT, "s")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(exp(sum(ln(f)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS p
FROM (SELECT *, 1 + l_discount AS f FROM lineitem) AS x""")
def suffix_product(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount").withColumn("f", 1 + F.col("l_discount"))
    out = scans.suffix_product(rows, "f", ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "f"], "p")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("p", 6).alias("p"))


@query(f"SELECT user_id, event_id, CAST(sum(v) OVER (PARTITION BY user_id) AS BIGINT) AS s FROM {_E}")
def segment_total(spark: SparkSession, d: str) -> DataFrame:
    return scans.segment_total(_events(spark, d), "v", ["user_id"], "s").select(*EVENT, "s")


@query("SELECT o_orderkey, CAST(coalesce(sum(v) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM (SELECT o_orderkey, o_orderkey % 5 AS v FROM orders) AS x")
def global_prefix_sum(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "orders", "o_orderkey").withColumn("v", F.col("o_orderkey") % 5)
    return scans.global_prefix_sum(rows, "v", ["o_orderkey"], "s").select("o_orderkey", "s")


@query(f"SELECT user_id, event_id, last_value(CASE WHEN v > 4 THEN v END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM {_E}")
def fill_down(spark: SparkSession, d: str) -> DataFrame:
    return scans.fill_down(_events(spark, d), F.col("v") > 4, ["v"], ["user_id"], ["event_id"]).select(*EVENT, "v")


@query(f"SELECT user_id, event_id, unnest(generate_series(CAST(0 AS BIGINT), v - 1)) AS o FROM {_E} WHERE v > 0")
def expand_rows(spark: SparkSession, d: str) -> DataFrame:
    return scans.expand(_events(spark, d), "v", "o").select(*EVENT, "o")


@query(f"SELECT user_id, event_id, unnest(generate_series(CAST(0 AS BIGINT), greatest(v, 1) - 1)) AS o FROM {_E}")
def expand_rows_at_least_one(spark: SparkSession, d: str) -> DataFrame:
    return scans.expand(_events(spark, d), "v", "o", least=1).select(*EVENT, "o")


@query("""
SELECT n_nationkey, start, delta FROM (
  SELECT n_nationkey, delta, CAST(coalesce(sum(delta) OVER (ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM (SELECT n_nationkey, count(*) AS delta FROM nation JOIN supplier ON n_nationkey = s_nationkey JOIN customer ON n_nationkey = c_nationkey GROUP BY n_nationkey) AS x) AS y""")
def root_positions(spark: SparkSession, d: str) -> DataFrame:
    return positions.root_positions(STAR, star_frames(spark, d)).select("n_nationkey", F.col("__start").alias("start"), F.col("__delta").alias("delta"))


@query("""
SELECT n_nationkey, start + o AS pos FROM (
  SELECT n_nationkey, start, unnest(generate_series(CAST(0 AS BIGINT), delta - 1)) AS o FROM (
    SELECT n_nationkey, delta, CAST(coalesce(sum(delta) OVER (ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
    FROM (SELECT n_nationkey, count(*) AS delta FROM nation JOIN supplier ON n_nationkey = s_nationkey JOIN customer ON n_nationkey = c_nationkey GROUP BY n_nationkey) AS x) AS y) AS z""")
def expand_positions(spark: SparkSession, d: str) -> DataFrame:
    rows = positions.root_positions(STAR, star_frames(spark, d))
    return scans.expand(rows, "__delta", "o", even=True).select("n_nationkey", (F.col("__start") + F.col("o")).alias("pos"))


@query(f"SELECT user_id, event_id, CAST(coalesce(sum(v) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rank FROM {_E}")
def child_rank(spark: SparkSession, d: str) -> DataFrame:
    return scans.child_rank(_events(spark, d), ["user_id"], "v", ["event_id"]).select(*EVENT, "rank")


@query("""
SELECT n_nationkey, b AS sc1, CAST(1 AS BIGINT) AS sc2, (17 // greatest(b, 1)) % greatest(a, 1) AS d1, 17 % greatest(b, 1) AS d2
FROM (SELECT n_nationkey, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS a, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS b FROM nation) AS x""")
def sibling_suffix_products(spark: SparkSession, d: str) -> DataFrame:
    counted = counting.with_counts(STAR, star_frames(spark, d))[0]
    us = [F.greatest("__u1", F.lit(1)), F.greatest("__u2", F.lit(1))]
    sc1, sc2 = suffix_products([F.col("__u1"), F.col("__u2")])
    d1, d2 = scans.radix_state(F.lit(17).cast("long"), us)
    return counted.select("n_nationkey", sc1.alias("sc1"), sc2.alias("sc2"), d1.alias("d1"), d2.alias("d2"))


@query(f"""
SELECT pos, r0__n_nationkey, r1__s_suppkey, r2__c_custkey
FROM (SELECT *, row_number() OVER (ORDER BY r0__n_nationkey, r1__s_suppkey, r2__c_custkey) - 1 AS pos FROM ({STAR_SQL}) AS j) AS k WHERE pos >= 10 AND pos < 50""")
def positional_range(spark: SparkSession, d: str) -> DataFrame:
    """Forty positions of the join without the join: positions follow the relations' rows in order."""
    rows = positions.materialise(STAR, star_frames(spark, d), 10, 50)
    return rows.select(F.col("__pos").alias("pos"), "r0__n_nationkey", "r1__s_suppkey", "r2__c_custkey")


@query()
def sampled_join_rows(spark: SparkSession, d: str) -> DataFrame:
    return positions.sample(STAR, star_frames(spark, d), 200)


@query("""
SELECT a.user_id, a.event_id, b.event_id AS other FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_id >= a.event_id AND b.event_id < a.event_id + 200""")
def interval_join(spark: SparkSession, d: str) -> DataFrame:
    a = t(spark, d, "events", "user_id", "event_id")
    b = a.select(F.col("user_id").alias("u"), F.col("event_id").alias("other"))
    return scans.interval_join(a, b, ("user_id", "u"), "event_id", "other", 200).select("user_id", "event_id", "other")


@query("SELECT s_suppkey, s_nationkey, c_custkey, c_nationkey FROM supplier JOIN customer ON s_nationkey = c_nationkey")
def two_way_zip_join(spark: SparkSession, d: str) -> DataFrame:
    left, right = t(spark, d, "supplier", "s_suppkey", "s_nationkey"), t(spark, d, "customer", "c_custkey", "c_nationkey")
    return scans.zip_join(left, right, "s_nationkey", "c_nationkey", (["s_suppkey"], ["c_custkey"]))


@query("""
WITH a AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i FROM supplier), b AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS j FROM customer)
SELECT s_suppkey, s_nationkey, c_custkey, c_nationkey, false AS is_dummy FROM a JOIN b ON s_nationkey = c_nationkey ORDER BY s_nationkey, i, j LIMIT 40""")
def two_way_zip_join_cut(spark: SparkSession, d: str) -> DataFrame:
    left, right = t(spark, d, "supplier", "s_suppkey", "s_nationkey"), t(spark, d, "customer", "c_custkey", "c_nationkey")
    return scans.zip_join(left, right, "s_nationkey", "c_nationkey", (["s_suppkey"], ["c_custkey"]), 40)


@query(f"""
SELECT user_id, event_id, v, o, false AS is_dummy FROM (SELECT user_id, event_id, v, unnest(generate_series(CAST(0 AS BIGINT), greatest(v, 1) - 1)) AS o FROM {_E}) AS x ORDER BY user_id, event_id, o LIMIT 1000""")
def expand_to_size(spark: SparkSession, d: str) -> DataFrame:
    return scans.expand_to(_events(spark, d).select(*EVENT, "v"), "v", 1000, list(EVENT), "o")


@query(f"""
SELECT user_id, event_id, v, false AS is_dummy FROM {_E} WHERE v = 3 AND user_id < 3 UNION ALL
SELECT NULL, NULL, NULL, true FROM range(CAST(100000 - (SELECT count(*) FROM events WHERE event_id % 7 = 3 AND user_id < 3) AS BIGINT))""")
def compact_and_pad(spark: SparkSession, d: str) -> DataFrame:
    return scans.compact(_events(spark, d).select(*EVENT, "v"), (F.col("v") == 3) & (F.col("user_id") < 3), 100_000, list(EVENT), pad=True)


@query("""
WITH j AS (SELECT *, row_number() OVER (ORDER BY r0__n_nationkey, r1__s_suppkey, r2__c_custkey) - 1 AS pos FROM (""" + STAR_SQL + """) AS x)
SELECT pos, r0__n_nationkey, r1__s_suppkey, r2__c_custkey FROM j JOIN (SELECT c_custkey * 3 - 3 AS p FROM customer) AS a ON pos = p""")
def at_positions(spark: SparkSession, d: str) -> DataFrame:
    asked = t(spark, d, "customer").select((F.col("c_custkey") * 3 - 3).alias("pos"))
    rows = positions.at_positions(STAR, star_frames(spark, d), asked)
    return rows.select(F.col("__pos").alias("pos"), "r0__n_nationkey", "r1__s_suppkey", "r2__c_custkey")


@query("SELECT l_suppkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_suppkey, l_linenumber) AS INT) AS n FROM lineitem")
def multi_number(spark: SparkSession, d: str) -> DataFrame:
    return scans.multi_number(t(spark, d, "lineitem", "l_suppkey", "l_linenumber"), "n")


@query("""
SELECT s_nationkey, s_suppkey, c // 3 + (c % 3) * 4 AS q FROM (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS c FROM supplier) AS x""")
def align_ordinal(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "supplier", "s_nationkey", "s_suppkey").withColumns({"a1": F.lit(3).cast("long"), "a2": F.lit(4).cast("long")})
    return scans.align_ordinal(rows, ["s_nationkey"], ["s_suppkey"], "a1", "a2").select("s_nationkey", "s_suppkey", F.col("q").cast("long").alias("q"))


@query(f"SELECT user_id, event_id, v FROM {_E} WHERE v > 3")
def compact(spark: SparkSession, d: str) -> DataFrame:
    return scans.compact(_events(spark, d), F.col("v") > 3).select(*EVENT, "v")


@query(f"SELECT user_id, event_id, v FROM {_E} WHERE v > 3 ORDER BY user_id, event_id LIMIT 50")
def compact_keep_n(spark: SparkSession, d: str) -> DataFrame:
    return scans.compact(_events(spark, d), F.col("v") > 3, 50, ["user_id", "event_id"]).select(*EVENT, "v")


@query("SELECT l_partkey, l_suppkey, CAST(dense_rank() OVER (ORDER BY l_partkey, l_suppkey) AS BIGINT) AS pair FROM lineitem")
def composite_pair_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "lineitem", "l_partkey", "l_suppkey")
    left, _ = scans.composite_ids(rows, rows.distinct(), ["l_partkey", "l_suppkey"], ["l_partkey", "l_suppkey"], "pair")
    return left.select("l_partkey", "l_suppkey", "pair")


@query("SELECT o_orderkey, ((o_orderkey * 2654435761) & 4294967295) % 100 AS bucket FROM orders WHERE ((o_orderkey * 2654435761) & 4294967295) % 100 < 20")
def hash_bucket_sample(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders", "o_orderkey").where(hash_sample(F.col("o_orderkey"), 20)).select("o_orderkey", hash_bucket(F.col("o_orderkey")).alias("bucket"))


@query("SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#12' OR p_type = 'ECONOMY'")
def dim_filters(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").where((F.col("p_brand") == "Brand#12") | (F.col("p_type") == "ECONOMY")).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'small') AND NOT contains(p_name, 'ring')")
def contains_filters(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part", "p_partkey", "p_name").where(text_contains(F.col("p_name"), "small") & ~text_contains(F.col("p_name"), "ring"))


@query("SELECT s_suppkey AS a, s_suppkey AS b FROM supplier")
def duplicated_projection(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "supplier").select(F.col("s_suppkey").alias("a"), F.col("s_suppkey").alias("b"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) AS x WHERE rn <= 3")
def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    return scans.top_per_group(t(spark, d, "orders", "o_custkey", "o_orderkey", "o_totalprice"), 3, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def global_topk(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders", "o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


# --- padding and sensitivity ----------------------------------------------------------------------------------------


@query(f"SELECT r0__n_nationkey, r1__s_suppkey, r2__c_custkey, false AS is_dummy FROM ({STAR_SQL}) AS j UNION ALL SELECT 100000007, 100000007, 100000007, true FROM range(500)")
def pad_output(spark: SparkSession, d: str) -> DataFrame:
    frames = star_frames(spark, d)
    rows = tree_join(STAR, frames, [["n_nationkey"], ["s_suppkey"], ["c_custkey"]], strategy="spread")
    n = counting.count(STAR, frames)
    return padding.pad(rows, n + 500, have=n)


@query("""
WITH c AS (SELECT n_nationkey, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS a, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS b FROM nation),
x AS (SELECT sum(a * b) AS exact, greatest(max(a * b), max(CASE WHEN a > 0 THEN b END), max(CASE WHEN b > 0 THEN a END)) AS s FROM c),
f AS (SELECT 2 * exp(2) * (1 + ln(1 + (2 * exp(1) - 2 * exp(0.5)) / 1e-9)) AS f)
SELECT CAST(exact AS BIGINT) AS exact, CAST(s AS BIGINT) AS sensitivity, round(f, 6) AS factor, CAST(exact + ceil(f * s) AS BIGINT) AS target FROM x, f""")
def do_stats(spark: SparkSession, d: str) -> DataFrame:
    s = padding.padding_stats(STAR, star_frames(spark, d), smooth=False)
    return spark.createDataFrame([(s.exact, s.sensitivity, round(s.factor, 6), s.target)], "exact bigint, sensitivity bigint, factor double, target bigint")


@query("""
WITH n AS (SELECT (SELECT max(n) FROM (SELECT count(*) AS n FROM supplier GROUP BY s_nationkey) AS x) AS a, (SELECT max(n) FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey) AS x) AS b,
  (SELECT count(*) FROM nation) AS rn, (SELECT count(*) FROM supplier) AS rs, (SELECT count(*) FROM customer) AS rc, 4 / (2 * ln(2 * exp(2) / 1e-9)) AS beta),
k AS (SELECT *, CAST(floor(2 / beta) AS BIGINT) + 3 AS k FROM n), i AS (SELECT unnest(range(1000)) AS i),
best AS (SELECT CAST(ceil(max(exp(-beta * (x.i + y.i)) * greatest((x.i + a) * (y.i + b), (x.i + 1) * (y.i + b), (x.i + 1) * (y.i + a)))) AS BIGINT) AS v FROM k, i AS x, i AS y WHERE x.i + y.i <= k)
SELECT 'ok' AS status, greatest(1, least(v, c)) AS value, v AS by_degrees, v AS by_counts, v AS by_relaxation, c AS ceiling, max_k
FROM (SELECT v, CAST(greatest(rs * rc, rn * rc, rn * rs) AS BIGINT) AS c, k AS max_k FROM best, k) AS z""")
def smooth_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    from grove.operators.sensitivity import smooth_sensitivity as smooth

    s = smooth(STAR, star_frames(spark, d), 4.0)
    return spark.createDataFrame([(s.status, s.value, s.by_degrees, s.by_counts, s.by_relaxation, s.ceiling, s.max_k)], "status string, value bigint, by_degrees bigint, by_counts bigint, by_relaxation bigint, ceiling bigint, max_k bigint")


# --- graphs ---------------------------------------------------------------------------------------------------------


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """From customers to the customers that their orders' numbers fall on: a node a customer, so the graph grows with the tables."""
    orders, n = t(spark, d, "orders", "o_orderkey", "o_custkey"), t(spark, d, "customer", "c_custkey").count()
    return graph.edges_of(orders.select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") * 7919 % n + 1).alias("b")), "a", "b")


_G = "g AS (SELECT DISTINCT CAST(o_custkey AS BIGINT) AS source, CAST(o_orderkey * 7919 % (SELECT count(*) FROM customer) + 1 AS BIGINT) AS target FROM orders)"


@query(f"WITH {_G} SELECT source, count(*) AS degree FROM g GROUP BY source")
def out_degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.out_degrees(_edges(spark, d))


@query(f"""
WITH {_G}, deg AS (SELECT source AS target, least(count(*), 4) AS reach FROM g GROUP BY source),
best AS (SELECT source, target, reach FROM (SELECT g.source, g.target, reach, row_number() OVER (PARTITION BY g.source ORDER BY reach DESC, g.target) AS rn FROM g JOIN deg USING (target)) AS x WHERE rn <= 6),
hubs AS (SELECT source FROM best GROUP BY source ORDER BY sum(reach * reach) DESC, source LIMIT 5),
top AS (SELECT source, target FROM best WHERE source IN (SELECT source FROM hubs)),
leaves AS (SELECT source, target FROM (SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY target) AS rn FROM g WHERE source IN (SELECT target FROM top)) AS y WHERE rn <= 4)
SELECT source, target FROM top UNION SELECT source, target FROM leaves""")
def hub_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.hub_edges(_edges(spark, d), 5, 6, 4)


@query(f"WITH {_G} SELECT source, target FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY target) AS rn FROM g) AS x WHERE rn <= 2")
def degree_aliases(spark: SparkSession, d: str) -> DataFrame:
    return graph.degree_aliases(_edges(spark, d), graph.mixed_degrees(3, 1))[2]


@query(f"""
WITH {_G}, n AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY l_suppkey), r AS (SELECT n, row_number() OVER (ORDER BY n) AS i FROM n)
SELECT count(*) AS n_keys, max(n) AS max_count, round(2 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*), 9) AS gini FROM r""")
def key_gini(spark: SparkSession, d: str) -> DataFrame:
    return graph.key_shape(t(spark, d, "lineitem"), "l_suppkey").withColumn("gini", F.round("gini", 9))


@query(f"""
WITH RECURSIVE {_G}, core(source, target, size, round) AS (
  SELECT source, target, CAST(-1 AS BIGINT), 0 FROM g
  UNION ALL
  SELECT x.source, x.target, x.size, x.round FROM (SELECT source, target, count(*) OVER (PARTITION BY source) AS d, count(*) OVER () AS size, size AS before, round + 1 AS round FROM core) AS x
    JOIN (SELECT source FROM core GROUP BY source HAVING count(*) >= 3) AS y ON x.target = y.source WHERE x.d >= 3 AND x.size <> x.before)
SELECT source, target FROM core WHERE round = (SELECT max(round) FROM core)""")
def kout_core(spark: SparkSession, d: str) -> DataFrame:
    return graph.kout_core(_edges(spark, d), 3)


@query(f"""
WITH RECURSIVE {_G}, n AS (SELECT source, target FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY target) AS rn FROM g) AS x WHERE rn <= 2),
nodes AS (SELECT source AS a FROM n UNION SELECT target FROM n),
reach(a, b) AS (SELECT a, a FROM nodes UNION SELECT reach.a, n.target FROM reach JOIN n ON reach.b = n.source),
named AS (SELECT x.a AS node, min(x.b) AS component FROM reach AS x JOIN reach AS y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
e AS (SELECT n.source, n.target, p.component AS c1, q.component AS c2 FROM n JOIN named AS p ON n.source = p.node JOIN named AS q ON n.target = q.node),
best AS (SELECT component FROM named WHERE component NOT IN (SELECT c1 FROM e WHERE c1 <> c2) GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)
SELECT source, target FROM e WHERE c1 = c2 AND c1 IN (SELECT component FROM best)""")
def sink_component(spark: SparkSession, d: str) -> DataFrame:
    return graph.sink_component(graph.degree_aliases(_edges(spark, d), [2])[0])


# --- changes, encryption, dialect ------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_nationkey FROM customer UNION ALL SELECT s_suppkey + 1000000, s_nationkey FROM supplier")
def insert_rows(spark: SparkSession, d: str) -> DataFrame:
    more = t(spark, d, "supplier").select((F.col("s_suppkey") + 1000000).alias("c_custkey"), F.col("s_nationkey").alias("c_nationkey"))
    return changes.inserted(t(spark, d, "customer", "c_custkey", "c_nationkey"), more)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def delete_rows(spark: SparkSession, d: str) -> DataFrame:
    keys = t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return changes.deleted(t(spark, d, "orders", "o_orderkey", "o_custkey"), keys, ["o_orderkey"])


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN upper(p_name) ELSE p_name END AS p_name, CASE WHEN p_size < 10 THEN NULL ELSE p_brand END AS p_brand FROM part")
def update_rows(spark: SparkSession, d: str) -> DataFrame:
    new = t(spark, d, "part").where("p_size < 10").select("p_partkey", F.upper("p_name").alias("p_name"), F.lit(None).cast("string").alias("p_brand"))
    return changes.updated(t(spark, d, "part", "p_partkey", "p_name", "p_brand"), new, ["p_partkey"], ["p_name", "p_brand"])


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def encrypted_round_trip(spark: SparkSession, d: str) -> DataFrame:
    key = b"0123456789abcdef"
    sealed = encryption.encrypted(t(spark, d, "supplier", "s_suppkey", "s_name", "s_acctbal"), ["s_name", "s_acctbal"], key)
    return encryption.decrypted(sealed, {"s_name": "string", "s_acctbal": "double"}, key)


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS k FROM orders WHERE o_custkey IN (1, 10, 100)")
def dialect_decode_and_coercion(spark: SparkSession, d: str) -> DataFrame:
    t(spark, d, "orders").createOrReplaceTempView("orders")
    return spark.sql("SELECT o_orderkey, decode(o_orderstatus, 'F', 1, 'O', 2, 0) AS k FROM orders WHERE o_custkey IN ('1', '10', '100')")


_SEALED = ["l_quantity", "l_discount", "l_tax"]


@query("""
SELECT l_returnflag, round(sum(l_quantity * (1 - l_discount)), 4) AS net, CAST(sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS BIGINT) AS large, round(max(l_tax) - min(l_tax), 6) AS spread
FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.06 GROUP BY l_returnflag""")
def encrypted_operations(spark: SparkSession, d: str) -> DataFrame:
    """Comparison, arithmetic and aggregates over sealed columns, opened inside the expressions."""
    key = b"0123456789abcdef"
    sealed = encryption.encrypted(t(spark, d, "lineitem", "l_returnflag", *_SEALED), _SEALED, key)
    quantity, discount, tax = (encryption.opened(c, "double", key) for c in _SEALED)
    rows = sealed.where(discount.between(0.02, 0.06)).groupBy("l_returnflag")
    return rows.agg(F.round(F.sum(quantity * (1 - discount)), 4).alias("net"), F.sum((quantity > 25).cast("long")).alias("large"), F.round(F.max(tax) - F.min(tax), 6).alias("spread"))


def _text_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: sqlcorpus.run(spark, d, text)


QUERIES |= {name: _text_query(text) for name, text in TEXTS.items()}
QUERIES |= workload_queries.QUERIES
ORACLE_SQL |= workload_queries.ORACLE_SQL
