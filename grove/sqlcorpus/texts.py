"""SQL texts over the fixture tables: one for each construct of the decision-support corpora. They run unchanged elsewhere."""

from __future__ import annotations

TEXTS = {
    "sql_pricing_summary": """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue,
  round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= CAST('1998-12-01' AS TIMESTAMP) - INTERVAL '90' DAY GROUP BY l_returnflag, l_linestatus""",
    "sql_shipping_priority": """
SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, o_orderdate
FROM customer, orders, lineitem
WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < TIMESTAMP '1997-03-15' AND l_shipdate > TIMESTAMP '1997-03-15'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey, o_orderdate LIMIT 10""",
    "sql_local_supplier_volume": """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
FROM customer, orders, lineitem, supplier, nation, region
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey
  AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' GROUP BY n_name""",
    "sql_forecast_revenue": """
SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-01-01' + INTERVAL '1' YEAR AND l_discount BETWEEN 0.02 AND 0.06 AND l_quantity < 24""",
    "sql_volume_shipping": """
SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(extract(year FROM l_shipdate) AS BIGINT) AS l_year, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
FROM supplier, lineitem, orders, customer, nation n1, nation n2
WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
  AND ((n1.n_nationkey = 6 AND n2.n_nationkey = 7) OR (n1.n_nationkey = 7 AND n2.n_nationkey = 6))
GROUP BY n1.n_name, n2.n_name, extract(year FROM l_shipdate)""",
    "sql_market_share": """
SELECT o_year, round(sum(CASE WHEN nk = 6 THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share
FROM (SELECT CAST(extract(year FROM o_orderdate) AS BIGINT) AS o_year, l_extendedprice * (1 - l_discount) AS volume, n2.n_nationkey AS nk
  FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region
  WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey
    AND n1.n_regionkey = r_regionkey AND r_regionkey = 1 AND s_nationkey = n2.n_nationkey) AS all_nations
GROUP BY o_year""",
    "sql_product_profit": """
SELECT n_name AS nation, CAST(extract(year FROM o_orderdate) AS BIGINT) AS o_year, round(sum(l_extendedprice * (1 - l_discount) - 0.5 * l_quantity), 4) AS profit
FROM part, supplier, lineitem, orders, nation
WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_name LIKE '%small%'
GROUP BY n_name, extract(year FROM o_orderdate)""",
    "sql_returned_items": """
SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, c_acctbal
FROM customer, orders, lineitem
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_returnflag = 'R' AND o_orderdate >= TIMESTAMP '1996-10-01' AND o_orderdate < TIMESTAMP '1996-10-01' + INTERVAL '3' MONTH
GROUP BY c_custkey, c_name, c_acctbal ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "sql_priority_by_mode": """
SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high,
  CAST(sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low
FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_returnflag IN ('A', 'N') GROUP BY l_linestatus""",
    "sql_left_outer_count": """
SELECT c_count, count(*) AS custdist
FROM (SELECT c_custkey, count(o_orderkey) FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%' GROUP BY c_custkey) AS c_orders (c_custkey, c_count)
GROUP BY c_count""",
    "sql_promotion_effect": """
SELECT round(100.00 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue
FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '1997-09-01' AND l_shipdate < TIMESTAMP '1997-09-01' + INTERVAL '1' MONTH""",
    "sql_top_supplier_cte": """
WITH revenue (supplier_no, total_revenue) AS (
  SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 4) FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue FROM supplier, revenue WHERE s_suppkey = supplier_no AND total_revenue = (SELECT max(total_revenue) FROM revenue)""",
    "sql_count_distinct_not_in": """
SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt
FROM lineitem, part
WHERE p_partkey = l_partkey AND p_brand <> 'Brand#45' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (1, 9, 14, 19, 23)
  AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size""",
    "sql_small_quantity_scalar_corr": """
SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem, part
WHERE p_partkey = l_partkey AND p_size < 10 AND l_quantity < (SELECT 0.4 * avg(l2.l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)""",
    "sql_large_orders_in_having": """
SELECT c_custkey, o_orderkey, round(sum(l_quantity), 2) AS total_qty FROM customer, orders, lineitem
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) AND c_custkey = o_custkey AND o_orderkey = l_orderkey
GROUP BY c_custkey, o_orderkey""",
    "sql_theta_or": """
SELECT round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem, part
WHERE p_partkey = l_partkey AND ((p_size BETWEEN 1 AND 5 AND l_quantity BETWEEN 1 AND 11) OR (p_size BETWEEN 6 AND 10 AND l_quantity BETWEEN 10 AND 20) OR (p_size BETWEEN 11 AND 15 AND l_quantity BETWEEN 20 AND 30))""",
    "sql_exists": """
SELECT o_orderpriority, count(*) AS order_count FROM orders
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY o_orderpriority""",
    "sql_not_exists": """
SELECT s_name, count(*) AS numwait FROM supplier, lineitem l1, orders
WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F'
  AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
  AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R') GROUP BY s_name""",
    "sql_not_exists_substring": """
SELECT cntry, count(*) AS numcust, round(sum(bal), 2) AS totacctbal
FROM (SELECT substring(c_name FROM 1 FOR 10) AS cntry, c_acctbal AS bal FROM customer
  WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0.00) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')) AS custsale
GROUP BY cntry""",
    "sql_full_outer": """
SELECT CAST(sum(CASE WHEN a.k IS NOT NULL AND b.k IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS only_a, CAST(sum(CASE WHEN a.k IS NULL AND b.k IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS only_b,
  CAST(sum(CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS in_both
FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') a FULL OUTER JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O') b ON a.k = b.k""",
    "sql_count_star_having": "SELECT c_nationkey, count(*) AS n, max(c_acctbal) AS top, min(c_acctbal) AS low FROM customer GROUP BY c_nationkey HAVING count(*) > 10",
    "sql_distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "sql_stddev": "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_samp(l_quantity) / avg(l_quantity), 6) AS cov FROM lineitem GROUP BY l_returnflag",
    "sql_rollup_grouping": """
SELECT n_regionkey, n_name, CAST(grouping(n_regionkey) AS INT) AS g1, CAST(grouping(n_name) AS INT) AS g2, round(sum(c_acctbal), 2) AS bal
FROM customer, nation WHERE c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_name)""",
    "sql_rank_rollup": """
SELECT regionkey, name, bal, lochierarchy, CAST(rank() OVER (PARTITION BY lochierarchy, CASE WHEN lochierarchy = 0 THEN regionkey END ORDER BY bal DESC NULLS LAST) AS INT) AS rank_within_parent
FROM (SELECT n_regionkey AS regionkey, n_name AS name, round(sum(c_acctbal), 2) AS bal, CAST(grouping(n_regionkey) AS INT) + CAST(grouping(n_name) AS INT) AS lochierarchy
  FROM customer, nation WHERE c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_name)) AS t""",
    "sql_agg_over_agg": """
SELECT p_brand, p_type, round(sum(l_extendedprice), 2) AS revenue, round(sum(l_extendedprice) * 100 / sum(sum(l_extendedprice)) OVER (PARTITION BY p_brand), 6) AS ratio
FROM lineitem, part WHERE l_partkey = p_partkey GROUP BY p_brand, p_type""",
    "sql_avg_over_abs": """
SELECT brand, y, m, sales FROM (
  SELECT p_brand AS brand, CAST(extract(year FROM l_shipdate) AS BIGINT) AS y, CAST(extract(month FROM l_shipdate) AS BIGINT) AS m, round(sum(l_extendedprice), 2) AS sales,
    avg(sum(l_extendedprice)) OVER (PARTITION BY p_brand, extract(year FROM l_shipdate)) AS avg_sales
  FROM lineitem, part WHERE l_partkey = p_partkey GROUP BY p_brand, extract(year FROM l_shipdate), extract(month FROM l_shipdate)) AS t
WHERE avg_sales > 0 AND abs(sales - avg_sales) / avg_sales > 0.1""",
    "sql_running_sum": """
SELECT o_custkey, CAST(d AS STRING) AS d, CAST(sum(n) OVER (PARTITION BY o_custkey ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cume
FROM (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY o_custkey, CAST(o_orderdate AS DATE)) AS t""",
    "sql_max_over_frame": """
SELECT user_id, event_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM events""",
    "sql_union_all": "SELECT 'c' AS kind, c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey UNION ALL SELECT 's' AS kind, s_nationkey AS k, count(*) AS n FROM supplier GROUP BY s_nationkey",
    "sql_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier",
    "sql_intersect": "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'",
    "sql_except": "SELECT o_custkey AS k FROM orders EXCEPT SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'",
    "sql_scalar_uncorrelated": "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > (SELECT 1.2 * avg(c_acctbal) FROM customer)",
    "sql_scalar_case": """
SELECT CASE WHEN (SELECT count(*) FROM lineitem WHERE l_quantity BETWEEN 1 AND 20) > 1000 THEN (SELECT round(avg(l_discount), 6) FROM lineitem WHERE l_quantity BETWEEN 1 AND 20)
  ELSE (SELECT round(avg(l_tax), 6) FROM lineitem WHERE l_quantity BETWEEN 1 AND 20) END AS bucket1""",
    "sql_cross_cte": """
WITH a AS (SELECT count(*) AS am FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')), b AS (SELECT count(*) AS pm FROM orders WHERE o_orderpriority = '5-LOW')
SELECT round(CAST(am AS DOUBLE) / CAST(pm AS DOUBLE), 6) AS ratio FROM a, b""",
    "sql_dates": """
SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d, CAST(CAST(o_orderdate + INTERVAL '30' DAY AS DATE) AS STRING) AS d30,
  CAST(CAST(o_orderdate - INTERVAL '3' MONTH AS DATE) AS STRING) AS m3, CAST(date_part('year', o_orderdate) AS BIGINT) AS y, CAST(o_orderdate::DATE AS STRING) AS d2 FROM orders""",
    "sql_strings": """
SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, substr(p_name, 1, 3) AS s, p_brand || '/' || p_type AS c, concat(p_brand, p_type) AS cc, length(p_name) AS n,
  CASE WHEN p_name LIKE 'small%' THEN 1 WHEN p_name NOT LIKE '%ring' THEN 2 ELSE 3 END AS k FROM part""",
    "sql_casts": "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS qi, CAST(CAST(l_extendedprice AS DECIMAL(15, 2)) AS DOUBLE) AS price, l_linenumber::BIGINT AS ln FROM lineitem",
    "sql_numbers": "SELECT p_partkey, abs(p_size - 25) AS a, round(p_retailprice / 3, 2) AS r, CAST(floor(p_retailprice) AS BIGINT) AS f, p_size % 7 AS m FROM part",
    "sql_coalesce_is_null": """
SELECT c_custkey, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'none' ELSE 'some' END AS has
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey) AS o ON c_custkey = o_custkey""",
    "sql_pivot_case": """
SELECT o_custkey, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS f, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END), 2) AS o,
  CAST(sum(CASE WHEN o_orderpriority IS NOT NULL AND o_totalprice BETWEEN 1000 AND 100000 THEN 1 ELSE 0 END) AS BIGINT) AS mid FROM orders GROUP BY o_custkey""",
    "sql_order_nulls": """
SELECT k, n FROM (SELECT c_nationkey AS k, CASE WHEN count(*) > 60 THEN NULL ELSE count(*) END AS n FROM customer GROUP BY c_nationkey) AS t ORDER BY n ASC NULLS LAST, k LIMIT 12""",
    "sql_explicit_join_on": "SELECT n_name, r_name, count(s_suppkey) AS n FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name, r_name",
    "sql_self_join": "SELECT a.o_custkey AS k, count(*) AS pairs FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey GROUP BY a.o_custkey",
    "sql_rollup_by_levels": """
WITH x AS (SELECT r_name, n_name, s_suppkey, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT r_name, n_name, round(avg(s_acctbal), 4) AS bal, count(*) AS n FROM x GROUP BY r_name, n_name
UNION ALL SELECT r_name, NULL AS n_name, round(avg(s_acctbal), 4) AS bal, count(*) AS n FROM x GROUP BY r_name
UNION ALL SELECT NULL AS r_name, NULL AS n_name, round(avg(s_acctbal), 4) AS bal, count(*) AS n FROM x""",
    "sql_date_difference": """
SELECT l_returnflag, CAST(sum(CASE WHEN CAST(CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) AS INT) <= 30 THEN 1 ELSE 0 END) AS BIGINT) AS d30,
  CAST(sum(CASE WHEN CAST(CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) AS INT) > 30 AND CAST(CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) AS INT) <= 60 THEN 1 ELSE 0 END) AS BIGINT) AS d60,
  max(CAST(CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) AS INT)) AS longest
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_returnflag""",
    "sql_numeric_strings": "SELECT l_returnflag, round(sum(l_extendedprice * ('1' - l_discount)), 4) AS revenue, count(*) AS n FROM lineitem WHERE l_quantity < '24' GROUP BY l_returnflag",
    "sql_random": "SELECT count(*) AS n, CAST(sum(CASE WHEN k BETWEEN 0 AND 9 THEN 1 ELSE 0 END) AS BIGINT) AS inside FROM (SELECT c_custkey, floor(random() * 10) AS k FROM customer WHERE random() >= 0) AS x",
    "sql_scalar_operations": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice + l_quantity - l_tax * 3 / 7, 6) AS a, round(-(l_quantity - 25) * (l_quantity - 25), 6) AS b, l_partkey % 11 + l_suppkey % 7 AS c,
  l_quantity + 1 > 20 AS d, NOT (l_discount = 0.05 OR l_tax <> 0.02) AS e, l_partkey - l_suppkey <= 0 AND l_linenumber >= 3 AS f, round(abs(l_discount - l_tax) / (1 + l_tax), 6) AS g FROM lineitem""",
}
