"""The query catalogue: dialect text that the engine runs over the driver's tables, and oracle SQL for the same rows.

An entry is the dialect text, or (dialect text, oracle text) where the two differ. Texts with several
statements work on tables of their own, made from the driver's; their last statement is the result.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillsql.engine import Engine

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
PARAMS = {"segment": "BUILDING", "floor": 5000.0}
POSITIONAL = [40, "F", "F"]

QUERIES: dict[str, str | tuple[str, str]] = {
    # scans and filters
    "pricing_summary": """SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice), 2) AS sum_price,
        ROUND(AVG(l_extendedprice), 2) AS avg_price, ROUND(AVG(l_discount), 4) AS avg_disc, COUNT(*) AS n
        FROM lineitem WHERE l_shipdate <= '2001-01-01' GROUP BY l_returnflag, l_linestatus""",
    "scan_full": "SELECT * FROM region",
    "scan_project": "SELECT n_name, n_regionkey FROM nation",
    "pk_lookup": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 42",
    "pk_range": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 200",
    "pk_range_conjuncts": "SELECT o_orderkey FROM orders WHERE o_orderkey > 10 AND o_orderkey <= 60 AND o_orderkey > 20 AND 50 >= o_orderkey",
    "pk_in_dups": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (1, 2, 2, 3, 7, 7)",
    "composite_key": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 10 AND l_linenumber >= 1 AND l_linenumber < 5",
    "count_star": "SELECT COUNT(*) AS n FROM lineitem",
    "count_range": "SELECT COUNT(*) AS n FROM lineitem WHERE l_quantity BETWEEN 10 AND 20",
    "count_selective": "SELECT COUNT(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING'",
    "filter_and_or_not": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag = 'R' OR l_linestatus = 'O') AND NOT (l_quantity > 10) AND l_discount > 0.05",
    "filter_between": "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 15 AND p_retailprice NOT BETWEEN 1000 AND 1500",
    "filter_in": "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)",
    "filter_isnull": "SELECT c_custkey FROM customer WHERE NULLIF(c_mktsegment, 'BUILDING') IS NULL",
    "filter_notnull": ("SELECT c_custkey FROM customer WHERE NULLIF(c_mktsegment, 'BUILDING') NOTNULL", "SELECT c_custkey FROM customer WHERE NULLIF(c_mktsegment, 'BUILDING') IS NOT NULL"),
    "filter_is_distinct": (
        "SELECT c_custkey FROM customer WHERE NULLIF(c_mktsegment, 'BUILDING') IS NOT 'MACHINERY'",
        "SELECT c_custkey FROM customer WHERE NULLIF(c_mktsegment, 'BUILDING') IS DISTINCT FROM 'MACHINERY'",
    ),
    "filter_is_value": (
        "SELECT c_custkey FROM customer WHERE NULLIF(c_mktsegment, 'BUILDING') IS NULLIF('BUILDING', 'BUILDING')",
        "SELECT c_custkey FROM customer WHERE NULLIF(c_mktsegment, 'BUILDING') IS NOT DISTINCT FROM NULL",
    ),
    "filter_like": ("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%RING%' AND p_type LIKE 'e%'", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RING%' AND p_type ILIKE 'e%'"),
    "filter_not_like": ("SELECT p_partkey FROM part WHERE p_brand NOT LIKE 'BRAND#1_'", "SELECT p_partkey FROM part WHERE p_brand NOT ILIKE 'BRAND#1_'"),
    "filter_like_escape": ("SELECT c_custkey FROM customer WHERE c_name LIKE 'customer!#%' ESCAPE '!'", "SELECT c_custkey FROM customer WHERE c_name ILIKE 'customer!#%' ESCAPE '!'"),
    "filter_glob": ("SELECT p_partkey FROM part WHERE p_brand GLOB 'Brand#[1-3]?'", "SELECT p_partkey FROM part WHERE regexp_full_match(p_brand, 'Brand#[1-3].')"),
    "filter_regexp": ("SELECT p_partkey FROM part WHERE p_type REGEXP '^[A-P].*O'", "SELECT p_partkey FROM part WHERE regexp_matches(p_type, '^[A-P].*O')"),
    "filter_truthiness": ("SELECT n_nationkey FROM nation WHERE n_nationkey % 3 AND NOT n_regionkey", "SELECT n_nationkey FROM nation WHERE n_nationkey % 3 <> 0 AND NOT (n_regionkey <> 0)"),
    "filter_in_empty": ("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN ()", "SELECT n_nationkey FROM nation"),
    # expressions
    "arith_int_div_mod": (
        "SELECT l_orderkey, l_linenumber, l_orderkey / 7 AS q, l_orderkey % 7 AS r, -l_orderkey / 7 AS nq, l_quantity / 7 AS d, l_linenumber * 2 + 1 AS m FROM lineitem",
        "SELECT l_orderkey, l_linenumber, l_orderkey // 7 AS q, l_orderkey % 7 AS r, -l_orderkey // 7 AS nq, l_quantity / 7 AS d, CAST(l_linenumber * 2 + 1 AS BIGINT) AS m FROM lineitem",
    ),
    "arith_div_zero_null": (
        "SELECT n_nationkey, 10 / n_regionkey AS a, 10 % n_regionkey AS b, 10.0 / n_regionkey AS c FROM nation",
        "SELECT n_nationkey, CAST(10 // NULLIF(n_regionkey, 0) AS BIGINT) AS a, CAST(10 % NULLIF(n_regionkey, 0) AS BIGINT) AS b, CAST(10.0 AS DOUBLE) / NULLIF(n_regionkey, 0) AS c FROM nation",
    ),
    "bitwise_ops": (
        "SELECT n_nationkey, n_nationkey & 6 AS a, n_nationkey | 8 AS o, n_nationkey << 2 AS l, n_nationkey >> 1 AS r, ~n_nationkey AS i FROM nation",
        "SELECT n_nationkey, CAST(n_nationkey & 6 AS BIGINT) AS a, CAST(n_nationkey | 8 AS BIGINT) AS o, CAST(n_nationkey << 2 AS BIGINT) AS l, CAST(n_nationkey >> 1 AS BIGINT) AS r, CAST(~n_nationkey AS BIGINT) AS i FROM nation",
    ),
    "concat_pipe": "SELECT n_name || '/' || n_nationkey AS label FROM nation",
    "case_simple": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'other' END AS s FROM orders",
    "case_searched": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band FROM customer",
    "cast_ops": (
        "SELECT p_partkey, CAST(p_retailprice AS INTEGER) AS i, CAST(p_size AS TEXT) AS s, CAST('42abc' AS INTEGER) AS x, CAST(p_size AS REAL) AS r FROM part",
        "SELECT p_partkey, CAST(trunc(p_retailprice) AS BIGINT) AS i, CAST(p_size AS VARCHAR) AS s, CAST(42 AS BIGINT) AS x, CAST(p_size AS DOUBLE) AS r FROM part",
    ),
    "text_number_coercion": (
        "SELECT n_nationkey FROM nation WHERE n_nationkey < '10' AND '3' + 4 = 7 AND n_name > 5",
        "SELECT n_nationkey FROM nation WHERE n_nationkey < 10 AND n_name > '5'",
    ),
    "comparison_as_number": ("SELECT n_nationkey, n_nationkey > 10 AS big, n_regionkey = 1 AS one FROM nation", "SELECT n_nationkey, CAST(n_nationkey > 10 AS INTEGER) AS big, CAST(n_regionkey = 1 AS INTEGER) AS one FROM nation"),
    "collate_nocase": ("SELECT c_custkey FROM customer WHERE c_mktsegment = 'building' COLLATE NOCASE", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'"),
    "param_named": ("SELECT c_custkey FROM customer WHERE c_mktsegment = :segment AND c_acctbal > @floor", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000.0"),
    "literals": ("SELECT 1 AS i, 2.5 AS r, 'x''y' AS s, NULL IS NULL AS n, 0x1F AS h, TRUE AS t", "SELECT 1 AS i, CAST(2.5 AS DOUBLE) AS r, 'x''y' AS s, 1 AS n, 31 AS h, 1 AS t"),
    # joins
    "join_inner": "SELECT c_name, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 300000",
    "join_left": "SELECT p_partkey, l_orderkey FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 49",
    "join_cross_filtered": "SELECT r_name, n_name FROM region CROSS JOIN nation WHERE r_regionkey = n_regionkey",
    "join_comma_where": "SELECT c_custkey, n_name FROM customer, nation WHERE c_nationkey = n_nationkey AND c_acctbal > 9000",
    "join_using": "SELECT o_orderkey, cnt FROM orders JOIN (SELECT l_orderkey AS o_orderkey, COUNT(*) AS cnt FROM lineitem GROUP BY l_orderkey) x USING (o_orderkey) WHERE cnt > 5",
    "join_natural": "SELECT n_nationkey, n_name, extra FROM nation NATURAL JOIN (SELECT n_nationkey, CAST(n_regionkey * 10 AS BIGINT) AS extra FROM nation WHERE n_regionkey > 1) y",
    "join_theta": "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_acctbal < b.s_acctbal AND b.s_acctbal - a.s_acctbal < 20",
    "join_self": "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_chain4": "SELECT s_suppkey, COUNT(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_mktsegment = 'BUILDING' GROUP BY s_suppkey",
    "join_expr_key": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1",
    "join_residual_on": "SELECT COUNT(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate > o_orderdate AND l_quantity * 2 > 50",
    "join_derived": "SELECT c_custkey, total FROM customer JOIN (SELECT o_custkey, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey) t ON o_custkey = c_custkey WHERE total > 2000000",
    "join_count_star": "SELECT COUNT(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey",
    "join_right_full": "SELECT r_name, n_name FROM (SELECT * FROM region WHERE r_regionkey < 3) r FULL JOIN (SELECT * FROM nation WHERE n_regionkey > 1) n ON r_regionkey = n_regionkey",
    "semi_exists": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    "semi_in": "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)",
    "anti_not_exists": "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 40)",
    "anti_not_in": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)",
    # subqueries
    "scalar_subquery": "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM customer)",
    "scalar_subquery_empty": "SELECT r_name, (SELECT n_name FROM nation WHERE n_nationkey = 999) AS missing FROM region",
    "scalar_subquery_ordered": "SELECT r_name, (SELECT MAX(n_name) FROM nation WHERE n_regionkey = r_regionkey) AS last_name FROM region",
    "corr_count": "SELECT c_custkey, (SELECT COUNT(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer",
    "corr_nonequi_count": "SELECT s_suppkey, (SELECT COUNT(*) FROM supplier b WHERE b.s_acctbal > a.s_acctbal) AS richer FROM supplier a",
    "corr_avg_filter": "SELECT l_orderkey, l_linenumber FROM lineitem a WHERE l_quantity > (SELECT AVG(l_quantity) * 1.8 FROM lineitem b WHERE b.l_partkey = a.l_partkey)",
    "corr_max_equal": "SELECT o_custkey, o_orderkey FROM orders a WHERE o_totalprice = (SELECT MAX(o_totalprice) FROM orders b WHERE b.o_custkey = a.o_custkey)",
    "corr_exists_two_level": "SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey AND EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000))",
    "derived_table": "SELECT seg, n FROM (SELECT c_mktsegment AS seg, COUNT(*) AS n FROM customer GROUP BY c_mktsegment) d WHERE n > 100",
    "subquery_in_select_bool": ("SELECT r_regionkey, EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey > 20) AS has FROM region", "SELECT r_regionkey, CAST(EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey > 20) AS INTEGER) AS has FROM region"),
    # aggregates
    "agg_global": "SELECT COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS s, ROUND(AVG(o_totalprice), 2) AS a, MIN(o_orderkey) AS lo, MAX(o_orderkey) AS hi FROM orders",
    "agg_global_empty": "SELECT COUNT(*) AS n, SUM(o_totalprice) AS s, MIN(o_orderkey) AS lo FROM orders WHERE o_orderkey < 0",
    "agg_group": "SELECT o_orderstatus, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS s FROM orders GROUP BY o_orderstatus",
    "agg_group_expr_alias": ("SELECT o_orderkey / 1000 AS bucket, COUNT(*) AS n FROM orders GROUP BY bucket", "SELECT o_orderkey // 1000 AS bucket, COUNT(*) AS n FROM orders GROUP BY 1"),
    "agg_group_ordinal": "SELECT p_brand, p_size, COUNT(*) AS n FROM part GROUP BY 1, 2",
    "agg_having": "SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey HAVING COUNT(*) > 55 AND AVG(c_acctbal) > 0",
    "agg_distinct": "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS s, CAST(SUM(DISTINCT l_linenumber) AS BIGINT) AS t, ROUND(AVG(DISTINCT l_discount), 4) AS d FROM lineitem GROUP BY l_returnflag",
    "agg_total": ("SELECT TOTAL(NULLIF(c_custkey, c_custkey)) AS z, TOTAL(c_custkey) AS t FROM customer", "SELECT CAST(0 AS DOUBLE) AS z, CAST(SUM(c_custkey) AS DOUBLE) AS t FROM customer"),
    "agg_group_concat_ordered": ("SELECT n_regionkey, GROUP_CONCAT(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, STRING_AGG(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "agg_string_agg": "SELECT n_regionkey, STRING_AGG(n_name, ', ' ORDER BY n_nationkey DESC) AS names FROM nation GROUP BY n_regionkey",
    "agg_min_max_text": "SELECT MIN(c_name) AS a, MAX(c_name) AS z, MIN(c_mktsegment) AS m FROM customer",
    "agg_bare_max": ("SELECT n_regionkey, MAX(n_nationkey) AS hi, n_name FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, MAX(n_nationkey) AS hi, arg_max(n_name, n_nationkey) AS n_name FROM nation GROUP BY n_regionkey"),
    "agg_json_group_array": ("SELECT n_regionkey, JSON_GROUP_ARRAY(n_nationkey ORDER BY n_nationkey) AS keys FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, '[' || STRING_AGG(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) || ']' AS keys FROM nation GROUP BY n_regionkey"),
    "agg_json_group_object": (
        "SELECT r, JSON_GROUP_OBJECT(k, v) AS o FROM (SELECT n_regionkey AS r, MIN(n_name) AS k, MIN(n_nationkey) AS v FROM nation GROUP BY n_regionkey) x GROUP BY r",
        "SELECT n_regionkey AS r, '{\"' || MIN(n_name) || '\":' || MIN(n_nationkey) || '}' AS o FROM nation GROUP BY n_regionkey",
    ),
    "agg_in_expression": ("SELECT l_returnflag, ROUND(SUM(l_extendedprice) / COUNT(*), 2) AS mean, MAX(l_linenumber) - MIN(l_linenumber) AS span FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, ROUND(SUM(l_extendedprice) / COUNT(*), 2) AS mean, CAST(MAX(l_linenumber) - MIN(l_linenumber) AS BIGINT) AS span FROM lineitem GROUP BY l_returnflag"),
    "agg_filter": "SELECT o_orderstatus, COUNT(*) FILTER (WHERE o_totalprice > 200000) AS big FROM orders GROUP BY o_orderstatus",
    "agg_order_by_aggregate": "SELECT c_nationkey FROM customer GROUP BY c_nationkey ORDER BY COUNT(*) DESC, c_nationkey LIMIT 5",
    # windows
    "win_row_number": "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders",
    "win_rank_dense": "SELECT l_orderkey, l_linenumber, RANK() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS r, DENSE_RANK() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS d FROM lineitem",
    "win_percent_cume": "SELECT s_suppkey, ROUND(PERCENT_RANK() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal), 6) AS p, ROUND(CUME_DIST() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal), 6) AS c FROM supplier",
    "win_ntile": "SELECT s_suppkey, NTILE(4) OVER (ORDER BY s_acctbal, s_suppkey) AS q FROM supplier",
    "win_lag_lead_default": "SELECT o_orderkey, LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p, LEAD(o_orderkey, 2, -1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS x FROM orders",
    "win_lag_dynamic": "SELECT n_nationkey, LAG(n_name, n_regionkey, 'none') OVER (ORDER BY n_nationkey) AS p FROM nation",
    "win_first_last_nth": "SELECT n_nationkey, FIRST_VALUE(n_name) OVER w AS f, LAST_VALUE(n_name) OVER w AS l, NTH_VALUE(n_name, 2) OVER w AS s FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "win_running_sum": "SELECT o_orderkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2) AS run FROM orders",
    "win_partition_total": "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey) AS n FROM orders",
    "win_rows_frame": "SELECT o_orderkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS a FROM orders",
    "win_rows_unbounded_short": "SELECT n_nationkey, COUNT(*) OVER (ORDER BY n_nationkey ROWS UNBOUNDED PRECEDING) AS n FROM nation",
    "win_rows_empty_frame": "SELECT n_nationkey, COUNT(*) OVER (ORDER BY n_nationkey ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING) AS n FROM nation",
    "win_range_frame": "SELECT p_partkey, COUNT(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 1 FOLLOWING) AS n FROM part",
    "win_groups_frame": "SELECT n_nationkey, COUNT(*) OVER (ORDER BY n_regionkey GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM nation",
    "win_count_distinct": ("SELECT l_orderkey, l_linenumber, COUNT(DISTINCT l_returnflag) OVER (PARTITION BY l_orderkey) AS n FROM lineitem", "SELECT l_orderkey, l_linenumber, COUNT(DISTINCT l_returnflag) OVER (PARTITION BY l_orderkey) AS n FROM lineitem"),
    "win_in_expression": ("SELECT n_nationkey, CASE WHEN ROW_NUMBER() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) = 1 THEN 'first' ELSE 'later' END AS s FROM nation", "SELECT n_nationkey, CASE WHEN ROW_NUMBER() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) = 1 THEN 'first' ELSE 'later' END AS s FROM nation"),
    "win_over_group": "SELECT c_mktsegment, COUNT(*) AS n, CAST(SUM(COUNT(*)) OVER (ORDER BY c_mktsegment) AS BIGINT) AS run FROM customer GROUP BY c_mktsegment",
    "win_order_by_result": "SELECT s_suppkey, RANK() OVER (ORDER BY s_acctbal DESC) AS r FROM supplier ORDER BY r, s_suppkey LIMIT 10",
    "win_null_order_key": ("SELECT n_nationkey, ROW_NUMBER() OVER (ORDER BY NULLIF(n_regionkey, 2), n_nationkey) AS rn FROM nation", "SELECT n_nationkey, ROW_NUMBER() OVER (ORDER BY NULLIF(n_regionkey, 2) NULLS FIRST, n_nationkey) AS rn FROM nation"),
    # distinct, order, limit, set operations
    "order_expr_alias_ordinal": "SELECT n_nationkey AS k, n_name FROM nation ORDER BY n_regionkey * -1, k DESC, 2 LIMIT 7",
    "order_nulls": "SELECT n_nationkey, NULLIF(n_regionkey, 1) AS r FROM nation ORDER BY r NULLS LAST, n_nationkey LIMIT 8",
    "order_nulls_default": ("SELECT n_nationkey, NULLIF(n_regionkey, 1) AS r FROM nation ORDER BY r, n_nationkey LIMIT 8", "SELECT n_nationkey, NULLIF(n_regionkey, 1) AS r FROM nation ORDER BY r NULLS FIRST, n_nationkey LIMIT 8"),
    "order_nocase": ("SELECT c_custkey FROM customer ORDER BY c_mktsegment COLLATE NOCASE, c_custkey LIMIT 9", "SELECT c_custkey FROM customer ORDER BY lower(c_mktsegment), c_custkey LIMIT 9"),
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "limit_offset": "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 10 OFFSET 25",
    "limit_comma": ("SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 25, 10", "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 10 OFFSET 25"),
    "limit_negative": ("SELECT r_name FROM region LIMIT -1", "SELECT r_name FROM region"),
    "distinct_rows": "SELECT DISTINCT p_brand, p_size FROM part",
    "union_all": "SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer",
    "union_distinct": "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer",
    "intersect": "SELECT l_suppkey AS k FROM lineitem WHERE l_quantity = 1 INTERSECT SELECT l_suppkey FROM lineitem WHERE l_quantity = 50",
    "except": "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 48",
    "setop_chain": ("SELECT 1 AS x UNION SELECT 2 INTERSECT SELECT 2 UNION ALL SELECT 5", "(SELECT 2 AS x) UNION ALL SELECT 5"),
    "setop_order_limit": "SELECT n_name AS x FROM nation UNION SELECT r_name FROM region ORDER BY x DESC LIMIT 6",
    "values_clause": ("VALUES (1, 'a'), (2, 'b'), (3, NULL)", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(column1, column2)"),
    # common table expressions and views
    "cte_simple": "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 300000) SELECT o_custkey, COUNT(*) AS n FROM big GROUP BY o_custkey",
    "cte_columns": "WITH x(a, b) AS (SELECT n_nationkey, n_name FROM nation) SELECT a, b FROM x WHERE a < 5",
    "cte_chained": "WITH a AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 5000), b AS (SELECT c_nationkey, COUNT(*) AS n FROM a GROUP BY c_nationkey) SELECT * FROM b WHERE n > 20",
    "cte_in_join": "WITH t AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) SELECT c_name, n FROM customer JOIN t ON o_custkey = c_custkey WHERE n > 15",
    "cte_recursive_counter": ("WITH RECURSIVE r(x) AS (SELECT 1 UNION ALL SELECT x + 1 FROM r WHERE x < 200) SELECT COUNT(*) AS n, CAST(SUM(x) AS BIGINT) AS s FROM r", "SELECT CAST(200 AS BIGINT) AS n, CAST(20100 AS BIGINT) AS s"),
    "cte_recursive_hierarchy": ("WITH RECURSIVE h(k, d) AS (SELECT n_nationkey, 0 FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n_nationkey, d + 1 FROM nation JOIN h ON (n_nationkey - 1) / 2 = k AND n_nationkey > 0) SELECT CAST(k AS BIGINT) AS k, CAST(d AS BIGINT) AS d FROM h", "WITH RECURSIVE h(k, d) AS (SELECT n_nationkey, 0 FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n_nationkey, d + 1 FROM nation JOIN h ON (n_nationkey - 1) // 2 = k AND n_nationkey > 0) SELECT CAST(k AS BIGINT) AS k, CAST(d AS BIGINT) AS d FROM h"),
    "cte_recursive_union_dedup": ("WITH RECURSIVE r(x) AS (SELECT 1 UNION SELECT (x + 2) % 7 FROM r) SELECT CAST(x AS BIGINT) AS x FROM r", "SELECT CAST(range AS BIGINT) AS x FROM range(0, 7)"),
    "view_simple": ("CREATE VIEW v AS SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = 1; SELECT * FROM v", "SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = 1"),
    "view_columns": ("CREATE VIEW v(region_key, total) AS SELECT n_regionkey, COUNT(*) FROM nation GROUP BY n_regionkey; SELECT * FROM v WHERE total >= 5", "SELECT n_regionkey AS region_key, COUNT(*) AS total FROM nation GROUP BY n_regionkey HAVING COUNT(*) >= 5"),
    "view_nested": (
        "CREATE VIEW a AS SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 0; CREATE VIEW b AS SELECT c_nationkey, COUNT(*) AS n FROM a GROUP BY c_nationkey; SELECT n_name, n FROM b JOIN nation ON n_nationkey = c_nationkey",
        "SELECT n_name, n FROM (SELECT c_nationkey, COUNT(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY c_nationkey) b JOIN nation ON n_nationkey = c_nationkey",
    ),
    # scalar functions
    "fn_case_trim": "SELECT p_partkey, UPPER(p_name) AS u, LOWER(p_brand) AS l, TRIM('  ' || p_brand || ' ') AS t, LTRIM(p_brand, 'Br') AS lt, RTRIM(p_brand, '0123456789') AS rt FROM part",
    "fn_length": "SELECT p_partkey, LENGTH(p_name) AS n FROM part",
    "fn_substr_instr": "SELECT p_partkey, SUBSTR(p_name, 2, 3) AS a, SUBSTR(p_name, 4) AS b, SUBSTR(p_name, -3) AS c, CAST(INSTR(p_name, 'a') AS BIGINT) AS i FROM part",
    "fn_substr_negative": ("SELECT SUBSTR('hello', -2, 2) AS a, SUBSTR('hello', 4, -2) AS b, SUBSTR('hello', 0, 3) AS c, SUBSTR('hello', -10, 3) AS d", "SELECT 'lo' AS a, 'el' AS b, 'he' AS c, '' AS d"),
    "fn_replace": "SELECT p_partkey, REPLACE(p_type, ' ', '_') AS r FROM part",
    "fn_char_unicode_hex": ("SELECT n_nationkey, UNICODE(n_name) AS u, HEX(n_name) AS h, CHAR(72, 228, 8364) AS c, CHAR(n_nationkey + 65) AS d FROM nation", "SELECT n_nationkey, CAST(unicode(n_name) AS BIGINT) AS u, hex(n_name) AS h, 'Hä€' AS c, chr(n_nationkey + 65) AS d FROM nation"),
    "fn_quote": ("SELECT QUOTE('it''s') AS a, QUOTE(NULL) AS b, QUOTE(5) AS c, QUOTE(x'41FF') AS d", "SELECT '''it''''s''' AS a, 'NULL' AS b, '5' AS c, 'X''41FF''' AS d"),
    "fn_format": ("SELECT n_nationkey, PRINTF('%d:%s:%05d|%.2f', n_nationkey, n_name, n_regionkey, n_nationkey / 4.0) AS p FROM nation", "SELECT n_nationkey, printf('%d:%s:%05d|%.2f', n_nationkey, n_name, n_regionkey, CAST(n_nationkey AS DOUBLE) / 4) AS p FROM nation"),
    "fn_numeric": ("SELECT c_custkey, ABS(c_acctbal) AS a, ROUND(c_acctbal) AS r, ROUND(c_acctbal, 1) AS r1, SIGN(c_acctbal) AS s FROM customer", "SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal) AS r, round(c_acctbal, 1) AS r1, CAST(sign(c_acctbal) AS INTEGER) AS s FROM customer"),
    "fn_null_cond": ("SELECT n_nationkey, COALESCE(NULLIF(n_regionkey, 1), -1) AS a, IFNULL(NULLIF(n_regionkey, 2), 9) AS b, IIF(n_regionkey > 2, 'hi', 'lo') AS c FROM nation", "SELECT n_nationkey, COALESCE(NULLIF(n_regionkey, 1), -1) AS a, IFNULL(NULLIF(n_regionkey, 2), 9) AS b, CASE WHEN n_regionkey > 2 THEN 'hi' ELSE 'lo' END AS c FROM nation"),
    "fn_typeof": ("SELECT TYPEOF(n_nationkey) AS a, TYPEOF(n_name) AS b, TYPEOF(n_nationkey / 2.0) AS c, TYPEOF(NULL) AS d, TYPEOF(x'00') AS e FROM nation", "SELECT 'integer' AS a, 'text' AS b, 'real' AS c, 'null' AS d, 'blob' AS e FROM nation"),
    "fn_scalar_min_max": ("SELECT n_nationkey, MAX(n_nationkey, n_regionkey, 3) AS hi, MIN(n_nationkey, n_regionkey) AS lo, MAX(n_nationkey, NULL) AS z FROM nation", "SELECT n_nationkey, greatest(n_nationkey, n_regionkey, 3) AS hi, least(n_nationkey, n_regionkey) AS lo, CAST(NULL AS BIGINT) AS z FROM nation"),
    "fn_like_glob_forms": ("SELECT n_nationkey, LIKE('a%', n_name) AS l, GLOB('*A', n_name) AS g FROM nation", "SELECT n_nationkey, CAST(n_name ILIKE 'a%' AS INTEGER) AS l, CAST(suffix(n_name, 'A') AS INTEGER) AS g FROM nation"),
    "fn_blobs": ("SELECT LENGTH(RANDOMBLOB(5)) AS a, HEX(ZEROBLOB(3)) AS b, LENGTH(x'0102') AS c", "SELECT CAST(5 AS BIGINT) AS a, '000000' AS b, CAST(2 AS BIGINT) AS c"),
    "fn_versions": ("SELECT SQLITE_VERSION() AS v, QUILLSQL_VERSION() AS q, LENGTH(CURRENT_DATE) AS d, LENGTH(CURRENT_TIME) AS t, LENGTH(CURRENT_TIMESTAMP) AS s, TYPEOF(RANDOM()) AS r", "SELECT '3.45.0' AS v, '0.1.0' AS q, CAST(10 AS BIGINT) AS d, CAST(8 AS BIGINT) AS t, CAST(19 AS BIGINT) AS s, 'integer' AS r"),
    # JSON
    "json_extract_path": ("SELECT event_id, CAST(JSON_EXTRACT(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"),
    "json_extract_many": ("SELECT event_id, JSON_EXTRACT(props, '$.k', '$.z') AS k FROM events", "SELECT event_id, '[' || json_extract_string(props, '$.k') || ',null]' AS k FROM events"),
    "json_arrow_ops": ("SELECT event_id, props -> 'k' AS a, props ->> '$.k' AS b FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS a, json_extract_string(props, '$.k') AS b FROM events"),
    "json_valid_type": ("SELECT event_id, JSON_VALID(props) AS v, JSON_TYPE(props) AS t, JSON_TYPE(props, '$.k') AS k FROM events", "SELECT event_id, CAST(1 AS BIGINT) AS v, 'object' AS t, 'integer' AS k FROM events"),
    "json_array_length": ("SELECT n_nationkey, JSON_ARRAY_LENGTH(JSON_ARRAY(1, n_name, NULL)) AS a, JSON_ARRAY_LENGTH('{\"x\":[1,2]}', '$.x') AS b, JSON_ARRAY_LENGTH('{}') AS c FROM nation", "SELECT n_nationkey, CAST(3 AS BIGINT) AS a, CAST(2 AS BIGINT) AS b, CAST(0 AS BIGINT) AS c FROM nation"),
    "json_constructors": ("SELECT n_nationkey, JSON_ARRAY(n_nationkey, n_name, NULL, JSON('[1]')) AS a, JSON_OBJECT('k', n_nationkey, 'n', n_name) AS o, JSON_QUOTE(n_name) AS q, JSON(' { \"a\" : 1 } ') AS j FROM nation", "SELECT n_nationkey, '[' || n_nationkey || ',\"' || n_name || '\",null,[1]]' AS a, '{\"k\":' || n_nationkey || ',\"n\":\"' || n_name || '\"}' AS o, '\"' || n_name || '\"' AS q, '{\"a\":1}' AS j FROM nation"),
    "json_mutators": (
        "SELECT event_id, JSON_SET(props, '$.z', 1) AS s, JSON_INSERT(props, '$.k', 0) AS i, JSON_REPLACE(props, '$.k', 'x') AS r, JSON_REMOVE(props, '$.k') AS d FROM events",
        "SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || ',\"z\":1}' AS s, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS i, '{\"k\":\"x\"}' AS r, '{}' AS d FROM events",
    ),
    "json_patch": ("SELECT event_id, JSON_PATCH(props, '{\"k\":null,\"y\":{\"z\":2}}') AS p FROM events", "SELECT event_id, '{\"y\":{\"z\":2}}' AS p FROM events"),
    "json_each_lateral": ("SELECT event_id, j.key AS k, j.value AS v, j.type AS t, j.fullkey AS f FROM events, json_each(props) AS j", "SELECT event_id, 'k' AS k, json_extract_string(props, '$.k') AS v, 'integer' AS t, '$.k' AS f FROM events"),
    "json_tree_rows": (
        "SELECT fullkey, type, atom, path FROM json_tree('{\"a\":[1,{\"b\":\"x\"}],\"c\":null}')",
        "SELECT * FROM (VALUES ('$','object',NULL,'$'),('$.a','array',NULL,'$'),('$.a[0]','integer','1','$.a'),('$.a[1]','object',NULL,'$.a'),('$.a[1].b','text','x','$.a[1]'),('$.c','null',NULL,'$')) t(fullkey, type, atom, path)",
    ),
    # data manipulation and definition, on tables of the engine's own
    "dml_insert_select": ("CREATE TABLE n2(k INTEGER PRIMARY KEY, name TEXT, r INT DEFAULT 7); INSERT INTO n2(k, name) SELECT n_nationkey, n_name FROM nation; SELECT k, name, r FROM n2", "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name, CAST(7 AS BIGINT) AS r FROM nation"),
    "dml_insert_orders": (
        "CREATE TABLE o2(k INTEGER PRIMARY KEY, c INT, p REAL); INSERT INTO o2 SELECT o_orderkey, o_custkey, o_totalprice FROM orders; SELECT k, c, p FROM o2",
        "SELECT o_orderkey AS k, o_custkey AS c, o_totalprice AS p FROM orders",
    ),
    "dml_insert_values": ("CREATE TABLE t(id INTEGER PRIMARY KEY, s TEXT); INSERT INTO t(s) VALUES ('a'), ('b'); INSERT INTO t DEFAULT VALUES; INSERT INTO t VALUES (10, 'z'); INSERT INTO t(s) VALUES ('y'); SELECT * FROM t", "SELECT * FROM (VALUES (1::BIGINT, 'a'), (2, 'b'), (3, NULL), (10, 'z'), (11, 'y')) v(id, s)"),
    "dml_update": ("CREATE TABLE p2 AS SELECT p_partkey AS k, p_size AS s, p_retailprice AS c FROM part; UPDATE p2 SET c = c * 2, s = s + 1 WHERE s % 2 = 0; SELECT k, s, ROUND(c, 2) AS c FROM p2", "SELECT p_partkey AS k, CAST(CASE WHEN p_size % 2 = 0 THEN p_size + 1 ELSE p_size END AS BIGINT) AS s, ROUND(CASE WHEN p_size % 2 = 0 THEN p_retailprice * 2 ELSE p_retailprice END, 2) AS c FROM part"),
    "dml_update_subquery": ("CREATE TABLE c2 AS SELECT c_custkey AS k, c_acctbal AS b FROM customer; UPDATE c2 SET b = 0 WHERE b < (SELECT AVG(b) FROM c2); SELECT k, b FROM c2", "SELECT c_custkey AS k, CASE WHEN c_acctbal < (SELECT AVG(c_acctbal) FROM customer) THEN 0 ELSE c_acctbal END AS b FROM customer"),
    "dml_delete": ("CREATE TABLE o2 AS SELECT o_orderkey AS k, o_orderstatus AS s FROM orders; DELETE FROM o2 WHERE s = 'F' OR k % 3 = 0; SELECT k, s FROM o2", "SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE NOT (o_orderstatus = 'F' OR o_orderkey % 3 = 0)"),
    "dml_upsert_update": (
        "CREATE TABLE c(k INTEGER PRIMARY KEY, n INT); INSERT INTO c SELECT n_nationkey, 1 FROM nation WHERE n_regionkey < 2; INSERT INTO c SELECT n_nationkey, 10 FROM nation ON CONFLICT(k) DO UPDATE SET n = c.n + excluded.n; SELECT k, n FROM c",
        "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(CASE WHEN n_regionkey < 2 THEN 11 ELSE 10 END AS BIGINT) AS n FROM nation",
    ),
    "dml_upsert_fold": ("CREATE TABLE c(k TEXT PRIMARY KEY, n INT); INSERT INTO c SELECT c_mktsegment, 1 FROM customer ON CONFLICT(k) DO UPDATE SET n = n + excluded.n; SELECT k, n FROM c", "SELECT c_mktsegment AS k, COUNT(*) AS n FROM customer GROUP BY c_mktsegment"),
    "dml_upsert_nothing": ("CREATE TABLE c(k INTEGER PRIMARY KEY, n TEXT); INSERT INTO c VALUES (1, 'old'), (2, 'old'); INSERT INTO c SELECT n_nationkey, n_name FROM nation ON CONFLICT(k) DO NOTHING; SELECT k, n FROM c", "SELECT CAST(n_nationkey AS BIGINT) AS k, CASE WHEN n_nationkey IN (1, 2) THEN 'old' ELSE n_name END AS n FROM nation"),
    "dml_insert_or_ignore": ("CREATE TABLE u(id INTEGER PRIMARY KEY, r INT UNIQUE, s TEXT); INSERT OR IGNORE INTO u SELECT n_nationkey, n_regionkey, n_name FROM nation ORDER BY n_nationkey; SELECT id, r, s FROM u", "SELECT CAST(MIN(n_nationkey) AS BIGINT) AS id, CAST(n_regionkey AS BIGINT) AS r, arg_min(n_name, n_nationkey) AS s FROM nation GROUP BY n_regionkey"),
    "dml_insert_or_replace": ("CREATE TABLE u(id INTEGER PRIMARY KEY, r INT UNIQUE, s TEXT); INSERT OR REPLACE INTO u SELECT n_nationkey, n_regionkey, n_name FROM nation ORDER BY n_nationkey; SELECT id, r, s FROM u", "SELECT CAST(MAX(n_nationkey) AS BIGINT) AS id, CAST(n_regionkey AS BIGINT) AS r, arg_max(n_name, n_nationkey) AS s FROM nation GROUP BY n_regionkey"),
    "dml_returning": ("CREATE TABLE n2(k INTEGER PRIMARY KEY, name TEXT); INSERT INTO n2 SELECT n_nationkey, n_name FROM nation; UPDATE n2 SET name = name || '!' WHERE k < 4 RETURNING k, name, k * 2 AS w", "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name || '!' AS name, CAST(n_nationkey * 2 AS BIGINT) AS w FROM nation WHERE n_nationkey < 4"),
    "dml_delete_returning": ("CREATE TABLE n2(k INTEGER PRIMARY KEY, name TEXT); INSERT INTO n2 SELECT n_nationkey, n_name FROM nation; DELETE FROM n2 WHERE k >= 20 RETURNING *", "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name FROM nation WHERE n_nationkey >= 20"),
    "dml_generated_column": ("CREATE TABLE g(a INT, b INT, c INT AS (a + b), d INT GENERATED ALWAYS AS (c * 2) STORED); INSERT INTO g(a, b) SELECT n_nationkey, n_regionkey FROM nation; UPDATE g SET a = a + 100 WHERE b = 1; SELECT a, b, c, d FROM g", "SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(a + b AS BIGINT) AS c, CAST((a + b) * 2 AS BIGINT) AS d FROM (SELECT CASE WHEN n_regionkey = 1 THEN n_nationkey + 100 ELSE n_nationkey END AS a, n_regionkey AS b FROM nation) x"),
    "dml_alter_add_drop": ("CREATE TABLE a(k INT, x TEXT, y TEXT); INSERT INTO a SELECT n_nationkey, n_name, 'gone' FROM nation; ALTER TABLE a ADD COLUMN z INT DEFAULT 5; ALTER TABLE a DROP COLUMN y; ALTER TABLE a RENAME COLUMN x TO label; ALTER TABLE a RENAME TO b; SELECT * FROM b", "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS label, CAST(5 AS BIGINT) AS z FROM nation"),
    "dml_savepoint": ("CREATE TABLE t(x INT); BEGIN; INSERT INTO t VALUES (1); SAVEPOINT a; INSERT INTO t VALUES (2); ROLLBACK TO a; INSERT INTO t VALUES (3); RELEASE a; COMMIT; SELECT x FROM t", "SELECT * FROM (VALUES (1::BIGINT), (3)) v(x)"),
    "dml_rollback": ("CREATE TABLE t(x INT); INSERT INTO t VALUES (1); BEGIN; DELETE FROM t; INSERT INTO t VALUES (9); ROLLBACK; SELECT x FROM t", "SELECT CAST(1 AS BIGINT) AS x"),
    "dml_changes": ("CREATE TABLE t(x INTEGER PRIMARY KEY); INSERT INTO t SELECT n_nationkey FROM nation; DELETE FROM t WHERE x > 9; SELECT CHANGES() AS c, LAST_INSERT_ROWID() AS r", "SELECT CAST(COUNT(*) FILTER (WHERE n_nationkey > 9) AS INTEGER) AS c, CAST(MAX(n_nationkey) AS INTEGER) AS r FROM nation"),
    "partial_unique_index": ("CREATE TABLE t(id INTEGER PRIMARY KEY, k INT, active INT); CREATE UNIQUE INDEX i ON t(k) WHERE active = 1; INSERT OR IGNORE INTO t SELECT n_nationkey, n_regionkey, n_nationkey % 2 FROM nation ORDER BY n_nationkey; SELECT id, k, active FROM t", "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS BIGINT) AS k, CAST(n_nationkey % 2 AS BIGINT) AS active FROM nation a WHERE n_nationkey % 2 = 0 OR n_nationkey = (SELECT MIN(n_nationkey) FROM nation b WHERE b.n_regionkey = a.n_regionkey AND b.n_nationkey % 2 = 1)"),
    "fk_cascade_delete": ("PRAGMA foreign_keys = ON; CREATE TABLE p(id INTEGER PRIMARY KEY); CREATE TABLE c(id INTEGER PRIMARY KEY, pid INT REFERENCES p(id) ON DELETE CASCADE); INSERT INTO p SELECT r_regionkey FROM region; INSERT INTO c SELECT n_nationkey, n_regionkey FROM nation; DELETE FROM p WHERE id IN (1, 3); SELECT id, pid FROM c", "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS BIGINT) AS pid FROM nation WHERE n_regionkey NOT IN (1, 3)"),
    "fk_set_null": ("PRAGMA foreign_keys = ON; CREATE TABLE p(id INTEGER PRIMARY KEY); CREATE TABLE c(id INTEGER PRIMARY KEY, pid INT REFERENCES p(id) ON DELETE SET NULL ON UPDATE CASCADE); INSERT INTO p SELECT r_regionkey FROM region; INSERT INTO c SELECT n_nationkey, n_regionkey FROM nation; DELETE FROM p WHERE id = 2; UPDATE p SET id = 40 WHERE id = 4; SELECT id, pid FROM c", "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(CASE n_regionkey WHEN 2 THEN NULL WHEN 4 THEN 40 ELSE n_regionkey END AS BIGINT) AS pid FROM nation"),
    "trigger_audit": ("CREATE TABLE t(id INTEGER PRIMARY KEY, v INT); CREATE TABLE log(msg TEXT); CREATE TRIGGER a AFTER UPDATE OF v ON t WHEN new.v > old.v BEGIN INSERT INTO log VALUES (old.id || ':' || old.v || '>' || new.v); END; INSERT INTO t SELECT r_regionkey, 10 FROM region; UPDATE t SET v = v + id WHERE id < 3; SELECT msg FROM log", "SELECT * FROM (VALUES ('1:10>11'), ('2:10>12')) v(msg)"),
    "catalog_table_info": ("CREATE TABLE t(a INTEGER PRIMARY KEY, b TEXT NOT NULL DEFAULT 'x', c REAL); SELECT name, type, \"notnull\" AS nn, dflt_value AS d, pk FROM pragma_table_info('t')", "SELECT * FROM (VALUES ('a', 'INTEGER', 0::BIGINT, NULL, 1::BIGINT), ('b', 'TEXT', 1, '''x''', 0), ('c', 'REAL', 0, NULL, 0)) v(name, type, nn, d, pk)"),
    "catalog_master": ("CREATE TABLE t(a INT); CREATE INDEX i ON t(a); CREATE VIEW v AS SELECT a FROM t; SELECT type, name, tbl_name FROM sqlite_master", "SELECT * FROM (VALUES ('table', 't', 't'), ('index', 'i', 't'), ('view', 'v', 'v')) x(type, name, tbl_name)"),
    "date_bucket_month": ("SELECT DATE(o_orderdate) AS d, COUNT(*) AS n FROM orders GROUP BY DATE(o_orderdate)", "SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d, COUNT(*) AS n FROM orders GROUP BY 1"),
    # constraints, triggers and definitions on tables of the engine's own
    "rowid_scan": ("CREATE TABLE t(k INTEGER PRIMARY KEY, x TEXT); INSERT INTO t SELECT o_orderkey, o_orderstatus FROM orders; SELECT rowid AS r FROM t", "SELECT o_orderkey AS r FROM orders"),
    "fk_restrict": (
        "PRAGMA foreign_keys = ON; CREATE TABLE p(id INTEGER PRIMARY KEY); CREATE TABLE c(id INTEGER PRIMARY KEY, pid INT REFERENCES p(id) ON DELETE RESTRICT DEFERRABLE INITIALLY DEFERRED); INSERT INTO p SELECT r_regionkey FROM region; INSERT INTO c SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey < 3; DELETE FROM p WHERE id > 2; SELECT id FROM p",
        "SELECT CAST(r_regionkey AS BIGINT) AS id FROM region WHERE r_regionkey <= 2",
    ),
    "fk_self_cascade": (
        "PRAGMA foreign_keys = ON; CREATE TABLE node(id INTEGER PRIMARY KEY, parent INT REFERENCES node(id) ON DELETE CASCADE); INSERT INTO node VALUES (1, NULL), (2, 1), (3, 2), (4, NULL), (5, 4); DELETE FROM node WHERE id = 2; SELECT id, parent FROM node",
        "SELECT * FROM (VALUES (1::BIGINT, NULL::BIGINT), (4, NULL), (5, 4)) v(id, parent)",
    ),
    "fk_set_default": (
        "PRAGMA foreign_keys = ON; CREATE TABLE p(id INTEGER PRIMARY KEY); CREATE TABLE c(id INTEGER PRIMARY KEY, pid INT DEFAULT 0 REFERENCES p(id) ON DELETE SET DEFAULT); INSERT INTO p SELECT r_regionkey FROM region; INSERT INTO c SELECT c_custkey, c_nationkey % 5 FROM customer; DELETE FROM p WHERE id = 3; SELECT id, pid FROM c",
        "SELECT c_custkey AS id, CAST(CASE WHEN c_nationkey % 5 = 3 THEN 0 ELSE c_nationkey % 5 END AS BIGINT) AS pid FROM customer",
    ),
    "fk_composite": (
        "PRAGMA foreign_keys = ON; CREATE TABLE p(a INT, b INT, PRIMARY KEY(a, b)); CREATE TABLE c(id INTEGER PRIMARY KEY, x INT, y INT, FOREIGN KEY(x, y) REFERENCES p(a, b) ON DELETE CASCADE ON UPDATE CASCADE); INSERT INTO p SELECT n_nationkey, n_regionkey FROM nation; INSERT INTO c SELECT n_nationkey + 100, n_nationkey, n_regionkey FROM nation; INSERT INTO c VALUES (1, 99, NULL); DELETE FROM p WHERE b = 1; UPDATE p SET b = 50 WHERE a = 0; SELECT id, x, y FROM c",
        "SELECT CAST(n_nationkey + 100 AS BIGINT) AS id, CAST(n_nationkey AS BIGINT) AS x, CAST(CASE WHEN n_nationkey = 0 THEN 50 ELSE n_regionkey END AS BIGINT) AS y FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 1, 99, NULL",
    ),
    "fk_child_null": (
        "PRAGMA foreign_keys = ON; CREATE TABLE p(id INTEGER PRIMARY KEY); CREATE TABLE c(id INTEGER PRIMARY KEY, pid INT REFERENCES p(id)); INSERT INTO p SELECT r_regionkey FROM region; INSERT INTO c SELECT n_nationkey, NULLIF(n_regionkey, 3) FROM nation; SELECT id, pid FROM c",
        "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(NULLIF(n_regionkey, 3) AS BIGINT) AS pid FROM nation",
    ),
    "check_constraint": (
        "CREATE TABLE t(a INT CHECK (a > 3), b INT, CONSTRAINT ck CHECK (a < b)); INSERT OR IGNORE INTO t SELECT p_size, p_partkey % 60 FROM part; INSERT INTO t VALUES (NULL, 1); SELECT a, b FROM t",
        "SELECT CAST(p_size AS BIGINT) AS a, p_partkey % 60 AS b FROM part WHERE p_size > 3 AND p_size < p_partkey % 60 UNION ALL SELECT NULL, 1",
    ),
    "not_null_constraint": (
        "CREATE TABLE t(a INT NOT NULL, b TEXT NOT NULL DEFAULT 'd'); INSERT OR IGNORE INTO t(a) SELECT NULLIF(p_size, 2) FROM part; SELECT a, b FROM t",
        "SELECT CAST(p_size AS BIGINT) AS a, 'd' AS b FROM part WHERE p_size <> 2",
    ),
    "dml_insert_returning": ("CREATE TABLE t(id INTEGER PRIMARY KEY, s TEXT, n INT DEFAULT 3); INSERT INTO t(id, s) SELECT c_custkey, c_name FROM customer RETURNING id, s || '?' AS q, n", "SELECT c_custkey AS id, c_name || '?' AS q, CAST(3 AS BIGINT) AS n FROM customer"),
    "dml_update_or_ignore": (
        "CREATE TABLE t(id INTEGER PRIMARY KEY, u INT UNIQUE); INSERT INTO t SELECT n_nationkey, n_nationkey FROM nation; UPDATE OR IGNORE t SET u = 3 WHERE id IN (3, 7); SELECT id, u FROM t",
        "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_nationkey AS BIGINT) AS u FROM nation",
    ),
    "dml_update_or_replace": (
        "CREATE TABLE t(id INTEGER PRIMARY KEY, u INT UNIQUE); INSERT INTO t SELECT n_nationkey, n_nationkey FROM nation; UPDATE OR REPLACE t SET u = 3 WHERE id = 7; SELECT id, u FROM t",
        "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(CASE WHEN n_nationkey = 7 THEN 3 ELSE n_nationkey END AS BIGINT) AS u FROM nation WHERE n_nationkey <> 3",
    ),
    "dml_autocommit": ("CREATE TABLE t(x INTEGER PRIMARY KEY); INSERT INTO t SELECT n_nationkey FROM nation; BEGIN; DELETE FROM t WHERE x > 5; COMMIT; INSERT INTO t VALUES (99); SELECT x FROM t", "SELECT CAST(n_nationkey AS BIGINT) AS x FROM nation WHERE n_nationkey <= 5 UNION ALL SELECT 99"),
    "trigger_insert": (
        "CREATE TABLE t(id INTEGER PRIMARY KEY, v INT); CREATE TABLE log(k INT, msg TEXT); CREATE TRIGGER b BEFORE INSERT ON t BEGIN INSERT INTO log VALUES (new.id, 'before'); END; CREATE TRIGGER a AFTER INSERT ON t WHEN new.v > 2 BEGIN INSERT INTO log VALUES (new.id, 'after'); UPDATE t SET v = 0 WHERE id = new.id; END; INSERT INTO t SELECT r_regionkey, r_regionkey FROM region; SELECT k, msg FROM log",
        "SELECT CAST(r_regionkey AS BIGINT) AS k, 'before' AS msg FROM region UNION ALL SELECT r_regionkey, 'after' FROM region WHERE r_regionkey > 2",
    ),
    "trigger_delete": (
        "CREATE TABLE t(id INTEGER PRIMARY KEY, v TEXT); CREATE TABLE gone(id INT, v TEXT); CREATE TRIGGER d BEFORE DELETE ON t BEGIN INSERT INTO gone VALUES (old.id, old.v); END; INSERT INTO t SELECT r_regionkey, r_name FROM region; DELETE FROM t WHERE id > 1; SELECT id, v FROM gone",
        "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS v FROM region WHERE r_regionkey > 1",
    ),
    "trigger_instead_of": (
        "CREATE TABLE base(id INTEGER PRIMARY KEY, v INT); INSERT INTO base SELECT r_regionkey, 1 FROM region; CREATE VIEW vw AS SELECT id, v FROM base; CREATE TRIGGER i INSTEAD OF INSERT ON vw BEGIN INSERT INTO base VALUES (new.id, new.v * 10); END; CREATE TRIGGER u INSTEAD OF UPDATE ON vw BEGIN UPDATE base SET v = new.v WHERE id = old.id; END; CREATE TRIGGER x INSTEAD OF DELETE ON vw BEGIN DELETE FROM base WHERE id = old.id; END; INSERT INTO vw VALUES (70, 7); UPDATE vw SET v = v + 1 WHERE id < 2; DELETE FROM vw WHERE id = 4; SELECT id, v FROM base",
        "SELECT CAST(r_regionkey AS BIGINT) AS id, CAST(CASE WHEN r_regionkey < 2 THEN 2 ELSE 1 END AS BIGINT) AS v FROM region WHERE r_regionkey <> 4 UNION ALL SELECT 70, 70",
    ),
    "ddl_drop": (
        "CREATE TABLE t(a INT); CREATE TABLE u(a INT); CREATE INDEX i ON t(a); CREATE VIEW v AS SELECT a FROM t; CREATE TRIGGER g AFTER INSERT ON t BEGIN INSERT INTO u VALUES (new.a); END; DROP TRIGGER g; INSERT INTO t SELECT r_regionkey FROM region; DROP VIEW v; DROP INDEX i; DROP TABLE IF EXISTS none; DROP VIEW IF EXISTS none; SELECT type, name, (SELECT COUNT(*) FROM u) AS n FROM sqlite_master",
        "SELECT * FROM (VALUES ('table', 't', 0::BIGINT), ('table', 'u', 0)) v(type, name, n)",
    ),
    "ddl_autoincrement": (
        "CREATE TABLE t(id INTEGER PRIMARY KEY AUTOINCREMENT, s TEXT); INSERT INTO t(s) VALUES ('a'), ('b'), ('c'); DELETE FROM t WHERE id = 3; INSERT INTO t(s) VALUES ('d'); SELECT id, s FROM t",
        "SELECT * FROM (VALUES (1::BIGINT, 'a'), (2, 'b'), (4, 'd')) v(id, s)",
    ),
    "catalog_table_xinfo": ("CREATE TABLE t(a INTEGER PRIMARY KEY, b TEXT NOT NULL); SELECT name, type, \"notnull\" AS nn, pk, hidden FROM pragma_table_xinfo('t')", "SELECT * FROM (VALUES ('a', 'INTEGER', 0::BIGINT, 1::BIGINT, 0::BIGINT), ('b', 'TEXT', 1, 0, 0)) v(name, type, nn, pk, hidden)"),
    "catalog_index_list": (
        "CREATE TABLE t(a INT, b TEXT UNIQUE); CREATE INDEX i ON t(a, b); CREATE UNIQUE INDEX p ON t(a) WHERE a > 1; SELECT name, \"unique\" AS u, origin, partial FROM pragma_index_list('t')",
        "SELECT * FROM (VALUES ('i', 0::BIGINT, 'c', 0::BIGINT), ('p', 1, 'c', 1), ('sqlite_autoindex_t_1', 1, 'u', 0)) v(name, u, origin, partial)",
    ),
    "catalog_index_info": ("CREATE TABLE t(a INT, b TEXT); CREATE INDEX i ON t(b, a); SELECT seqno, cid, name FROM pragma_index_info('i')", "SELECT * FROM (VALUES (0::BIGINT, 1::BIGINT, 'b'), (1, 0, 'a')) v(seqno, cid, name)"),
    "catalog_index_xinfo": ("CREATE TABLE t(a INT, b TEXT); CREATE INDEX i ON t(b, a); SELECT seqno, cid, name FROM pragma_index_xinfo('i') WHERE cid >= 0", "SELECT * FROM (VALUES (0::BIGINT, 1::BIGINT, 'b'), (1, 0, 'a')) v(seqno, cid, name)"),
    "catalog_foreign_key_list": (
        "CREATE TABLE p(id INTEGER PRIMARY KEY); CREATE TABLE c(x INT REFERENCES p(id) ON DELETE CASCADE ON UPDATE SET NULL); SELECT id, seq, \"table\" AS t, \"from\" AS f, \"to\" AS o, on_update AS u, on_delete AS d FROM pragma_foreign_key_list('c')",
        "SELECT 0::BIGINT AS id, 0::BIGINT AS seq, 'p' AS t, 'x' AS f, 'id' AS o, 'SET NULL' AS u, 'CASCADE' AS d",
    ),
    "catalog_table_list": ("CREATE TABLE t(a INT, b INT); CREATE VIEW v AS SELECT a FROM t; SELECT name, type FROM pragma_table_list WHERE name IN ('t', 'v')", "SELECT * FROM (VALUES ('t', 'table'), ('v', 'view')) x(name, type)"),
    "catalog_database_list": ("SELECT seq, name FROM pragma_database_list", "SELECT 0::BIGINT AS seq, 'main' AS name"),
    "pragma_foreign_keys": ("PRAGMA foreign_keys = ON; PRAGMA foreign_keys", "SELECT 1::BIGINT AS foreign_keys"),
    "pragma_user_version": ("PRAGMA user_version", "SELECT 0::BIGINT AS user_version"),
    "pragma_encoding": ("PRAGMA encoding", "SELECT 'UTF-8' AS encoding"),
    "win_named": ("SELECT n_nationkey, SUM(n_nationkey) OVER w AS s, RANK() OVER w AS r FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)", "SELECT n_nationkey, CAST(SUM(n_nationkey) OVER w AS BIGINT) AS s, CAST(RANK() OVER w AS INTEGER) AS r FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)"),
    "json_each_left": (
        "SELECT n_nationkey, j.value AS v FROM nation LEFT JOIN json_each(CASE WHEN n_regionkey = 1 THEN '[' || n_nationkey || ']' ELSE '[]' END) AS j ON 1",
        "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN CAST(n_nationkey AS VARCHAR) END AS v FROM nation",
    ),
    "param_positional": ("SELECT o_orderkey, ?1 AS a, ? AS b FROM orders WHERE o_custkey > ?1 AND o_orderstatus > ?", "SELECT o_orderkey, 40 AS a, 'F' AS b FROM orders WHERE o_custkey > 40 AND o_orderstatus > 'F'"),
}


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Dialect text over the tables in sf_dir that it names."""
    engine = Engine(spark)
    words = set(re.findall(r"\w+", text.lower()))
    for name in TABLES:
        if name in words:
            engine.register_parquet(name, f"{sf_dir}/{name}.parquet")
    return engine.sql(text, POSITIONAL if "?" in re.sub("'[^']*'", "", text) else PARAMS)


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(spark, sf_dir, text)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(q if isinstance(q, str) else q[0]) for name, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q if isinstance(q, str) else q[1] for name, q in QUERIES.items()}
