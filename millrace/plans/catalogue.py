"""Relational categories that reach Spark through the SQL gateway, each as one statement."""

from __future__ import annotations

#: Statements over the driver's tables. The text is Spark SQL; the registry holds the other dialect's counterpart.
STATEMENTS = {
    "sql_join_inner": """
        SELECT o.o_orderpriority, count(*) AS n_items, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
        WHERE o.o_orderdate >= TIMESTAMP_NTZ '1996-01-01' GROUP BY o.o_orderpriority""",
    "sql_join_left": """
        SELECT c.c_mktsegment, count(o.o_orderkey) AS n_orders, count(*) AS n_rows
        FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'F' GROUP BY c.c_mktsegment""",
    "sql_join_semi": """
        SELECT p_brand, count(*) AS n_parts FROM part LEFT SEMI JOIN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49) q ON p_partkey = q.l_partkey GROUP BY p_brand""",
    "sql_join_anti": """
        SELECT c_nationkey, count(*) AS n_idle FROM customer LEFT ANTI JOIN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) q ON c_custkey = q.o_custkey GROUP BY c_nationkey""",
    "sql_union_intersect_except": """
        SELECT 'union' AS kind, count(*) AS n FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)
        UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)
        UNION ALL SELECT 'except_all', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)""",
    "sql_rollup_cube": """
        SELECT l_returnflag, l_linestatus, grouping(l_returnflag) AS g_flag, grouping(l_linestatus) AS g_status, count(*) AS n, round(sum(l_quantity), 2) AS quantity
        FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""",
    "sql_grouping_sets": """
        SELECT r_name, n_name, count(*) AS n_customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        GROUP BY GROUPING SETS ((r_name, n_name), (r_name), ())""",
    "sql_window_rank_lag": """
        SELECT o_custkey, o_orderkey, rank() OVER w AS price_rank, round(o_totalprice - lag(o_totalprice) OVER w, 2) AS gap
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)""",
    "sql_topn_per_group": """
        SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn <= 3""",
    "sql_subquery_correlated": """
        SELECT count(*) AS n FROM orders o WHERE o_totalprice > (SELECT 1.2 * avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)""",
    "sql_pivot": """
        SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM orders) PIVOT (count(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))""",
    "sql_json_props": """
        SELECT event_type, count(*) AS n, sum(CAST(get_json_object(props, '$.k') AS BIGINT)) AS k_sum FROM events GROUP BY event_type""",
    "sql_full_outer": """
        SELECT coalesce(c.nk, s.nk) AS nation_key, c.n AS customers, s.n AS suppliers
        FROM (SELECT c_nationkey AS nk, count(*) AS n FROM customer WHERE c_acctbal < 0 GROUP BY 1) c FULL OUTER JOIN (SELECT s_nationkey AS nk, count(*) AS n FROM supplier WHERE s_acctbal < 0 GROUP BY 1) s ON c.nk = s.nk""",
    "sql_range_join": """
        SELECT b.band, count(*) AS n_orders FROM orders o JOIN (SELECT * FROM VALUES (0, 0.0D, 50000.0D), (1, 50000.0D, 150000.0D), (2, 150000.0D, 1.0E9D) AS t(band, low, high)) b
        ON o.o_totalprice >= b.low AND o.o_totalprice < b.high GROUP BY b.band""",
    "sql_recursive_dates": """
        WITH RECURSIVE d(day) AS (SELECT DATE '2024-01-01' UNION ALL SELECT day + INTERVAL 1 DAY FROM d WHERE day < DATE '2024-01-31')
        SELECT CAST(CAST(d.day AS DATE) AS STRING) AS day, count(e.event_id) AS n FROM d LEFT JOIN events e ON CAST(e.ts AS DATE) = d.day GROUP BY 1""",
}
