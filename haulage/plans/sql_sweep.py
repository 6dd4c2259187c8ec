"""Queries a caller may send through ``run_sql``, with DuckDB equivalents.

The reference hands SQL text to the source database; here the text runs as Spark
SQL over the registered tables. Each entry is ``name -> (spark_sql, duckdb_sql)``;
``None`` for the second means "same text". Money sums go through DECIMAL so that
both engines add exactly; window ranks are cast to BIGINT.
"""

from __future__ import annotations

_DSUM = "CAST(SUM(CAST({c} AS DECIMAL(18,2))) AS DOUBLE)"


def dsum(c: str) -> str:
    return _DSUM.format(c=c)


SWEEP: dict[str, tuple[str, str | None]] = {
    "h1_filter": ("""
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority
        FROM orders
        WHERE o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 50000 AND 150000
          AND o_orderpriority LIKE '1-%' AND o_custkey IS NOT NULL""", None),
    "h2_inner_join": (f"""
        SELECT n_name, COUNT(*) AS n_orders, {dsum('o_totalprice')} AS revenue
        FROM orders JOIN customer ON o_custkey = c_custkey
                    JOIN nation ON c_nationkey = n_nationkey
        GROUP BY n_name""", None),
    "h2_lineitem_join": (f"""
        SELECT o_orderpriority, COUNT(*) AS n_lines, {dsum('l_extendedprice')} AS gross
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE l_returnflag = 'R'
        GROUP BY o_orderpriority""", None),
    "h3_left_join": ("""
        SELECT c_custkey, c_name, COUNT(o_orderkey) AS n_orders
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'
        GROUP BY c_custkey, c_name""", None),
    "h3_right_join": ("""
        SELECT o.o_orderkey, c.c_custkey
        FROM (SELECT * FROM orders WHERE o_totalprice > 400000) o
        RIGHT JOIN (SELECT * FROM customer WHERE c_acctbal > 9000) c ON o.o_custkey = c.c_custkey""", None),
    "h3_full_join": ("""
        SELECT n_nationkey, n_name, s.s_suppkey
        FROM nation FULL OUTER JOIN (SELECT * FROM supplier WHERE s_acctbal > 9000) s
          ON s.s_nationkey = n_nationkey""", None),
    "h4_semi": ("""
        SELECT c_custkey, c_name FROM customer c
        WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey
                      AND o.o_orderpriority = '1-URGENT' AND o.o_totalprice > 300000)""", None),
    "h4_anti": ("""
        SELECT c_custkey, c_name FROM customer c
        WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey
                          AND o.o_orderstatus = 'P')""", None),
    "h5_theta_join": ("""
        SELECT o_orderkey, r_name AS band
        FROM orders JOIN region
          ON o_totalprice >= r_regionkey * 100000 AND o_totalprice < (r_regionkey + 1) * 100000""", None),
    "h6_asof_join": ("""
        SELECT event_id, user_id, ts, view_before FROM (
          SELECT event_id, user_id, ts, event_type,
                 last_value(view_id) IGNORE NULLS OVER (
                   PARTITION BY user_id ORDER BY ts, event_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS view_before
          FROM (SELECT event_id, user_id, ts, event_type,
                       CASE WHEN event_type = 'view' THEN event_id END AS view_id
                FROM events WHERE event_type IN ('purchase', 'view')) e) x
        WHERE event_type = 'purchase'""", """
        SELECT event_id, user_id, ts, view_before FROM (
          SELECT event_id, user_id, ts, event_type,
                 last_value(view_id IGNORE NULLS) OVER (
                   PARTITION BY user_id ORDER BY ts, event_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS view_before
          FROM (SELECT event_id, user_id, ts, event_type,
                       CASE WHEN event_type = 'view' THEN event_id END AS view_id
                FROM events WHERE event_type IN ('purchase', 'view')) e) x
        WHERE event_type = 'purchase'"""),
    "h7_group_by": (f"""
        SELECT l_returnflag, l_linestatus,
               {dsum('l_quantity')} AS sum_qty,
               {dsum('l_extendedprice')} AS sum_base_price,
               MAX(l_discount) AS max_disc, MIN(l_tax) AS min_tax,
               COUNT(*) AS count_order,
               {dsum('l_quantity')} / COUNT(*) AS avg_qty
        FROM lineitem
        GROUP BY l_returnflag, l_linestatus
        HAVING COUNT(*) > 100""", None),
    "h8_count_distinct": ("""
        SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS n_customers
        FROM orders GROUP BY o_orderstatus""", None),
    "h9_rollup": (f"""
        SELECT l_returnflag, l_linestatus, COUNT(*) AS n_rows, {dsum('l_quantity')} AS qty
        FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""", None),
    "h9_cube": ("""
        SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n_rows
        FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""", None),
    "h9_grouping_sets": ("""
        SELECT o_orderstatus, o_orderpriority, CAST(GROUPING(o_orderstatus) AS INT) AS g_status,
               COUNT(*) AS n_rows
        FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""", None),
    "h10_ranking": ("""
        SELECT c_custkey, c_nationkey, c_acctbal,
          CAST(ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS rn,
          CAST(RANK() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS BIGINT) AS rnk,
          CAST(DENSE_RANK() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS BIGINT) AS drnk,
          CAST(NTILE(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS quartile
        FROM customer""", None),
    "h10_topk_per_group": ("""
        SELECT c_nationkey, c_custkey, c_acctbal FROM (
          SELECT c_nationkey, c_custkey, c_acctbal,
                 ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn
          FROM customer) t
        WHERE rn <= 3""", None),
    "h11_lag_lead": ("""
        SELECT event_id, user_id,
          LAG(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_value,
          LEAD(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type,
          CAST(SUM(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY ts, event_id
               ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS sum_last3,
          COUNT(*) OVER (PARTITION BY user_id ORDER BY ts
               RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n_last_day
        FROM events""", None),
    "h12_topk": ("""
        SELECT o_orderkey, o_custkey, o_totalprice FROM orders
        ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""", None),
    "h12_limit_offset": ("""
        SELECT o_orderkey, o_totalprice FROM orders
        ORDER BY o_orderkey LIMIT 10 OFFSET 100""", None),
    "h13_union": ("""
        SELECT c_nationkey AS nationkey FROM customer
        UNION SELECT s_nationkey FROM supplier""", None),
    "h13_union_all": ("""
        SELECT nationkey, COUNT(*) AS n FROM (
          SELECT c_nationkey AS nationkey FROM customer
          UNION ALL SELECT s_nationkey FROM supplier) u
        GROUP BY nationkey""", None),
    "h13_intersect": ("""
        SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'
        INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'""", None),
    "h13_except": ("""
        SELECT c_custkey AS k FROM customer
        EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 100000""", None),
    "h13_except_all": ("""
        SELECT o_custkey AS k FROM orders
        EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'""", None),
    "h14_subqueries": (f"""
        WITH spent AS (
          SELECT o_custkey, {dsum('o_totalprice')} AS total FROM orders GROUP BY o_custkey)
        SELECT c_custkey, c_name, total
        FROM customer JOIN spent ON c_custkey = o_custkey
        WHERE total > (SELECT AVG(total) FROM spent)
          AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""", None),
    "h14_correlated": ("""
        SELECT o_orderkey, o_custkey, o_totalprice FROM orders o
        WHERE o_totalprice > (SELECT 1.5 * AVG(o2.o_totalprice) FROM orders o2
                              WHERE o2.o_custkey = o.o_custkey)""", None),
    # customers as a tree: eight to a parent
    "h14_recursive": ("""
        WITH RECURSIVE tree AS (
          SELECT c_custkey, c_custkey AS root, 0 AS depth FROM customer WHERE c_custkey BETWEEN 1 AND 7
          UNION ALL
          SELECT c.c_custkey, tree.root, tree.depth + 1 FROM customer c JOIN tree ON c.c_custkey DIV 8 = tree.c_custkey)
        SELECT root, depth, COUNT(*) AS n_customers, MAX(c_custkey) AS last_customer FROM tree GROUP BY root, depth""", """
        WITH RECURSIVE tree AS (
          SELECT c_custkey, c_custkey AS root, 0 AS depth FROM customer WHERE c_custkey BETWEEN 1 AND 7
          UNION ALL
          SELECT c.c_custkey, tree.root, tree.depth + 1 FROM customer c JOIN tree ON c.c_custkey // 8 = tree.c_custkey)
        SELECT root, depth, COUNT(*) AS n_customers, MAX(c_custkey) AS last_customer FROM tree GROUP BY root, depth"""),
    "h14_lateral_topk": ("""
        SELECT c.c_custkey, c.c_name, t.o_orderkey, t.o_totalprice
        FROM customer c LEFT JOIN LATERAL (
          SELECT o_orderkey, o_totalprice FROM orders o WHERE o.o_custkey = c.c_custkey
          ORDER BY o_totalprice DESC, o_orderkey LIMIT 3) t ON true""", None),
    "h14_lateral_aggregate": (f"""
        SELECT n.n_nationkey, s.n_suppliers, s.balance
        FROM nation n, LATERAL (SELECT COUNT(*) AS n_suppliers, {dsum('s_acctbal')} AS balance
                                FROM supplier WHERE s_nationkey = n.n_nationkey) s""", None),
    "h15_strings": ("""
        SELECT p_partkey, UPPER(p_name) AS up, TRIM(p_brand) AS br, SUBSTR(p_name, 1, 5) AS pre,
               REPLACE(p_name, ' ', '_') AS repl, CAST(INSTR(p_name, 'o') AS BIGINT) AS pos_o,
               CONCAT_WS('|', p_brand, p_type) AS joined,
               REGEXP_EXTRACT(p_brand, '#([0-9]+)', 1) AS brand_no,
               CAST(LENGTH(p_name) AS BIGINT) AS len, LOWER(p_type) AS low
        FROM part""", None),
    "h15_text_stats": ("""
        SELECT doc_id, CAST(LENGTH(text) AS BIGINT) AS n_chars_calc, n_chars,
               CAST(LENGTH(text) - LENGTH(REPLACE(text, CHR(10), '')) AS BIGINT) AS n_newlines,
               UPPER(lang) AS lang_up
        FROM documents""", """
        SELECT doc_id, CAST(LENGTH(text) AS BIGINT) AS n_chars_calc, n_chars,
               CAST(LENGTH(text) - LENGTH(REPLACE(text, CHR(10), '')) AS BIGINT) AS n_newlines,
               UPPER(lang) AS lang_up
        FROM documents"""),
    "h16_dates": ("""
        SELECT CAST(YEAR(o_orderdate) AS BIGINT) AS yr,
               CAST(DATE_TRUNC('MONTH', o_orderdate) AS DATE) AS month_start,
               DATE_FORMAT(o_orderdate, 'yyyy-MM') AS ym,
               COUNT(*) AS n_orders
        FROM orders GROUP BY 1, 2, 3""", """
        SELECT CAST(YEAR(o_orderdate) AS BIGINT) AS yr,
               CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS month_start,
               STRFTIME(o_orderdate, '%Y-%m') AS ym,
               COUNT(*) AS n_orders
        FROM orders GROUP BY 1, 2, 3"""),
    "h16_datediff": ("""
        SELECT l_orderkey, l_linenumber, l_partkey,
               CAST(DATEDIFF(l_shipdate, o_orderdate) AS BIGINT) AS days_to_ship
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""", """
        SELECT l_orderkey, l_linenumber, l_partkey,
               CAST(DATE_DIFF('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS BIGINT) AS days_to_ship
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "h17_math_case": ("""
        SELECT o_orderkey, ROUND(o_totalprice, 0) AS rounded, ABS(o_totalprice - 250000) AS dist,
               CAST(FLOOR(o_totalprice / 1000) AS BIGINT) AS thousands, o_orderkey % 7 AS bucket,
               CASE WHEN o_totalprice < 100000 THEN 'small'
                    WHEN o_totalprice < 300000 THEN 'medium' ELSE 'large' END AS size_band,
               COALESCE(NULLIF(o_orderpriority, '5-LOW'), 'low') AS prio,
               CAST(o_custkey AS DOUBLE) AS cust_as_double
        FROM orders""", None),
    "h18_json": ("""
        SELECT event_type, CAST(SUM(CAST(GET_JSON_OBJECT(props, '$.k') AS INT)) AS BIGINT) AS sum_k,
               MAX(FROM_JSON(props, 'k INT').k) AS max_k, COUNT(*) AS n
        FROM events GROUP BY event_type""", """
        SELECT event_type, CAST(SUM(CAST(JSON_EXTRACT_STRING(props, '$.k') AS INT)) AS BIGINT) AS sum_k,
               MAX(CAST(JSON_EXTRACT_STRING(props, '$.k') AS INT)) AS max_k, COUNT(*) AS n
        FROM events GROUP BY event_type"""),
    "h19_arrays": ("""
        SELECT vec_id, label, CAST(SIZE(embedding) AS BIGINT) AS dim,
               CAST(ELEMENT_AT(embedding, 1) AS DOUBLE) AS first_value,
               CAST(ARRAY_MAX(embedding) AS DOUBLE) AS max_value,
               CAST(AGGREGATE(embedding, 0, (acc, x) -> acc + CASE WHEN x > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_positive
        FROM embeddings""", """
        SELECT vec_id, label, CAST(LEN(embedding) AS BIGINT) AS dim,
               CAST(embedding[1] AS DOUBLE) AS first_value,
               CAST(LIST_MAX(embedding) AS DOUBLE) AS max_value,
               CAST(LEN(LIST_FILTER(embedding, lambda x: x > 0)) AS BIGINT) AS n_positive
        FROM embeddings"""),
    "h19_array_explode": ("""
        SELECT label, CAST(COUNT(*) AS BIGINT) AS n_values,
               CAST(SUM(CASE WHEN v > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_positive
        FROM (SELECT label, EXPLODE(embedding) AS v FROM embeddings) t
        GROUP BY label""", """
        SELECT label, CAST(COUNT(*) AS BIGINT) AS n_values,
               CAST(SUM(CASE WHEN v > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_positive
        FROM (SELECT label, UNNEST(embedding) AS v FROM embeddings) t
        GROUP BY label"""),
    "c5_user_limit": ("""
        SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 50""", None),
}

# Tables each query reads (registered as temporary views before the text runs).
SWEEP_TABLES = ("region nation customer supplier part orders lineitem events documents "
                "embeddings pages benchmark labels conversations").split()
