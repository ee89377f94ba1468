"""Queries that Spark's own operators express, as text that both engines read.

Tables stand in braces.  Where the engines spell something differently there
are two texts.  Sums of doubles go through scaled longs, so that they don't
depend on the order of addition; ascending orders put nulls last.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lithic.session import load


def total(x: str) -> str:
    """Sum to four places, which is all that prices times discounts have, over scaled longs: no decimal objects by row."""
    return f"(CAST(SUM(CAST(FLOOR(({x}) * 10000 + 0.5) AS BIGINT)) AS DOUBLE) / 10000)"


def mean(x: str) -> str:
    return f"ROUND({total(x)} / COUNT({x}), 6)"


#: name: text for both, or (Spark's text, DuckDB's text)
TEXTS: dict[str, str | tuple[str, str]] = {
    # scans
    "scan_full": "SELECT * FROM {orders}",
    "scan_project": "SELECT l_orderkey, l_quantity FROM {lineitem}",
    "scan_vector_skip": "SELECT event_id, user_id, value FROM {events} WHERE event_id BETWEEN 2000 AND 2100",
    "scan_like_prefix": "SELECT p_partkey, p_name FROM {part} WHERE p_name LIKE 'part 1%' OR p_type LIKE 'PROMO%'",
    "scan_param_prune": "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderkey < (SELECT 10 * MAX(n_nationkey) FROM {nation})",
    "scan_late_mat": "SELECT * FROM {lineitem} WHERE l_quantity = 7 AND l_discount > 0.05",
    "scan_parallel": f"SELECT COUNT(*) AS n, {total('l_extendedprice')} AS total FROM {{lineitem}}",
    "index_only_count": "SELECT COUNT(*) AS n FROM {lineitem} WHERE l_suppkey BETWEEN 3 AND 17",
    # filters and projections
    "filter_range": "SELECT o_orderkey, o_orderdate FROM {orders} WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01 00:00:00' AND TIMESTAMP '1996-12-31 00:00:00' AND o_totalprice >= 1000.0",
    "filter_eq": "SELECT o_orderkey, o_orderstatus FROM {orders} WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'",
    "filter_eq_types": (
        "SELECT n_nationkey FROM {nation} WHERE ARRAY(n_nationkey, n_regionkey) = ARRAY(n_regionkey, n_nationkey) OR UNHEX(MD5(n_name)) = UNHEX(MD5('NATION_7')) OR CAST(n_nationkey AS DECIMAL(9,2)) = 11.00 OR TO_JSON(FROM_JSON(CONCAT('{{\"k\": ', n_nationkey, '}}'), 'k INT')) = '{{\"k\":12}}'",
        "SELECT n_nationkey FROM {nation} WHERE [n_nationkey, n_regionkey] = [n_regionkey, n_nationkey] OR MD5(n_name) = MD5('NATION_7') OR n_nationkey IN (11, 12)",
    ),
    "filter_isnull": "SELECT c_custkey FROM (SELECT c_custkey, NULLIF(c_mktsegment, 'BUILDING') AS seg FROM {customer}) t WHERE seg IS NULL",
    "filter_notnull": "SELECT c_custkey, seg FROM (SELECT c_custkey, NULLIF(c_mktsegment, 'BUILDING') AS seg FROM {customer}) t WHERE seg IS NOT NULL",
    "filter_compound": "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_quantity > 10 AND l_discount BETWEEN 0.02 AND 0.06 AND l_returnflag = 'R' AND (l_linenumber < 5)",
    "filter_like_infix": "SELECT event_id, props FROM {events} WHERE props LIKE '%1%' AND event_type LIKE '%i%'",
    "filter_collate": ("SELECT n_nationkey, n_name FROM {nation} WHERE n_name COLLATE UTF8_LCASE LIKE 'nation_1%' OR LOWER(n_name) = 'france'", "SELECT n_nationkey, n_name FROM {nation} WHERE LOWER(n_name) LIKE 'nation_1%' OR LOWER(n_name) = 'france'"),
    "filter_gating": "SELECT COUNT(*) AS n FROM {orders} WHERE (SELECT COUNT(*) = 0 FROM {region})",
    "filter_modulo": "SELECT event_id FROM {events} WHERE event_id % 97 = 0",
    "filter_not_in": "SELECT c_custkey FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders} WHERE o_custkey IS NOT NULL AND o_totalprice > 150000)",
    "project_expr": "SELECT l_orderkey, l_linenumber, ROUND(l_extendedprice * (1 - l_discount), 4) AS net, CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END AS size_class, CAST(l_quantity AS INT) AS qty FROM {lineitem}",
    "whole_row": ("SELECT n_nationkey, CAST(struct(n_nationkey, n_name, n_regionkey) AS STRING) AS row_text FROM {nation}", "SELECT n_nationkey, '{{' || n_nationkey || ', ' || n_name || ', ' || n_regionkey || '}}' AS row_text FROM {nation}"),
    # joins
    "join_hash_inner": f"SELECT o_orderpriority, COUNT(*) AS n, {total('l_quantity')} AS qty FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey GROUP BY o_orderpriority",
    "join_sort_merge": ("SELECT /*+ MERGE(o) */ l.l_orderkey, l.l_linenumber, o.o_custkey FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey WHERE l.l_quantity < 5", "SELECT l.l_orderkey, l.l_linenumber, o.o_custkey FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey WHERE l.l_quantity < 5"),
    "join_nested_loop": "SELECT n_name, r_name FROM {nation} JOIN {region} ON n_regionkey > r_regionkey",
    "join_selective_dim": f"SELECT COUNT(*) AS n, {mean('l_extendedprice')} AS avg_price FROM {{lineitem}} JOIN {{supplier}} ON l_suppkey = s_suppkey WHERE s_nationkey = 3",
    "join_unselective": f"SELECT COUNT(*) AS n, {mean('l_extendedprice')} AS avg_price FROM {{lineitem}} JOIN {{supplier}} ON l_suppkey = s_suppkey",
    "join_star": f"SELECT r_name, COUNT(*) AS n, {total('l_extendedprice')} AS revenue FROM {{lineitem}} JOIN {{supplier}} ON l_suppkey = s_suppkey JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey GROUP BY r_name",
    "join_wide_projection": f"SELECT s_nationkey, {total('l_quantity')} AS q, {total('l_extendedprice')} AS p, {total('l_discount')} AS d, {total('l_tax')} AS t, MIN(l_quantity) AS lo, MAX(l_quantity) AS hi, COUNT(*) AS n FROM {{lineitem}} JOIN {{supplier}} ON l_suppkey = s_suppkey GROUP BY s_nationkey",
    "join_self_using": "SELECT o_custkey, COUNT(*) AS pairs FROM (SELECT o_custkey, o_orderkey AS a FROM {orders}) x JOIN (SELECT o_custkey, o_orderkey AS b FROM {orders}) y USING (o_custkey) WHERE a < b GROUP BY o_custkey",
    "join_full_outer": "SELECT COALESCE(a.k, b.k) AS k, a.n AS na, b.n AS nb FROM (SELECT c_nationkey AS k, COUNT(*) AS n FROM {customer} WHERE c_nationkey < 15 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, COUNT(*) AS n FROM {supplier} WHERE s_nationkey > 8 GROUP BY 1) b ON a.k = b.k",
    "join_left_outer": "SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_orderstatus = 'P'",
    "join_right_outer": "SELECT s_suppkey, n_name FROM {supplier} RIGHT JOIN {nation} ON s_nationkey = n_nationkey AND s_acctbal > 5000",
    "join_cross": "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}",
    "join_lateral": "SELECT n_name, best FROM {nation} n, LATERAL (SELECT MAX(c_acctbal) AS best FROM {customer} c WHERE c.c_nationkey = n.n_nationkey) t",
    "join_semi": "SELECT o_orderkey FROM {orders} o WHERE EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')",
    "join_anti": "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)",
    "join_fdw_self": "SELECT a.p_partkey, b.p_size FROM {part} a JOIN {part} b ON a.p_partkey = b.p_partkey WHERE a.p_size > 40",
    "join_theta": "SELECT s.s_suppkey, COUNT(*) AS below FROM {supplier} s JOIN {nation} n ON s.s_acctbal > n.n_nationkey * 400 GROUP BY s.s_suppkey",
    # aggregates
    "agg_filtered": f"SELECT COUNT(*) AS n, {total('l_extendedprice')} AS total, MIN(l_quantity) AS lo FROM {{lineitem}} WHERE l_shipdate >= TIMESTAMP '1995-06-01 00:00:00'",
    "agg_batch_fold": f"SELECT {total('l_quantity')} AS q, {mean('l_tax')} AS t, MAX(l_shipdate) AS latest FROM {{lineitem}} WHERE l_linenumber % 2 = 1",
    "agg_parallel_partial": "SELECT COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS s, AVG(l_linenumber) AS a FROM {lineitem}",
    "groupby_text_key": f"SELECT event_type, COUNT(*) AS n, {total('value')} AS total FROM {{events}} GROUP BY event_type",
    "groupby_time_bucket": ("SELECT CAST(date_trunc('HOUR', ts) AS TIMESTAMP_NTZ) AS bucket, COUNT(*) AS n, " + total("value") + " AS total FROM {events} GROUP BY 1", "SELECT date_trunc('hour', ts) AS bucket, COUNT(*) AS n, " + total("value") + " AS total FROM {events} GROUP BY 1"),
    "groupby_multi_key": f"SELECT l_returnflag, l_linestatus, COUNT(*) AS n, {total('l_quantity')} AS sum_qty, {total('l_extendedprice * (1 - l_discount)')} AS revenue, {mean('l_discount')} AS avg_disc FROM {{lineitem}} GROUP BY l_returnflag, l_linestatus",
    "groupby_expr_key": "SELECT event_id % 7 AS k, COUNT(*) AS n, MIN(value) AS lo, MAX(value) AS hi FROM {events} GROUP BY event_id % 7",
    "groupby_having": "SELECT user_id, COUNT(*) AS n FROM {events} GROUP BY user_id HAVING COUNT(*) > 60",
    "count_distinct": "SELECT COUNT(DISTINCT user_id) AS users, COUNT(DISTINCT event_type) AS kinds FROM {events}",
    "agg_distinct": "SELECT l_returnflag, CAST(SUM(DISTINCT l_linenumber) AS BIGINT) AS s, COUNT(DISTINCT l_suppkey) AS n FROM {lineitem} GROUP BY l_returnflag",
    "select_distinct": "SELECT DISTINCT p_brand, p_size FROM {part}",
    "distinct_on": ("SELECT user_id, ts, event_id, value FROM (SELECT user_id, ts, event_id, value, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM {events}) t WHERE nth = 1", "SELECT DISTINCT ON (user_id) user_id, ts, event_id, value FROM {events} ORDER BY user_id, ts DESC, event_id DESC"),
    "agg_filter_clause": "SELECT event_type, COUNT(*) FILTER (WHERE value > 50) AS high, COUNT(*) FILTER (WHERE value <= 50) AS low FROM {events} GROUP BY event_type",
    "string_agg": ("SELECT n_regionkey, LISTAGG(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, STRING_AGG(n_name, ',' ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey"),
    "array_agg": ("SELECT n_regionkey, ARRAY_JOIN(TRANSFORM(ARRAY_SORT(COLLECT_LIST(n_nationkey)), x -> CAST(x AS STRING)), '-') AS keys FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, ARRAY_TO_STRING(LIST_SORT(LIST(n_nationkey)), '-') AS keys FROM {nation} GROUP BY n_regionkey"),
    "percentile_cont": "SELECT event_type, ROUND(PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY value), 6) AS median FROM {events} GROUP BY event_type",
    "agg_bool_bit": ("SELECT l_returnflag, EVERY(l_quantity > 0) AS every_pos, BIT_XOR(l_orderkey) AS x FROM {lineitem} GROUP BY l_returnflag", "SELECT l_returnflag, BOOL_AND(l_quantity > 0) AS every_pos, BIT_XOR(l_orderkey) AS x FROM {lineitem} GROUP BY l_returnflag"),
    "grouping_sets": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "cube": "SELECT p_brand, p_size, COUNT(*) AS n FROM {part} GROUP BY CUBE (p_brand, p_size)",
    "rollup": "SELECT c_nationkey, c_mktsegment, COUNT(*) AS n FROM {customer} GROUP BY ROLLUP (c_nationkey, c_mktsegment)",
    "agg_empty_input": "SELECT COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS s, MIN(l_quantity) AS lo FROM {lineitem} WHERE l_quantity < 0",
    # windows
    "window_rank": "SELECT o_orderkey, CAST(ROW_NUMBER() OVER w AS BIGINT) AS rn, CAST(RANK() OVER v AS BIGINT) AS rk, CAST(DENSE_RANK() OVER v AS BIGINT) AS dr, ROUND(PERCENT_RANK() OVER v, 9) AS pr, ROUND(CUME_DIST() OVER v, 9) AS cd, CAST(NTILE(4) OVER w AS BIGINT) AS nt FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderpriority)",
    "window_lag_lead": "SELECT event_id, LAG(value, 1) OVER w AS prev, LEAD(value, 2) OVER w AS next2, FIRST_VALUE(value) OVER w AS f, LAST_VALUE(value) OVER w AS l, NTH_VALUE(value, 2) OVER w AS n2 FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "window_running_sum": "SELECT event_id, CAST(SUM(CAST(value AS DECIMAL(18,4))) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) AS running FROM {events}",
    "window_rows_frame": "SELECT event_id, MAX(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING) AS m FROM {events}",
    "window_range_frame": "SELECT event_id, COUNT(*) OVER (PARTITION BY event_type ORDER BY event_id RANGE BETWEEN 50 PRECEDING AND CURRENT ROW) AS n FROM {events}",
    "window_interval_frame": ("SELECT event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '6' HOUR PRECEDING AND CURRENT ROW) AS n FROM {events}", "SELECT event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS n FROM {events}"),
    # order, limits, sets
    "order_by": "SELECT c_custkey, c_acctbal FROM {customer} ORDER BY c_acctbal ASC NULLS LAST, c_custkey",
    "topk": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM {lineitem} ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20",
    "limit_offset": "SELECT o_orderkey FROM {orders} ORDER BY o_orderkey LIMIT 15 OFFSET 30",
    "order_by_unselected": "SELECT s_name FROM {supplier} ORDER BY s_acctbal DESC, s_suppkey LIMIT 10",
    "union_all": "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}",
    "union_distinct": "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}",
    "intersect": "SELECT c_nationkey AS k FROM {customer} WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM {supplier}",
    "except": "SELECT n_nationkey AS k FROM {nation} EXCEPT SELECT s_nationkey FROM {supplier} WHERE s_acctbal < 4000",
    "intersect_all": "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}",
    "except_all": "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}",
    "recursive_cte": "WITH RECURSIVE r(k, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION ALL SELECT k * 2, depth + 1 FROM r WHERE depth < 10) SELECT k, depth FROM r",
    # scalar functions
    "fn_string": ("SELECT c_custkey, c_name || '-' || c_mktsegment AS joined, MD5(c_name) AS digest, CAST(LENGTH(c_name) AS BIGINT) AS len, LOWER(c_mktsegment) AS low, UPPER(c_name) AS up, REPEAT('ab', 3) AS rep, LPAD(CAST(c_custkey AS STRING), 8, '0') AS padded, SUBSTR(c_name, 2, 5) AS sub FROM {customer}", "SELECT c_custkey, c_name || '-' || c_mktsegment AS joined, MD5(c_name) AS digest, CAST(LENGTH(c_name) AS BIGINT) AS len, LOWER(c_mktsegment) AS low, UPPER(c_name) AS up, REPEAT('ab', 3) AS rep, LPAD(CAST(c_custkey AS VARCHAR), 8, '0') AS padded, SUBSTR(c_name, 2, 5) AS sub FROM {customer}"),
    "fn_datetime": ("SELECT o_orderkey, CAST(date_trunc('MONTH', o_orderdate) AS TIMESTAMP_NTZ) AS m, o_orderdate + INTERVAL '3' DAY AS later, YEAR(o_orderdate) AS y FROM {orders}", "SELECT o_orderkey, date_trunc('month', o_orderdate)::TIMESTAMP AS m, o_orderdate + INTERVAL 3 DAY AS later, YEAR(o_orderdate)::INT AS y FROM {orders}"),
    "fn_math": ("SELECT l_orderkey, l_linenumber, ROUND(SQRT(l_extendedprice), 6) AS root, l_orderkey % 7 AS m, FLOOR(l_discount * 100) AS f, l_orderkey DIV 3 AS d FROM {lineitem}", "SELECT l_orderkey, l_linenumber, ROUND(SQRT(l_extendedprice), 6) AS root, l_orderkey % 7 AS m, CAST(FLOOR(l_discount * 100) AS BIGINT) AS f, l_orderkey // 3 AS d FROM {lineitem}"),
    "fn_array": ("SELECT n_nationkey, elem FROM {nation} LATERAL VIEW EXPLODE(ARRAY(n_nationkey, n_regionkey * 10)) t AS elem", "SELECT n_nationkey, UNNEST([n_nationkey, n_regionkey * 10]) AS elem FROM {nation}"),
    "fn_json": ("SELECT n_nationkey, TO_JSON(NAMED_STRUCT('k', n_nationkey, 'name', n_name)) AS doc FROM {nation}", "SELECT n_nationkey, CAST(JSON_OBJECT('k', n_nationkey, 'name', n_name) AS VARCHAR) AS doc FROM {nation}"),
    "fn_binary": ("SELECT n_nationkey, HEX(UNHEX('DEADBEEF')) AS h, CAST(CONV(SUBSTR(MD5(n_name), 1, 8), 16, 10) AS BIGINT) AS bits FROM {nation}", "SELECT n_nationkey, HEX(UNHEX('DEADBEEF')) AS h, CAST('0x' || SUBSTR(MD5(n_name), 1, 8) AS BIGINT) AS bits FROM {nation}"),
    "fn_generate_series": ("SELECT EXPLODE(SEQUENCE(1, 500, 7)) AS g", "SELECT CAST(UNNEST(GENERATE_SERIES(1, 500, 7)) AS INT) AS g"),
    "fn_conditional": "SELECT l_orderkey, l_linenumber, COALESCE(NULLIF(l_returnflag, 'N'), 'none') AS flag, GREATEST(l_discount, l_tax) AS g, LEAST(l_discount, l_tax) AS l FROM {lineitem}",
    # shapes of published benchmarks, on the tables at hand
    "bench_count": "SELECT COUNT(*) AS n FROM {lineitem}",
    "bench_sum_avg": "SELECT CAST(SUM(l_linenumber) AS BIGINT) AS s, AVG(l_linenumber) AS a FROM {lineitem}",
    "bench_range_agg": f"SELECT COUNT(*) AS n, {total('l_extendedprice')} AS total FROM {{lineitem}} WHERE l_orderkey BETWEEN 1000 AND 1300",
    "ts_q1_single_host": ("SELECT CAST(date_trunc('MINUTE', ts) AS TIMESTAMP_NTZ) AS minute, MAX(value) AS top FROM {events} WHERE user_id = 7 AND ts >= TIMESTAMP_NTZ '2024-01-05 00:00:00' AND ts < TIMESTAMP_NTZ '2024-01-09 00:00:00' GROUP BY 1", "SELECT date_trunc('minute', ts) AS minute, MAX(value) AS top FROM {events} WHERE user_id = 7 AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-09 00:00:00' GROUP BY 1"),
    "ts_q4_double_groupby": ("SELECT user_id, CAST(date_trunc('HOUR', ts) AS TIMESTAMP_NTZ) AS hour, " + mean("value") + " AS avg_value FROM {events} GROUP BY 1, 2", "SELECT user_id, date_trunc('hour', ts) AS hour, " + mean("value") + " AS avg_value FROM {events} GROUP BY 1, 2"),
    "ts_q6_high_values": "SELECT event_id, ts, user_id, value FROM {events} WHERE value > 90",
    "ts_q8_latest": "SELECT event_id, ts, value FROM {events} ORDER BY ts DESC, event_id DESC LIMIT 10",
}


def tables_of(text: str) -> list[str]:
    return sorted({name for _, name, _, _ in string.Formatter().parse(text) if name})


def runner(text: str) -> Callable[[SparkSession, str], DataFrame]:
    names = tables_of(text)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{n: load(spark, sf_dir, n) for n in names})

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: runner(t if isinstance(t, str) else t[0]) for k, t in TEXTS.items()}


def oracle_sql() -> dict[str, str]:
    texts = {k: t if isinstance(t, str) else t[1] for k, t in TEXTS.items()}
    return {k: t.format(**{n: n for n in tables_of(t)}) for k, t in texts.items()}
