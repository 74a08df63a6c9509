"""Registered queries in SQL: joins, grouping, windows, sets and sub-queries."""

from __future__ import annotations

from spanlake.plans.registry import spark_query

spark_query("join_inner", "SELECT o.o_orderkey, c.c_name, n.n_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey")
spark_query("join_left", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000")
spark_query("join_full", "SELECT coalesce(a.k, b.k) AS k, a.n AS orders, b.n AS items FROM (SELECT o_orderkey AS k, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderkey) a FULL JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY l_orderkey) b ON a.k = b.k")
spark_query("join_right", "SELECT s.s_suppkey, n.n_nationkey FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 9000")
spark_query(
    "join_semi",
    "SELECT c_custkey, c_name FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000",
    "SELECT c_custkey, c_name FROM customer SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000",
)
spark_query(
    "join_anti",
    "SELECT c_custkey, c_name FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 350000",
    "SELECT c_custkey, c_name FROM customer ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 350000",
)
spark_query("join_cross", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n")
spark_query("join_theta_range", "SELECT a.n_nationkey AS low, b.n_nationkey AS high FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND b.n_nationkey <= a.n_nationkey + 3")
spark_query("subquery_scalar", "SELECT event_id, value FROM events WHERE value > (SELECT avg(value) FROM events)")
spark_query("subquery_exists", "SELECT p_partkey FROM part p WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 49)")
spark_query("subquery_in", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
spark_query("cte_recursive", "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 20) SELECT n FROM r")
spark_query("agg_distinct", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
spark_query("agg_having", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 5")
spark_query("agg_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
spark_query("agg_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
spark_query("agg_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
spark_query("agg_filter", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS large, round(sum(l_extendedprice) FILTER (WHERE l_discount > 0.05), 2) AS discounted FROM lineitem GROUP BY l_returnflag")
spark_query("agg_statistics", "SELECT event_type, round(stddev_samp(value), 6) AS sd, round(var_pop(value), 6) AS var, round(corr(value, event_id), 6) AS r FROM events GROUP BY event_type")
spark_query("pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus")
spark_query("latency_percentiles", "SELECT event_type, round(percentile(value, 0.5), 6) AS p50, round(percentile(value, 0.95), 6) AS p95, round(percentile(value, 0.99), 6) AS p99 FROM events GROUP BY event_type", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
spark_query("window_row_number", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS k FROM events")
spark_query("window_rank", "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS BIGINT) AS d FROM orders")
spark_query("window_lag_lead", "SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events")
spark_query("window_running_sum", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS total FROM events")
spark_query("window_moving_avg", "SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean FROM events")
spark_query("window_ntile", "SELECT c_custkey, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS BIGINT) AS quarter FROM customer")
spark_query("window_first_last", "SELECT event_id, first_value(value) OVER w AS first, last_value(value) OVER w AS last, nth_value(value, 2) OVER w AS second FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
spark_query("window_distribution", "SELECT s_suppkey, round(percent_rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal), 6) AS p, round(cume_dist() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal), 6) AS c FROM supplier")
spark_query("topk_per_group", "SELECT user_id, event_id, value FROM (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) x WHERE k <= 3")
spark_query("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier")
spark_query("set_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier")
spark_query("set_intersect", "SELECT o_custkey AS k FROM orders WHERE o_totalprice > 100000 INTERSECT SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0")
spark_query("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey AS k FROM orders WHERE o_totalprice > 350000")
spark_query("set_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey AS k FROM supplier")
spark_query("scalar_strings", "SELECT p_partkey, upper(p_name) AS a, substring(p_name, 2, 4) AS b, replace(p_type, ' ', '_') AS c, length(p_name) AS d, reverse(p_brand) AS e, lpad(p_brand, 12, '*') AS f FROM part", "SELECT p_partkey, upper(p_name) AS a, substring(p_name, 2, 4) AS b, replace(p_type, ' ', '_') AS c, CAST(length(p_name) AS INTEGER) AS d, reverse(p_brand) AS e, lpad(p_brand, 12, '*') AS f FROM part")
spark_query("scalar_case_cast", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS band, CAST(round(o_totalprice) AS BIGINT) AS price, try_cast(substring(o_orderpriority, 1, 1) AS INT) AS priority FROM orders")
spark_query("scalar_dates", "SELECT event_id, date_trunc('day', ts) AS day, CAST(extract(HOUR FROM ts) AS BIGINT) AS hour, ts + INTERVAL 90 MINUTES AS later FROM events", "SELECT event_id, date_trunc('day', ts)::TIMESTAMP AS day, CAST(extract(HOUR FROM ts) AS BIGINT) AS hour, ts + INTERVAL 90 MINUTES AS later FROM events")
spark_query("scalar_null_safe", "SELECT a.n_nationkey AS a, b.s_suppkey AS b FROM nation a JOIN supplier b ON a.n_nationkey IS NOT DISTINCT FROM b.s_nationkey WHERE b.s_acctbal BETWEEN 0 AND 5000 AND a.n_name LIKE '%A%'")
spark_query("distinct_on_latest", "SELECT user_id, event_id, ts FROM (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) x WHERE k = 1")
spark_query("scalar_math", "SELECT l_orderkey, l_linenumber, l_partkey, round(abs(l_discount - 0.05), 6) AS a, ceil(l_tax * 100) AS b, floor(l_extendedprice / 7) AS c, round(sqrt(l_quantity), 6) AS d, round(power(l_tax, 2), 8) AS e, round(ln(l_quantity), 6) AS f, sign(l_discount - 0.05) AS g, l_partkey % 7 AS h, round(exp(l_tax), 6) AS i, round(sin(l_discount), 6) AS j, greatest(l_tax, l_discount) AS k FROM lineitem", "SELECT l_orderkey, l_linenumber, l_partkey, round(abs(l_discount - 0.05), 6) AS a, CAST(ceil(l_tax * 100) AS BIGINT) AS b, CAST(floor(l_extendedprice / 7) AS BIGINT) AS c, round(sqrt(l_quantity), 6) AS d, round(power(l_tax, 2), 8) AS e, round(ln(l_quantity), 6) AS f, CAST(sign(l_discount - 0.05) AS DOUBLE) AS g, l_partkey % 7 AS h, round(exp(l_tax), 6) AS i, round(sin(l_discount), 6) AS j, greatest(l_tax, l_discount) AS k FROM lineitem")
spark_query("scalar_arrays", "SELECT p_partkey, size(w) AS n, element_at(w, 1) AS first, array_contains(w, 'PART') AS has, array_join(sort_array(array_distinct(w)), '/') AS sorted, array_join(slice(w, 1, 2), '+') AS two, array_position(w, element_at(w, -1)) AS place FROM (SELECT p_partkey, split(upper(p_name || ' ' || p_type), ' ') AS w FROM part) x", "SELECT p_partkey, CAST(len(w) AS INTEGER) AS n, w[1] AS first, list_contains(w, 'PART') AS has, array_to_string(list_sort(list_distinct(w)), '/') AS sorted, array_to_string(w[1:2], '+') AS two, CAST(list_position(w, w[-1]) AS BIGINT) AS place FROM (SELECT p_partkey, string_split(upper(p_name || ' ' || p_type), ' ') AS w FROM part) x")
spark_query("scalar_maps_structs", "SELECT c_custkey, m['seg'] AS seg, size(m) AS n, array_join(sort_array(map_keys(m)), ',') AS keys, s.a AS a, map_contains_key(m, 'none') AS none FROM (SELECT c_custkey, map('seg', c_mktsegment, 'name', c_name) AS m, named_struct('a', c_nationkey, 'b', c_name) AS s FROM customer) x", "SELECT c_custkey, c_mktsegment AS seg, CAST(2 AS INTEGER) AS n, 'name,seg' AS keys, c_nationkey AS a, false AS none FROM customer")
spark_query("unnest_array", "SELECT p_partkey, word FROM part LATERAL VIEW explode(split(p_type, ' ')) x AS word", "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word FROM part")
spark_query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
spark_query("scalar_hashes", "SELECT c_custkey, md5(c_name) AS m, sha2(c_name, 256) AS s, base64(CAST(c_name AS BINARY)) AS b, hex(c_custkey) AS h FROM customer", "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s, base64(c_name::BLOB) AS b, hex(c_custkey) AS h FROM customer")
