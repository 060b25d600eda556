"""Filters, projections, joins, aggregates, windows and functions of earlier rows."""

from __future__ import annotations

from .base import table

#: Most rows have a ``v``: the value of clicks and views, else null.
V = "CASE WHEN event_type = 'click' OR event_type = 'view' THEN value END"
T = "epoch_us(ts) // 1000"

ROWS = [
    # --- filters and predicates
    ("scan_events", "SELECT * FROM events", "SELECT event_id, ts, user_id, event_type, value, props FROM events"),
    ("filter_cmp", "SELECT event_id, value FROM events WHERE value > 50 AND event_type = 'click'", "SELECT event_id, value FROM events WHERE value > 50 AND event_type = 'click'"),
    ("filter_or", "SELECT event_id FROM events WHERE value < 1 OR (user_id >= 140 AND event_type != 'view')", "SELECT event_id FROM events WHERE value < 1 OR (user_id >= 140 AND event_type <> 'view')"),
    ("filter_time_millis", "SELECT event_id FROM events WHERE ts >= 1705276800000", "SELECT event_id FROM events WHERE epoch_ms(ts) >= 1705276800000"),
    ("null_comparison", f"SELECT event_id, {V} AS v, v > 20 AS more, v != 20 AS other FROM events", f"SELECT event_id, v, coalesce(v > 20, false) AS more, coalesce(v <> 20, false) AS other FROM (SELECT *, {V} AS v FROM events)"),
    ("null_arithmetic", f"SELECT event_id, {V} AS v, v + 1 AS a, v * 2 AS m FROM events", f"SELECT event_id, v, v + 1 AS a, v * 2 AS m FROM (SELECT *, {V} AS v FROM events)"),
    ("null_filter", f"SELECT event_id, {V} AS v FROM events WHERE v != 20", f"SELECT event_id, v FROM (SELECT *, {V} AS v FROM events) WHERE v <> 20"),
    ("in_list", "SELECT event_id FROM events WHERE event_type IN ('click', 'error')", "SELECT event_id FROM events WHERE event_type IN ('click', 'error')"),
    ("not_in_list", "SELECT event_id FROM events WHERE user_id NOT IN (1, 2, 3) AND event_type NOT IN ('view')", "SELECT event_id FROM events WHERE user_id NOT IN (1, 2, 3) AND event_type <> 'view'"),
    ("in_array", "SELECT event_id FROM events WHERE user_id IN sequence(5, 20, 5)", "SELECT event_id FROM events WHERE user_id IN (5, 10, 15, 20)"),
    ("between", "SELECT event_id, value BETWEEN 10 AND 20 AS b FROM events WHERE user_id NOT BETWEEN 10 AND 100", "SELECT event_id, value BETWEEN 10 AND 20 AS b FROM events WHERE user_id NOT BETWEEN 10 AND 100"),
    ("between_null", f"SELECT event_id, {V} BETWEEN 10 AND 20 AS b, {V} NOT BETWEEN 10 AND 20 AS n FROM events", f"SELECT event_id, coalesce({V} BETWEEN 10 AND 20, false) AS b, coalesce({V} NOT BETWEEN 10 AND 20, false) AS n FROM events"),
    ("like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ing' AND p_brand LIKE 'Brand#_'", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ing' AND p_brand LIKE 'Brand#_'"),
    ("not_like", "SELECT p_partkey FROM part WHERE p_name NOT LIKE 'red%'", "SELECT p_partkey FROM part WHERE p_name NOT LIKE 'red%'"),
    ("int_division", "SELECT event_id, (user_id - 75) / 7 AS q, (user_id - 75) % 7 AS r, value / 4 AS h FROM events", "SELECT event_id, CAST(trunc((user_id - 75) / 7.0) AS BIGINT) AS q, (user_id - 75) % 7 AS r, value / 4 AS h FROM events"),
    ("arithmetic", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) + l_tax AS p, -l_quantity AS n FROM lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) + l_tax AS p, -l_quantity AS n FROM lineitem"),
    ("bitwise", "SELECT event_id, user_id & 12 AS a, user_id | 3 AS o, user_id ^ 5 AS x FROM events", "SELECT event_id, user_id & 12 AS a, user_id | 3 AS o, xor(user_id, 5) AS x FROM events"),
    ("case_searched", "SELECT event_id, CASE WHEN value > 50 THEN 'high' WHEN value > 10 THEN 'mid' ELSE 'low' END AS k FROM events", "SELECT event_id, CASE WHEN value > 50 THEN 'high' WHEN value > 10 THEN 'mid' ELSE 'low' END AS k FROM events"),
    ("case_simple", "SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 END AS k FROM events", "SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 END::BIGINT AS k FROM events"),
    # --- projections
    ("project_alias_chain", "SELECT event_id, value * 2 AS a, a + 1 AS b, a + b AS c FROM events WHERE b > 30", "SELECT event_id, value * 2 AS a, value * 2 + 1 AS b, value * 2 + (value * 2 + 1) AS c FROM events WHERE value * 2 + 1 > 30"),
    ("wildcard_except", "SELECT * EXCEPT(ts, props) FROM events", "SELECT event_id, user_id, event_type, value FROM events"),
    ("wildcard_replace", "SELECT * EXCEPT(ts) REPLACE(value * 10 AS value) FROM events", "SELECT event_id, user_id, event_type, value * 10 AS value, props FROM events"),
    ("invisible", "SELECT event_id, value * 3 AS t INVISIBLE, t + 1 AS u FROM events", "SELECT event_id, value * 3 + 1 AS u FROM events"),
    ("json_access", "SELECT event_id, cast(props->k, 'bigint') AS k FROM events WHERE cast(props->k, 'bigint') > 50", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50"),
    ("array_index", "SELECT vec_id, embedding[0] AS first, embedding[-1] AS last, cardinality(embedding[1:4]) AS n FROM embeddings", "SELECT vec_id, embedding[1] AS first, embedding[-1] AS last, 3::BIGINT AS n FROM embeddings"),
    ("unnest", "SELECT vec_id, unnest(embedding[0:3]) AS x FROM embeddings", "SELECT vec_id, unnest(embedding[1:3]) AS x FROM embeddings"),
    ("unnest_pairs", "SELECT conv_id, turn, unnest(obj_to_kvpair_array(object_construct('r', role, 'n', cast(turn, 'string')))) AS kv FROM conversations", "SELECT conv_id, turn, 'r' AS key, role AS value FROM conversations UNION ALL SELECT conv_id, turn, 'n', turn::VARCHAR FROM conversations"),
    # --- joins
    ("join_inner", "SELECT o_orderkey, c_name FROM orders INNER JOIN customer ON orders.o_custkey = customer.c_custkey WHERE o_totalprice > 200000", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000"),
    ("join_left", "SELECT o.o_orderkey, c.c_name FROM orders AS o LEFT JOIN customer AS c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 5000", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 5000"),
    ("join_right", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey"),
    ("join_full", "SELECT s_suppkey, n_name FROM supplier FULL JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000", "SELECT s_suppkey, n_name FROM supplier FULL JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000"),
    ("join_cross", "SELECT n_name, r_name FROM nation CROSS JOIN region", "SELECT n_name, r_name FROM nation CROSS JOIN region"),
    ("join_theta", "SELECT s_suppkey, n_nationkey FROM supplier INNER JOIN nation ON s_nationkey < n_nationkey AND n_regionkey = 1", "SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey < n_nationkey AND n_regionkey = 1"),
    ("join_multi", "SELECT s_name, n_name, r_name FROM supplier INNER JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_name != 'ASIA'", "SELECT s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'"),
    ("join_windowed", "SELECT window_end() AS e, count(*) AS n, round(sum(l_quantity), 2) AS q FROM orders INNER JOIN lineitem ON o_orderkey = l_orderkey GROUP BY TUMBLINGWINDOW(dd, 7)", "SELECT CAST((o // 604800000 + 1) * 604800000 AS BIGINT) AS e, count(*) AS n, round(sum(l_quantity), 2) AS q FROM (SELECT *, epoch_ms(o_orderdate) AS o, epoch_ms(l_shipdate) AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey) WHERE o // 604800000 = s // 604800000 GROUP BY 1"),
    ("join_windowed_left", "SELECT window_end() AS e, count(*) AS n, count(l_orderkey) AS m FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY TUMBLINGWINDOW(dd, 30)", "SELECT CAST((epoch_ms(o_orderdate) // 2592000000 + 1) * 2592000000 AS BIGINT) AS e, count(*) AS n, count(l_orderkey) AS m FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND epoch_ms(o_orderdate) // 2592000000 = epoch_ms(l_shipdate) // 2592000000 GROUP BY 1"),
    ("join_group", "SELECT n_name, count(*) AS n, round(avg(c_acctbal), 6) AS b FROM customer INNER JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) > 50", "SELECT n_name, count(*) AS n, round(avg(c_acctbal), 6) AS b FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) > 50"),
    # --- aggregates
    ("agg_count", f"SELECT event_type, count(*) AS n, count({V}) AS v FROM events GROUP BY event_type", f"SELECT event_type, count(*) AS n, count({V}) AS v FROM events GROUP BY event_type"),
    ("agg_avg", f"SELECT event_type, avg(user_id) AS i, round(avg(value), 6) AS f, round(avg({V}), 6) AS v FROM events GROUP BY event_type", f"SELECT event_type, CAST(sum(user_id) // count(user_id) AS BIGINT) AS i, round(avg(value), 6) AS f, round(avg({V}), 6) AS v FROM events GROUP BY event_type"),
    ("agg_min_max_sum", "SELECT event_type, min(value) AS lo, max(value) AS hi, sum(user_id) AS s, round(sum(value), 3) AS f FROM events GROUP BY event_type", "SELECT event_type, min(value) AS lo, max(value) AS hi, sum(user_id)::BIGINT AS s, round(sum(value), 3) AS f FROM events GROUP BY event_type"),
    ("agg_median", "SELECT event_type, median(value) AS m FROM events GROUP BY event_type", "SELECT event_type, median(value) AS m FROM events GROUP BY event_type"),
    ("agg_spread", "SELECT event_type, round(stddev(value), 6) AS sp, round(stddevs(value), 6) AS ss, round(var(value), 6) AS vp, round(vars(value), 6) AS vs FROM events GROUP BY event_type", "SELECT event_type, round(stddev_pop(value), 6) AS sp, round(stddev_samp(value), 6) AS ss, round(var_pop(value), 6) AS vp, round(var_samp(value), 6) AS vs FROM events GROUP BY event_type"),
    ("agg_percentile_cont", "SELECT event_type, percentile_cont(value, 0.9) AS p FROM events GROUP BY event_type", "SELECT event_type, CASE WHEN r = floor(r) THEN l[r::INT] WHEN r > 1 THEN (l[floor(r)::INT] + l[floor(r)::INT + 1]) / 2 END AS p FROM (SELECT event_type, list(value ORDER BY value) AS l, 0.9::DOUBLE * count(*) AS r FROM events GROUP BY event_type)"),
    ("agg_percentile_disc", "SELECT event_type, percentile_disc(value, 0.9) AS p FROM events GROUP BY event_type", "SELECT event_type, l[greatest(1, ceil(0.9::DOUBLE * len(l)))::INT] AS p FROM (SELECT event_type, list(value ORDER BY value) AS l FROM events GROUP BY event_type)"),
    ("agg_collect", f"SELECT user_id, collect({V}) AS l FROM events GROUP BY user_id", f"SELECT user_id, list({V} ORDER BY ts) AS l FROM events GROUP BY user_id"),
    ("agg_inc_collect", f"SELECT user_id, inc_collect({V}) AS l FROM events GROUP BY user_id", f"SELECT user_id, list({V} ORDER BY ts) AS l FROM events GROUP BY user_id"),
    ("agg_inc_merge", "SELECT user_id, cardinality(items(inc_merge_agg(object_construct(event_type, event_id)))) AS n FROM events GROUP BY user_id", "SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY user_id"),
    ("agg_last_value", f"SELECT event_type, last_value(value, false) AS v, last_value({V}, true) AS w FROM events GROUP BY event_type", f"SELECT event_type, arg_max(value, ts) AS v, arg_max({V}, ts) FILTER ({V} IS NOT NULL) AS w FROM events GROUP BY event_type"),
    ("agg_merge", "SELECT user_id, cardinality(items(merge_agg(object_construct(event_type, event_id)))) AS n, merge_agg(object_construct(event_type, event_id))->click AS c FROM events GROUP BY user_id", "SELECT user_id, count(DISTINCT event_type) AS n, arg_max(event_id, ts) FILTER (event_type = 'click') AS c FROM events GROUP BY user_id"),
    ("deduplicate_count", "SELECT user_id, cardinality(deduplicate(event_type, true)) AS n FROM events GROUP BY user_id", "SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY user_id"),
    ("deduplicate_last", "SELECT window_end() AS e, deduplicate(user_id, false)->event_id AS i FROM events GROUP BY TUMBLINGWINDOW(hh, 1)", "SELECT e, CASE WHEN n = 1 THEN event_id END AS i FROM (SELECT (epoch_ms(ts) // 3600000 + 1)::BIGINT * 3600000 AS e, event_id, count(*) OVER (PARTITION BY epoch_ms(ts) // 3600000, user_id) AS n, row_number() OVER (PARTITION BY epoch_ms(ts) // 3600000 ORDER BY ts DESC) AS r FROM events) WHERE r = 1"),
    ("agg_incremental", "SELECT event_type, inc_count(*) AS n, inc_avg(user_id) AS a, inc_sum(user_id) AS s, inc_max(value) AS hi, inc_min(value) AS lo, inc_last_value(value, true) AS l FROM events GROUP BY event_type", "SELECT event_type, count(*) AS n, avg(user_id) AS a, sum(user_id)::DOUBLE AS s, max(value) AS hi, min(value) AS lo, arg_max(value, ts) AS l FROM events GROUP BY event_type"),
    ("agg_global", "SELECT count(*) AS n, max(value) AS m FROM events WHERE event_type = 'view'", "SELECT count(*) AS n, max(value) AS m FROM events WHERE event_type = 'view'"),
    ("agg_filter", "SELECT event_type, count(*) FILTER(WHERE value > 20) AS n, sum(user_id) FILTER(WHERE user_id > 100) AS s FROM events GROUP BY event_type", "SELECT event_type, count(*) FILTER (value > 20) AS n, sum(user_id) FILTER (user_id > 100)::BIGINT AS s FROM events GROUP BY event_type"),
    ("agg_first_column", "SELECT user_id, event_id, count(*) AS n FROM events GROUP BY user_id", "SELECT user_id, arg_min(event_id, ts) AS event_id, count(*) AS n FROM events GROUP BY user_id"),
    ("group_expression", "SELECT user_id % 10 AS k, count(*) AS n FROM events GROUP BY user_id % 10", "SELECT user_id % 10 AS k, count(*) AS n FROM events GROUP BY 1"),
    ("group_by_lineitem", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= 904608000000 GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE epoch_ms(l_shipdate) <= 904608000000 GROUP BY l_returnflag, l_linestatus"),
    ("having", "SELECT user_id, count(*) AS n, round(avg(value), 6) AS a FROM events GROUP BY user_id HAVING n > 60 AND avg(value) > 10", "SELECT user_id, count(*) AS n, round(avg(value), 6) AS a FROM events GROUP BY user_id HAVING count(*) > 60 AND avg(value) > 10"),
    ("agg_in_where", "SELECT event_id, value FROM events WHERE value > avg(value) GROUP BY TUMBLINGWINDOW(dd, 1)", "SELECT event_id, value FROM (SELECT *, avg(value) OVER (PARTITION BY epoch_ms(ts) // 86400000) AS a FROM events) WHERE value > a"),
    # --- order, limit, numbers
    ("order_limit", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 10", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 10"),
    ("order_nulls_last", f"SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY {V} DESC, event_id) AS r FROM events", f"SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY {V} DESC NULLS LAST, event_id) AS r FROM events"),
    ("order_nulls_last_ascending", f"SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY {V}, event_id) AS r FROM events", f"SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY {V} NULLS LAST, event_id) AS r FROM events"),
    ("limit_per_window", "SELECT event_id, value FROM events GROUP BY TUMBLINGWINDOW(dd, 1) ORDER BY value DESC, event_id LIMIT 3", "SELECT event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY epoch_ms(ts) // 86400000 ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 3"),
    ("row_number_in_window", "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS r FROM events GROUP BY TUMBLINGWINDOW(dd, 1)", "SELECT event_id, row_number() OVER (PARTITION BY epoch_ms(ts) // 86400000, event_type ORDER BY value, event_id) AS r FROM events"),
    # --- windows
    ("tumbling_count", "SELECT event_type, window_end() AS e, count(*) AS c, round(sum(value), 3) AS s FROM events WHERE value > 10 GROUP BY event_type, TUMBLINGWINDOW(hh, 1)", "SELECT event_type, (epoch_ms(ts) // 3600000 + 1)::BIGINT * 3600000 AS e, count(*) AS c, round(sum(value), 3) AS s FROM events WHERE value > 10 GROUP BY ALL"),
    ("tumbling_filter", "SELECT window_end() AS e, count(*) AS c FROM events GROUP BY TUMBLINGWINDOW(mi, 90) FILTER(WHERE event_type = 'error')", "SELECT (epoch_ms(ts) // 5400000 + 1)::BIGINT * 5400000 AS e, count(*) AS c FROM events WHERE event_type = 'error' GROUP BY ALL"),
    ("window_meta_functions", "SELECT event_id, window_start() AS a, window_end() AS b, window_trigger() AS c, event_time() AS d FROM events GROUP BY TUMBLINGWINDOW(hh, 6)", "SELECT event_id, w * 21600000 AS a, (w + 1) * 21600000 AS b, (w + 1) * 21600000 AS c, (w + 1) * 21600000 AS d FROM (SELECT event_id, (epoch_ms(ts) // 21600000)::BIGINT AS w FROM events)"),
    ("hopping", "SELECT window_end() AS e, count(*) AS c, max(value) AS m FROM events GROUP BY HOPPINGWINDOW(hh, 3, 1)", "SELECT (epoch_ms(ts) // 3600000 + k)::BIGINT * 3600000 AS e, count(*) AS c, max(value) AS m FROM events, (VALUES (1), (2), (3)) v(k) GROUP BY ALL"),
    ("sliding", "SELECT window_end() AS e, count(*) AS c, min(value) AS m FROM events GROUP BY SLIDINGWINDOW(mi, 20)", f"WITH e AS (SELECT *, {T} AS t FROM events) SELECT a.t AS e, count(*) AS c, min(b.value) AS m FROM e a JOIN e b ON b.t BETWEEN a.t - 1200000 AND a.t GROUP BY a.event_id, a.t"),
    ("sliding_delay", "SELECT window_end() AS e, count(*) AS c FROM events GROUP BY SLIDINGWINDOW(mi, 10, 5)", f"WITH e AS (SELECT *, {T} AS t FROM events) SELECT a.t + 300000 AS e, count(*) AS c FROM e a JOIN e b ON b.t >= a.t - 600000 AND b.t < a.t + 300000 GROUP BY a.event_id, a.t"),
    ("sliding_over_when", "SELECT window_end() AS e, count(*) AS c FROM events GROUP BY SLIDINGWINDOW(mi, 30) OVER(WHEN event_type = 'error')", f"WITH e AS (SELECT *, {T} AS t FROM events) SELECT a.t AS e, count(*) AS c FROM e a JOIN e b ON b.t BETWEEN a.t - 1800000 AND a.t WHERE a.event_type = 'error' GROUP BY a.event_id, a.t"),
    ("sliding_filter", "SELECT window_end() AS e, count(*) AS c FROM events GROUP BY SLIDINGWINDOW(hh, 1) FILTER(WHERE event_type = 'error') OVER(WHEN value > 10)", f"WITH e AS (SELECT *, {T} AS t FROM events WHERE event_type = 'error') SELECT a.t AS e, count(*) AS c FROM e a JOIN e b ON b.t BETWEEN a.t - 3600000 AND a.t WHERE a.value > 10 GROUP BY a.event_id, a.t"),
    (
        "session_gap",
        "SELECT window_start() AS a, window_end() AS b, count(*) AS c FROM events GROUP BY SESSIONWINDOW(mi, 120, 8)",
        f"WITH RECURSIVE e AS (SELECT {T} AS t FROM events), f AS (SELECT t, CASE WHEN t - lag(t) OVER (ORDER BY t) <= 480000 THEN 0 ELSE 1 END AS n FROM e), g AS (SELECT t, sum(n) OVER (ORDER BY t) AS r FROM f), c AS (SELECT r, t // 7200000 AS k, min(t) AS lo FROM g GROUP BY ALL), "
        "d AS (SELECT r, k, CASE WHEN lo = k * 7200000 THEN k + 1 ELSE k + 2 END AS z, lead(k) OVER w AS k1, lead(k, 2) OVER w AS k2, row_number() OVER w AS n FROM c WINDOW w AS (PARTITION BY r ORDER BY k)), "
        "s AS (SELECT r, k, z, CASE WHEN k1 >= z THEN k1 ELSE k2 END AS nx FROM d WHERE n = 1 UNION ALL SELECT d.r, d.k, d.z, CASE WHEN d.k1 >= d.z THEN d.k1 ELSE d.k2 END FROM s JOIN d ON d.r = s.r AND d.k = s.nx) "
        "SELECT min(t) AS a, least(max(t) + 480000, s.z * 7200000)::BIGINT AS b, count(*) AS c FROM g JOIN s ON g.r = s.r AND t // 7200000 >= s.k AND t // 7200000 < s.z GROUP BY s.r, s.k, s.z",
    ),
    ("count_tumbling", "SELECT count(*) AS c, max(event_id) AS m, min(value) AS v FROM events GROUP BY COUNTWINDOW(7)", "SELECT count(*) AS c, max(event_id) AS m, min(value) AS v FROM (SELECT *, (row_number() OVER (ORDER BY ts) - 1) // 7 AS g FROM events) GROUP BY g HAVING count(*) = 7"),
    ("count_sliding", "SELECT count(*) AS c, max(event_id) AS m, round(sum(value), 3) AS s FROM events GROUP BY COUNTWINDOW(10, 4)", "SELECT count(*) AS c, max(b.event_id) AS m, round(sum(b.value), 3) AS s FROM (SELECT row_number() OVER (ORDER BY ts) AS n FROM events) a JOIN (SELECT *, row_number() OVER (ORDER BY ts) AS n FROM events) b ON b.n > a.n - 12 AND b.n <= a.n // 4 * 4 AND b.n > a.n // 4 * 4 - 10 WHERE a.n % 4 = 0 AND a.n >= 10 GROUP BY a.n"),
    ("count_partition", "SELECT user_id, count(*) AS c, max(event_id) AS m FROM events GROUP BY COUNTWINDOW(5) OVER(PARTITION BY user_id)", "SELECT user_id, count(*) AS c, max(event_id) AS m FROM (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1) // 5 AS g FROM events) GROUP BY user_id, g HAVING count(*) = 5"),
    ("state_single", "SELECT count(*) AS c, min(event_id) AS a, max(event_id) AS z FROM events GROUP BY STATEWINDOW(event_type = 'signup')", "SELECT count(*) AS c, min(event_id) AS a, max(event_id) AS z FROM (SELECT *, max(g) OVER () AS l FROM (SELECT *, sum((event_type = 'signup')::INT) OVER (ORDER BY ts) AS g FROM events)) WHERE g > 0 AND g < l GROUP BY g"),
    ("state_partition", "SELECT user_id, count(*) AS c, min(event_id) AS a FROM events GROUP BY STATEWINDOW(event_type = 'signup') OVER(PARTITION BY user_id)", "SELECT user_id, count(*) AS c, min(event_id) AS a FROM (SELECT *, max(g) OVER (PARTITION BY user_id) AS l FROM (SELECT *, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM events)) WHERE g > 0 AND g < l GROUP BY user_id, g"),
    (
        "state_begin_emit",
        "SELECT count(*) AS c, min(event_id) AS a, max(event_id) AS z FROM events GROUP BY STATEWINDOW(event_type = 'signup', event_type = 'error')",
        "WITH e AS (SELECT *, event_type = 'signup' AS b, event_type = 'error' AS x FROM events), p AS (SELECT *, coalesce(last_value(CASE WHEN x THEN false WHEN b THEN true END IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS o FROM e), "
        "g AS (SELECT *, sum((b AND NOT o)::INT) OVER (ORDER BY ts) AS g FROM p) SELECT count(*) AS c, min(event_id) AS a, max(event_id) AS z FROM g WHERE o OR b GROUP BY g HAVING bool_or(x)",
    ),
    # --- functions of earlier rows
    ("lag", "SELECT event_id, lag(value) AS l, lag(event_type, 1, 'none') AS d FROM events", "SELECT event_id, lag(value) OVER (ORDER BY ts) AS l, lag(event_type, 1, 'none') OVER (ORDER BY ts) AS d FROM events"),
    ("lag_offset", "SELECT event_id, lag(value, 3) AS l FROM events", "SELECT event_id, lag(value, 3) OVER (ORDER BY ts) AS l FROM events"),
    ("lag_ignore_null", f"SELECT event_id, lag({V}) AS l FROM events", f"SELECT event_id, last_value({V} IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM events"),
    ("lag_partition_when", "SELECT event_id, lag(value) OVER (PARTITION BY user_id WHEN event_type = 'click') AS l FROM events", "SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM events"),
    ("latest", f"SELECT event_id, latest({V}, 0.5) OVER (PARTITION BY user_id) AS l FROM events", f"SELECT event_id, coalesce(last_value({V} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING), 0.5) AS l FROM events"),
    ("changed_col", "SELECT event_id, changed_col(true, event_type) OVER (PARTITION BY user_id) AS c FROM events", "SELECT event_id, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) THEN event_type END AS c FROM events"),
    ("had_changed", "SELECT event_id, had_changed(true, event_type, user_id) AS h FROM events WHERE had_changed(true, event_type) = true", "SELECT event_id, true AS h FROM (SELECT *, lag(event_type) OVER (ORDER BY ts) AS p FROM events) WHERE event_type IS DISTINCT FROM p"),
    ("changed_cols", "SELECT event_id, changed_cols('n_', true, event_type, user_id) FROM events", "SELECT event_id, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (ORDER BY ts) THEN event_type END AS n_event_type, CASE WHEN user_id IS DISTINCT FROM lag(user_id) OVER (ORDER BY ts) THEN user_id END AS n_user_id FROM events"),
    ("acc_functions", "SELECT event_id, acc_count(value) AS n, acc_max(value) AS hi, acc_min(value) AS lo, round(acc_sum(value), 2) AS s, acc_avg(user_id) AS a FROM events", "SELECT event_id, count(value) OVER w AS n, max(value) OVER w AS hi, min(value) OVER w AS lo, round(sum(value) OVER w, 2) AS s, avg(user_id) OVER w AS a FROM events WINDOW w AS (ORDER BY ts ROWS UNBOUNDED PRECEDING)"),
    ("acc_partition", "SELECT event_id, acc_count(value) OVER (PARTITION BY user_id WHEN value > 5) AS n, acc_max(value) OVER (PARTITION BY user_id) AS hi FROM events", "SELECT event_id, count(CASE WHEN value > 5 THEN 1 END) OVER w AS n, max(value) OVER w AS hi FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)"),
    ("acc_begin_reset", "SELECT event_id, acc_count(value, event_type = 'signup', event_type = 'error') AS n FROM events", "WITH l AS (SELECT *, coalesce(sum((event_type = 'error')::INT) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lap FROM events), b AS (SELECT *, max((event_type = 'signup')::INT) OVER (PARTITION BY lap ORDER BY ts) AS on_ FROM l) SELECT event_id, count(CASE WHEN on_ = 1 THEN value END) OVER (PARTITION BY lap ORDER BY ts) AS n FROM b"),
    ("row_state_filter", "SELECT event_id, lag(event_id) AS p FROM events WHERE event_type = 'error'", "SELECT event_id, p FROM (SELECT *, lag(event_id) OVER (ORDER BY ts) AS p FROM events) WHERE event_type = 'error'"),
    (
        "last_hit_time",
        "SELECT event_id FROM events WHERE event_time() - last_hit_time() > 3600000",
        f"WITH RECURSIVE e AS (SELECT event_id, {T} AS t FROM events), r AS ((SELECT event_id, t FROM e WHERE t > 3600000 ORDER BY t LIMIT 1) UNION ALL (SELECT n.event_id, n.t FROM r, LATERAL (SELECT min(e.t) AS t, arg_min(e.event_id, e.t) AS event_id FROM e WHERE e.t > r.t + 3600000) n WHERE n.t IS NOT NULL)) SELECT event_id FROM r",
    ),
    ("last_hit_count", "SELECT event_id FROM events WHERE event_type = 'error' AND last_hit_count() < 20", "SELECT event_id FROM events WHERE event_type = 'error' ORDER BY ts LIMIT 20"),
    ("last_agg_hit_count", "SELECT window_end() AS e, count(*) AS c, last_agg_hit_count() AS n FROM events GROUP BY TUMBLINGWINDOW(dd, 1) HAVING c > 340 AND last_agg_hit_count() < 5", "SELECT e, c, n FROM (SELECT *, row_number() OVER (ORDER BY e) - 1 AS n FROM (SELECT (epoch_ms(ts) // 86400000 + 1)::BIGINT * 86400000 AS e, count(*) AS c FROM events GROUP BY 1) WHERE c > 340) WHERE n < 5"),
]

QUERIES, ORACLE_SQL = table(ROWS)
