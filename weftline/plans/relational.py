"""The query shapes that SQL analysis recognises, run natively: one SQL text for Spark and for the oracle, unless the dialects differ."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def money(x: str) -> str:
    """A sum that doesn't depend on the order of its terms."""
    return f"cast(sum(cast({x} AS decimal(18,4))) AS double)"


#: name -> SQL, or (Spark SQL, oracle SQL). {table} stands for a table.
SHAPES: dict[str, str | tuple[str, str]] = {
    "select_core": "SELECT c_mktsegment, count(*) AS n, " + money("c_acctbal") + " AS balance FROM {customer} WHERE c_acctbal > 0 GROUP BY c_mktsegment HAVING count(*) > 10",
    "projection_alias": "SELECT c_custkey AS id, c_name AS name, c_acctbal * 2 AS twice FROM {customer} WHERE c_nationkey = 3",
    "join_inner": "SELECT o.o_orderkey, c.c_name FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 100000",
    "join_left": "SELECT c.c_custkey, count(o.o_orderkey) AS n_orders FROM {customer} c LEFT JOIN {orders} o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F' GROUP BY c.c_custkey",
    "join_right": "SELECT n.n_name, count(s.s_suppkey) AS suppliers FROM {supplier} s RIGHT JOIN {nation} n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000 GROUP BY n.n_name",
    "join_full": "SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM {customer} WHERE c_acctbal < 0 GROUP BY c_nationkey) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM {supplier} WHERE s_acctbal > 9000 GROUP BY s_nationkey) b ON a.k = b.k",
    "join_cross": "SELECT r.r_name, n.n_name FROM {region} r CROSS JOIN {nation} n WHERE n.n_nationkey < 5",
    "join_comma": "SELECT n.n_name, r.r_name FROM {nation} n, {region} r WHERE n.n_regionkey = r.r_regionkey",
    "join_straight": "SELECT s.s_name, n.n_name FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey",
    "join_using": "SELECT k, a.n_name, b.suppliers FROM (SELECT n_nationkey AS k, n_name FROM {nation}) a JOIN (SELECT s_nationkey AS k, count(*) AS suppliers FROM {supplier} GROUP BY s_nationkey) b USING (k)",
    "join_natural": "SELECT k, n_name, suppliers FROM (SELECT n_nationkey AS k, n_name FROM {nation}) a NATURAL JOIN (SELECT s_nationkey AS k, count(*) AS suppliers FROM {supplier} GROUP BY s_nationkey) b",
    "join_theta_range": "SELECT b.lo, count(*) AS n FROM {orders} o JOIN (SELECT 0 AS lo, 50000 AS hi UNION ALL SELECT 50000, 150000 UNION ALL SELECT 150000, 1000000) b ON o.o_totalprice >= b.lo AND o.o_totalprice < b.hi GROUP BY b.lo",
    "join_semi_exists": "SELECT c_custkey, c_name FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 150000)",
    "join_semi_in": "SELECT p_partkey, p_brand FROM {part} WHERE p_partkey IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity >= 50)",
    "join_tuple_in": "SELECT l_orderkey, l_linenumber, l_partkey FROM {lineitem} WHERE (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM {lineitem} GROUP BY l_partkey, l_suppkey HAVING count(*) > 2)",
    "join_anti_not_exists": "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')",
    "join_anti_not_in": "SELECT n_name FROM {nation} WHERE n_nationkey NOT IN (SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 7000)",
    "join_any_subquery": ("SELECT c_custkey FROM {customer} WHERE c_nationkey IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 1)", "SELECT c_custkey FROM {customer} WHERE c_nationkey = ANY (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 1)"),
    "join_lateral": "SELECT n.n_name, x.n FROM {nation} n, LATERAL (SELECT count(*) AS n FROM {supplier} s WHERE s.s_nationkey = n.n_nationkey) x",
    "apply_outer": ("SELECT n.n_name, t.s_suppkey FROM {nation} n LEFT JOIN (SELECT s_nationkey, s_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM {supplier}) WHERE r = 1) t ON t.s_nationkey = n.n_nationkey", "SELECT n.n_name, t.s_suppkey FROM {nation} n LEFT JOIN LATERAL (SELECT s_suppkey FROM {supplier} s WHERE s.s_nationkey = n.n_nationkey ORDER BY s_acctbal DESC, s_suppkey LIMIT 1) t ON true"),
    "cte": "WITH big AS (SELECT o_custkey, " + money("o_totalprice") + " AS total FROM {orders} GROUP BY o_custkey), top AS (SELECT * FROM big WHERE total > 500000) SELECT c.c_name, t.total FROM top t JOIN {customer} c ON c.c_custkey = t.o_custkey",
    "cte_recursive": "WITH RECURSIVE walk(k, depth) AS (SELECT 1, 0 UNION ALL SELECT k * 2, depth + 1 FROM walk WHERE depth < 8) SELECT cast(k AS bigint) AS k, cast(depth AS bigint) AS depth, n.n_name FROM walk LEFT JOIN {nation} n ON n.n_nationkey = walk.k",
    "derived_table": "SELECT d.c_nationkey, d.n FROM (SELECT c_nationkey, count(*) AS n FROM {customer} GROUP BY c_nationkey) d WHERE d.n > 50",
    "scalar_subquery": "SELECT c_custkey, (SELECT count(*) FROM {orders} o WHERE o.o_custkey = c.c_custkey) AS n FROM {customer} c WHERE c_acctbal > (SELECT avg(c_acctbal) FROM {customer})",
    "set_union_all": "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}",
    "set_union": "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}",
    "set_intersect": "SELECT l_partkey AS k FROM {lineitem} WHERE l_quantity > 45 INTERSECT SELECT p_partkey FROM {part} WHERE p_size > 25",
    "set_except": "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'F'",
    "set_except_all": "SELECT l_suppkey AS k FROM {lineitem} EXCEPT ALL SELECT s_suppkey FROM {supplier}",
    "agg_basic": "SELECT l_returnflag, l_linestatus, count(*) AS n, " + money("l_quantity") + " AS quantity, " + money("l_extendedprice") + " AS price, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM {lineitem} GROUP BY l_returnflag, l_linestatus",
    "agg_count_distinct": "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders FROM {lineitem} GROUP BY l_suppkey",
    "agg_filter": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_orderstatus = 'O') AS open FROM {orders} GROUP BY o_orderpriority",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) >= 15",
    "agg_sum_case": "SELECT o_orderstatus, cast(sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) AS bigint) AS big FROM {orders} GROUP BY o_orderstatus",
    "agg_grouping_sets": "SELECT l_returnflag, l_linestatus, cast(grouping(l_returnflag) AS bigint) AS g, count(*) AS n FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())",
    "agg_cube": "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM {customer} GROUP BY CUBE (c_mktsegment, c_nationkey)",
    "agg_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "agg_listagg": ("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey"),
    "agg_percentile": "SELECT p_brand, percentile_cont(0.5) WITHIN GROUP (ORDER BY cast(p_size AS double)) AS median_size FROM {part} GROUP BY p_brand",
    "agg_stddev": "SELECT p_brand, round(stddev_samp(p_size), 6) AS sd FROM {part} GROUP BY p_brand",
    "agg_array": ("SELECT n_regionkey, array_join(array_sort(collect_list(n_name)), '|') AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(array_agg(n_name)), '|') AS names FROM {nation} GROUP BY n_regionkey"),
    "win_row_number": "SELECT o_custkey, o_orderkey, cast(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS bigint) AS r FROM {orders}",
    "win_rank_dense": "SELECT p_partkey, cast(rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS bigint) AS r, cast(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS bigint) AS d FROM {part}",
    "win_ntile": "SELECT c_custkey, cast(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS bigint) AS q FROM {customer}",
    "win_percent_cume": "SELECT p_partkey, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size), 9) AS p, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size), 9) AS c FROM {part}",
    "win_lag_lead": "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS later FROM {orders}",
    "win_first_last": "SELECT o_orderkey, first_value(o_orderkey) OVER w AS first_key, last_value(o_orderkey) OVER w AS last_key FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "win_running_rows": "SELECT o_orderkey, cast(sum(cast(o_totalprice AS decimal(18,4))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS double) AS running FROM {orders}",
    "win_moving_rows": "SELECT o_orderkey, cast(sum(cast(o_totalprice AS decimal(18,4))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS double) AS moving FROM {orders}",
    "distinct": "SELECT DISTINCT l_returnflag, l_linestatus FROM {lineitem}",
    "distinct_on": ("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM {orders}) WHERE r = 1", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM {orders} ORDER BY o_custkey, o_orderdate DESC, o_orderkey"),
    "topk_limit": "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "fetch_first": ("SELECT p_partkey FROM {part} ORDER BY p_retailprice DESC, p_partkey LIMIT 10", "SELECT p_partkey FROM {part} ORDER BY p_retailprice DESC, p_partkey FETCH FIRST 10 ROWS ONLY"),
    "case_when": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band FROM {customer}",
    "like_between": "SELECT p_partkey FROM {part} WHERE p_type LIKE '%O_O%' AND p_size BETWEEN 5 AND 15",
    "null_fns": "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment, round(abs(c_acctbal), 1) AS size FROM {customer}",
    "greatest_least": "SELECT l_orderkey, l_linenumber, greatest(l_discount, l_tax) AS most, least(l_discount, l_tax) AS fewest FROM {lineitem} WHERE l_linenumber = 1",
    "string_fns": "SELECT c_custkey, concat(c_name, '-', c_mktsegment) AS label, lpad(cast(c_custkey AS varchar(10)), 8, '0') AS padded, upper(substring(c_mktsegment, 1, 3)) AS short, replace(c_name, '#', ':') AS renamed, length(trim(c_name)) AS n FROM {customer}",
    "date_fns": ("SELECT o_orderkey, cast(date_trunc('month', o_orderdate) AS date) AS month, date_format(o_orderdate, 'yyyy-MM') AS label, cast(datediff(DATE '1999-01-01', cast(o_orderdate AS date)) AS bigint) AS days, cast(o_orderdate + INTERVAL '7' DAY AS date) AS later, cast(extract(YEAR FROM o_orderdate) AS bigint) AS y FROM {orders}", "SELECT o_orderkey, cast(date_trunc('month', o_orderdate) AS date) AS month, strftime(o_orderdate, '%Y-%m') AS label, datediff('day', cast(o_orderdate AS date), DATE '1999-01-01') AS days, cast(o_orderdate + INTERVAL 7 DAY AS date) AS later, extract(YEAR FROM o_orderdate) AS y FROM {orders}"),
    "json_fns": ("SELECT event_id, get_json_object(props, '$.k') AS k, to_json(named_struct('id', event_id, 'kind', event_type)) AS made FROM {events}", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_object('id', event_id, 'kind', event_type)::VARCHAR AS made FROM {events}"),
    "json_table": ("SELECT event_id, p.key AS name, p.value AS value FROM {events} LATERAL VIEW explode(from_json(props, 'map<string,string>')) p AS key, value", "SELECT event_id, name, json_extract_string(props, '$.' || name) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS name FROM {events})"),
    "array_explode": ("SELECT n_nationkey, x FROM {nation} LATERAL VIEW explode(split(n_name, 'A')) t AS x", "SELECT n_nationkey, unnest(string_split(n_name, 'A')) AS x FROM {nation}"),
    "table_function": ("SELECT cast(id AS bigint) AS k, n_name FROM range(0, 10) JOIN {nation} ON n_nationkey = id", "SELECT cast(range AS bigint) AS k, n_name FROM range(0, 10) JOIN {nation} ON n_nationkey = range"),
    "pivot": ("SELECT * FROM (SELECT o_orderpriority, o_orderstatus FROM {orders}) PIVOT (count(*) FOR o_orderstatus IN ('F' AS f, 'O' AS o))", "SELECT o_orderpriority, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS o FROM {orders} GROUP BY o_orderpriority"),
    "unpivot": "SELECT r_regionkey, name, value FROM (SELECT r_regionkey, cast(length(r_name) AS bigint) AS len, cast(r_regionkey * 2 AS bigint) AS twice FROM {region}) UNPIVOT (value FOR name IN (len, twice))",
    "upsert_merge": "SELECT coalesce(s.k, t.k) AS k, CASE WHEN s.k IS NULL THEN t.v WHEN t.k IS NULL THEN s.v ELSE t.v + s.v END AS v FROM (SELECT c_nationkey AS k, count(*) AS v FROM {customer} WHERE c_nationkey < 15 GROUP BY c_nationkey) t FULL JOIN (SELECT s_nationkey AS k, count(*) AS v FROM {supplier} WHERE s_nationkey > 9 GROUP BY s_nationkey) s ON s.k = t.k",
    "update_from": "SELECT c.c_custkey, coalesce(o.total, 0) AS c_acctbal FROM {customer} c LEFT JOIN (SELECT o_custkey, " + money("o_totalprice") + " AS total FROM {orders} GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey",
    "delete_exists": "SELECT o.o_orderkey FROM {orders} o WHERE NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')",
    "map_build": ("SELECT n_regionkey, array_join(map_keys(map_from_entries(array_sort(collect_list(struct(n_name, n_nationkey))))), ',') AS ks FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(map_keys(map_from_entries(array_agg((n_name, n_nationkey))))), ',') AS ks FROM {nation} GROUP BY n_regionkey"),
}
SHAPES["tablesample_whole"] = ("SELECT l_returnflag, count(*) AS n FROM {lineitem} TABLESAMPLE (100 PERCENT) GROUP BY l_returnflag", "SELECT l_returnflag, count(*) AS n FROM {lineitem} GROUP BY l_returnflag")
SHAPES["kpi_union"] = " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {{{t}}}" for t in TABLES)
SHAPES["margin"] = "SELECT p.p_brand, count(*) AS lines, cast(sum(cast(l.l_extendedprice AS decimal(18,4)) * (1 - cast(l.l_discount AS decimal(18,4)))) AS double) AS revenue FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey JOIN {supplier} s ON s.s_suppkey = l.l_suppkey JOIN {nation} n ON n.n_nationkey = s.s_nationkey WHERE n.n_regionkey IN (1, 2) GROUP BY p.p_brand"


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The tables are passed by name, so no view is left in the session."""
    used = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def _query(sql: str):
    return lambda spark, sf_dir: run(spark, sf_dir, sql)


QUERIES = {name: _query(x if isinstance(x, str) else x[0]) for name, x in SHAPES.items()}
ORACLES = {name: re.sub(r"\{(\w+)\}", r"\1", x if isinstance(x, str) else x[1]) for name, x in SHAPES.items()}
