"""Queries of the graph engine by name, with DuckDB SQL that computes the same rows.

The graphs come from the star schema and event tables (``sources.commerce``): R joins each part to the
supplier that ships most of it and each supplier to the part it ships most of, WHOLE is the
supplier-part graph of all lines, F the directed multigraph of users in turn.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import PropertyGraph
from .operators import centrality, community, crud, flow, matrix, metrics, structure, subgraph, traverse
from .operators.common import shared_folder
from .plans.writer import is_read_only
from .sources import commerce

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

R, WHOLE, FOLLOWS = ["MAIN_SUPPLIER", "MAIN_PART"], "SUPPLIES", "FOLLOWS"
USER_1 = 7 * 10**12 + 1


_last: dict[tuple[str, str], PropertyGraph] = {}


def commerce_graph(spark: SparkSession, sf: str) -> PropertyGraph:
    """The graph over these tables; the last one is kept, as a plan only."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _last:
        _last.clear()
        _last[key] = commerce.commerce_graph(spark, sf)
    return _last[key]


def cypher(name: str, text: str, sql: str, **params) -> None:
    QUERIES[name] = lambda spark, sf: commerce_graph(spark, sf).query(text, params)
    SQL[name] = sql


def add(name: str, run: Callable, sql: str | None = None) -> None:
    """``run`` takes the commerce graph."""
    QUERIES[name] = lambda spark, sf: run(commerce_graph(spark, sf))
    if sql:
        SQL[name] = sql


def one(spark: SparkSession, **values) -> DataFrame:
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


# ---- patterns, clauses, functions, aggregates -------------------------------------------------
cypher(
    "flagship",
    "MATCH (c:Customer)-[:LOCATED_IN]->(n:Nation) WHERE c.acctbal > 1000 RETURN n.name AS nation, count(c) AS customers, round(avg(c.acctbal), 4) AS avg_bal ORDER BY customers DESC, nation LIMIT 10",
    "SELECT n_name AS nation, count(*) AS customers, round(avg(c_acctbal), 4) AS avg_bal FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 1000 GROUP BY 1 ORDER BY customers DESC, nation LIMIT 10",
)
cypher("match_label_scan", "MATCH (s:Supplier) RETURN s.key AS key, s.name AS name, s.acctbal AS bal", "SELECT s_suppkey AS key, s_name AS name, s_acctbal AS bal FROM supplier")
cypher("match_inline_props", "MATCH (p:Part {brand: 'Brand#2', size: 11}) RETURN p.key AS key, p.price AS price", "SELECT p_partkey AS key, p_retailprice AS price FROM part WHERE p_brand = 'Brand#2' AND p_size = 11")
cypher("match_out", "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.total > 100000 RETURN c.key AS c, o.key AS o", "SELECT o_custkey AS c, o_orderkey AS o FROM orders WHERE o_totalprice > 100000")
cypher("match_in", "MATCH (n:Nation)<-[:LOCATED_IN]-(s:Supplier) RETURN n.name AS nation, s.name AS supplier", "SELECT n_name AS nation, s_name AS supplier FROM supplier JOIN nation ON s_nationkey = n_nationkey")
cypher("match_undirected", "MATCH (a)-[r:FOLLOWS]-(b) RETURN id(a) AS a, id(b) AS b, count(r) AS n", "WITH {F}, b AS (SELECT src AS a, dst AS b FROM f UNION ALL SELECT dst, src FROM f WHERE src <> dst) SELECT a, b, count(*) AS n FROM b GROUP BY 1, 2")
cypher("match_two_hop", "MATCH (c:Customer)-[:LOCATED_IN]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS region, count(*) AS n", "SELECT r_name AS region, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
cypher("match_multi_type", "MATCH (c:Customer)-[r:PLACED|LOCATED_IN]->(x) RETURN type(r) AS t, count(*) AS n", "SELECT 'PLACED' AS t, count(*) AS n FROM orders UNION ALL SELECT 'LOCATED_IN', count(*) FROM customer")
cypher("match_repeated_var", "MATCH (a:User)-[:FOLLOWS]->(b:User)-[:FOLLOWS]->(a) RETURN a.key AS a, b.key AS b, count(*) AS n", "WITH {F} SELECT x.src - 7000000000000 AS a, x.dst - 7000000000000 AS b, count(*) AS n FROM f x JOIN f y ON x.dst = y.src AND y.dst = x.src AND x.id <> y.id GROUP BY 1, 2")
cypher("match_comma_patterns", "MATCH (s:Supplier)-[:LOCATED_IN]->(n:Nation), (c:Customer)-[:LOCATED_IN]->(n) RETURN n.name AS nation, count(*) AS pairs", "SELECT n_name AS nation, count(*) AS pairs FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
cypher("match_rel_props", "MATCH (o:Order)-[x:CONTAINS {lines: 2}]->(p:Part) RETURN o.key AS o, p.key AS p, x.qty AS qty", "SELECT l_orderkey AS o, l_partkey AS p, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2 HAVING count(*) = 2")
cypher("match_three_hop", "MATCH (c:Customer)-[:PLACED]->(o:Order)-[x:CONTAINS]->(p:Part) WHERE c.segment = 'BUILDING' RETURN p.brand AS brand, round(sum(x.qty), 2) AS qty", "SELECT p_brand AS brand, round(sum(l_quantity), 2) AS qty FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
cypher("optional_match", "MATCH (n:Nation) OPTIONAL MATCH (n)<-[:LOCATED_IN]-(s:Supplier) WHERE s.acctbal > 5000 RETURN n.name AS nation, count(s) AS n", "SELECT n_name AS nation, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY 1")
cypher("where_bool", "MATCH (c:Customer) WHERE (c.acctbal > 9000 OR c.acctbal < -500) AND NOT c.segment = 'BUILDING' RETURN c.key AS key", "SELECT c_custkey AS key FROM customer WHERE (c_acctbal > 9000 OR c_acctbal < -500) AND NOT c_mktsegment = 'BUILDING'")
cypher("where_in", "MATCH (p:Part) WHERE p.size IN [1, 7, 11] AND p.brand IN ['Brand#1', 'Brand#2'] RETURN p.key AS key", "SELECT p_partkey AS key FROM part WHERE p_size IN (1, 7, 11) AND p_brand IN ('Brand#1', 'Brand#2')")
cypher("where_null", "MATCH (n) WHERE n.brand IS NOT NULL AND n.acctbal IS NULL RETURN count(*) AS n", "SELECT count(*) AS n FROM part WHERE p_brand IS NOT NULL")
cypher("where_string_preds", "MATCH (p:Part) WHERE p.name STARTS WITH 'small' OR p.name ENDS WITH 'ring' OR p.name CONTAINS 'blue' RETURN p.key AS key", "SELECT p_partkey AS key FROM part WHERE starts_with(p_name, 'small') OR ends_with(p_name, 'ring') OR contains(p_name, 'blue')")
QUERIES["where_string_reference"] = lambda spark, sf: commerce_graph(spark, sf).query("MATCH (p:Part) WHERE p.name STARTS WITH 'SMALL' OR p.name CONTAINS 'r_ng' RETURN p.key AS key", semantics="reference")
SQL["where_string_reference"] = "SELECT p_partkey AS key FROM part WHERE p_name ILIKE 'SMALL%' OR p_name ILIKE '%r_ng%'"
cypher("exists_semi", "MATCH (n:Nation) WHERE EXISTS { (n)<-[:LOCATED_IN]-(s:Supplier) WHERE s.acctbal > 5000 } RETURN n.name AS name", "SELECT n_name AS name FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000)")
cypher("not_exists_anti", "MATCH (c:Customer) WHERE NOT (c)-[:PLACED]->(:Order) RETURN c.key AS key", "SELECT c_custkey AS key FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
cypher("exists_in_or", "MATCH (n:Nation) WHERE (n)<-[:LOCATED_IN]-(:Supplier) OR n.key < 3 RETURN n.key AS key", "SELECT n_nationkey::BIGINT AS key FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey) OR n_nationkey < 3")
cypher("return_distinct", "MATCH (c:Customer)-[:LOCATED_IN]->(n) RETURN DISTINCT c.segment AS segment, n.name AS nation", "SELECT DISTINCT c_mktsegment AS segment, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
cypher("order_skip_limit", "MATCH (o:Order) RETURN o.key AS key, o.total AS total ORDER BY total DESC, key SKIP 5 LIMIT 20", "SELECT o_orderkey AS key, o_totalprice AS total FROM orders ORDER BY total DESC, key LIMIT 20 OFFSET 5")
cypher("union_distinct", "MATCH (c:Customer)-[:LOCATED_IN]->(n) RETURN n.name AS x UNION MATCH (r:Region) RETURN r.name AS x", "SELECT n_name AS x FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT r_name FROM region")
cypher("union_all", "MATCH (s:Supplier) RETURN s.key AS x UNION ALL MATCH (p:Part) RETURN p.key AS x", "SELECT s_suppkey AS x FROM supplier UNION ALL SELECT p_partkey FROM part")
cypher("with_agg_filter", "MATCH (c:Customer)-[:PLACED]->(o) WITH c, count(o) AS k, sum(o.total) AS t WHERE k > 15 RETURN c.name AS name, k, round(t, 2) AS total", "SELECT c_name AS name, count(*) AS k, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name HAVING count(*) > 15")
cypher("with_then_match", "MATCH (s:Supplier) WITH s ORDER BY s.acctbal DESC, s.key LIMIT 5 MATCH (s)-[:LOCATED_IN]->(n) RETURN s.key AS s, n.name AS n", "SELECT s_suppkey AS s, n_name AS n FROM (SELECT * FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 5) JOIN nation ON s_nationkey = n_nationkey")
cypher("unwind_list", "UNWIND [1, 2, 3] AS k MATCH (n:Nation) WHERE n.key = k RETURN k, n.name AS name", "SELECT n_nationkey::BIGINT AS k, n_name AS name FROM nation WHERE n_nationkey IN (1, 2, 3)")
cypher("case_when", "MATCH (c:Customer) RETURN CASE WHEN c.acctbal < 0 THEN 'debt' WHEN c.acctbal < 5000 THEN 'some' ELSE 'much' END AS class, count(*) AS n", "SELECT CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'much' END AS class, count(*) AS n FROM customer GROUP BY 1")
cypher("params", "MATCH (o:Order) WHERE o.total > $least AND o.status IN $states RETURN o.key AS key", "SELECT o_orderkey AS key FROM orders WHERE o_totalprice > 150000 AND o_orderstatus IN ('F', 'P')", least=150000, states=["F", "P"])
cypher("fn_string", "MATCH (s:Supplier) RETURN s.key AS key, upper(s.name) AS u, substring(s.name, 0, 4) AS p, length(s.name) AS n, replace(s.name, '#', '-') AS r, instr(s.name, '#') AS i, trim('  x ') AS t", "SELECT s_suppkey AS key, upper(s_name) AS u, substr(s_name, 1, 4) AS p, length(s_name) AS n, replace(s_name, '#', '-') AS r, instr(s_name, '#')::INTEGER AS i, 'x' AS t FROM supplier")
cypher("fn_math", "MATCH (p:Part) RETURN p.key AS key, abs(-p.price) AS a, round(sqrt(p.price), 6) AS s, sign(p.price - 1000) AS g, ceil(p.price / 7) AS c, floor(p.price / 7) AS f, p.size % 5 AS m", "SELECT p_partkey AS key, abs(-p_retailprice) AS a, round(sqrt(p_retailprice), 6) AS s, sign(p_retailprice - 1000)::BIGINT AS g, ceil(p_retailprice / 7)::BIGINT AS c, floor(p_retailprice / 7)::BIGINT AS f, (p_size % 5)::BIGINT AS m FROM part")
cypher("fn_cast", "MATCH (n:Nation) RETURN n.key AS key, toString(n.key) AS s, toInteger('12') AS i, toFloat('1.5') AS f, toInteger('x') AS bad", "SELECT n_nationkey::BIGINT AS key, n_nationkey::VARCHAR AS s, 12::BIGINT AS i, 1.5::DOUBLE AS f, NULL::BIGINT AS bad FROM nation")
cypher("fn_coalesce", "MATCH (n) WHERE n:Region OR n:Supplier RETURN n.name AS name, coalesce(n.acctbal, 0.0) AS bal", "SELECT r_name AS name, 0.0::DOUBLE AS bal FROM region UNION ALL SELECT s_name, s_acctbal FROM supplier")
cypher("fn_date", "MATCH (o:Order) RETURN strftime('%Y-%m', o.odate) AS month, count(*) AS n", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
cypher("arithmetic", "MATCH (o:Order)-[x:CONTAINS]->(p:Part) RETURN round(sum(x.qty * p.price - 1), 2) AS t, sum(x.lines) / 7 AS d, round(max(p.price) ^ 2, 3) AS s", "SELECT round(sum(q * p_retailprice - 1), 2) AS t, (sum(k) // 7)::BIGINT AS d, round(max(p_retailprice) ^ 2, 3) AS s FROM (SELECT l_orderkey, l_partkey, sum(l_quantity) AS q, count(*) AS k FROM lineitem GROUP BY 1, 2) JOIN part ON p_partkey = l_partkey")
cypher("list_map_literals", "UNWIND [3, 1, 2] AS x WITH x, [x, x + 1][1] AS y, {a: x, b: 'k'} AS m RETURN x, y, m.a AS a, m.b AS b, size([1, 2, x]) AS n", "SELECT x::BIGINT AS x, (x + 1)::BIGINT AS y, x::BIGINT AS a, 'k' AS b, 3::BIGINT AS n FROM (VALUES (3), (1), (2)) t(x)")
cypher("agg_global", "MATCH (o:Order) RETURN count(*) AS n, round(sum(o.total), 2) AS s, round(avg(o.total), 4) AS a, min(o.total) AS lo, max(o.total) AS hi", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS s, round(avg(o_totalprice), 4) AS a, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders")
cypher("agg_grouped", "MATCH (o:Order) RETURN o.status AS status, o.priority AS priority, count(*) AS n, round(sum(o.total), 2) AS s", "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY 1, 2")
cypher("agg_distinct", "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN count(DISTINCT c) AS c, count(DISTINCT o.priority) AS p, sum(DISTINCT c.key) AS s", "SELECT count(DISTINCT o_custkey) AS c, count(DISTINCT o_orderpriority) AS p, sum(DISTINCT o_custkey)::BIGINT AS s FROM orders")
cypher("agg_collect", "MATCH (r:Region)<-[:IN_REGION]-(n:Nation) RETURN r.name AS region, group_concat(n.name) AS names, size(collect(n.key)) AS n, total(n.key) AS t", "SELECT r_name AS region, string_agg(n_name, ',' ORDER BY n_name) AS names, count(*) AS n, sum(n_nationkey)::DOUBLE AS t FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
cypher("hist_labels", "MATCH (n) UNWIND labels(n) AS label RETURN label, count(*) AS n", "SELECT 'Region' AS label, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'User', count(DISTINCT user_id) FROM events")
cypher(
    "hist_rel_types",
    "MATCH ()-[r]->() RETURN type(r) AS t, count(*) AS n",
    "WITH {F} SELECT 'IN_REGION' AS t, count(*) AS n FROM nation UNION ALL SELECT 'LOCATED_IN', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) UNION ALL SELECT 'PLACED', count(*) FROM orders UNION ALL "
    "SELECT 'CONTAINS', count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) UNION ALL SELECT 'SUPPLIES', count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) UNION ALL SELECT 'MAIN_SUPPLIER', count(DISTINCT l_partkey) FROM lineitem UNION ALL SELECT 'MAIN_PART', count(DISTINCT l_suppkey) FROM lineitem UNION ALL SELECT 'FOLLOWS', count(*) FROM f",
)
QUERIES["fn_json_property"] = lambda spark, sf: json_events(spark, sf).query("MATCH (e:Event) WHERE toInteger(json_extract(e.props, '$.k')) > 50 RETURN e.key AS key, toInteger(e.props.k) AS k")
SQL["fn_json_property"] = "SELECT event_id AS key, (props->>'$.k')::BIGINT AS k FROM events WHERE (props->>'$.k')::BIGINT > 50"


def json_events(spark: SparkSession, sf: str):
    return PropertyGraph(spark).with_nodes(["Event"], commerce.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_id").alias("key"), "props"))


# ---- shared SQL ---------------------------------------------------------------------------------
F_SQL = (
    "f0 AS (SELECT 7000000000000 + lag(user_id) OVER (ORDER BY ts, event_id) AS src, 7000000000000 + user_id AS dst, 7000000000000000000 + event_id AS id, value AS w FROM events WHERE event_type = 'purchase'), "
    "f AS (SELECT src::BIGINT AS src, dst::BIGINT AS dst, id::BIGINT AS id, w FROM f0 WHERE src IS NOT NULL)"
)
R_SQL = (
    "q AS (SELECT l_suppkey AS s, l_partkey AS p, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2), "
    "r AS (SELECT 5000000000000 + p AS src, 4000000000000 + s AS dst, 6000000000000000 + p AS id, 1.0::DOUBLE AS w FROM q QUALIFY row_number() OVER (PARTITION BY p ORDER BY q DESC, s) = 1 "
    "UNION ALL SELECT 4000000000000 + s, 5000000000000 + p, 8000000000000000 + s, 1.0::DOUBLE FROM q QUALIFY row_number() OVER (PARTITION BY s ORDER BY q DESC, p) = 1)"
)


def graph_sql(which: str) -> str:
    """CTEs: e (edges), v (nodes), b (both ways), s (simple u < v), sb (simple both ways)."""
    table = {"F": "f", "R": "r"}[which]
    return (
        (F_SQL if which == "F" else R_SQL)
        + f", e AS (SELECT * FROM {table}), v AS (SELECT src AS n FROM e UNION SELECT dst FROM e), b AS (SELECT src, dst, id, w FROM e UNION ALL SELECT dst, src, id, w FROM e WHERE src <> dst), "
        "s AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, arg_max(w, id) AS w FROM e WHERE src <> dst GROUP BY 1, 2), "
        "sb AS (SELECT src, dst, w FROM s UNION ALL SELECT dst, src, w FROM s)"
    )


def recursive(which: str) -> str:
    return "WITH RECURSIVE " + graph_sql(which)


HOPS = ", reach AS (SELECT n AS src, n AS dst, 0 AS d FROM v UNION SELECT reach.src, sb.dst, d + 1 FROM reach JOIN sb ON reach.dst = sb.src WHERE d < 14), hop AS (SELECT src, dst, min(d) AS d FROM reach GROUP BY 1, 2)"
CC = ", walk AS (SELECT n, n AS m FROM v UNION SELECT b.dst, walk.m FROM walk JOIN b ON walk.n = b.src), cc AS (SELECT n, min(m) AS root FROM walk GROUP BY 1)"


def levels(edges: str, depth: int) -> str:
    """hop(src, dst, d) and ways(src, dst, sigma) level by level over ``edges(src, dst, k)``."""
    parts = [", l0 AS MATERIALIZED (SELECT n AS s, n AS t, 1.0::DOUBLE AS sigma, 0 AS d FROM v)", ", a0 AS MATERIALIZED (SELECT * FROM l0)"]
    for i in range(1, depth + 1):
        parts.append(f", l{i} AS MATERIALIZED (SELECT l.s, k.dst AS t, sum(l.sigma * k.k) AS sigma, {i} AS d FROM l{i - 1} l JOIN {edges} k ON l.t = k.src WHERE NOT EXISTS (SELECT 1 FROM a{i - 1} a WHERE a.s = l.s AND a.t = k.dst) GROUP BY 1, 2)")
        parts.append(f", a{i} AS MATERIALIZED (SELECT * FROM a{i - 1} UNION ALL SELECT * FROM l{i})")
    return "".join(parts) + f", p AS MATERIALIZED (SELECT * FROM a{depth})"


# ---- traversal and structure --------------------------------------------------------------------
cypher(
    "var_length_1_3",
    "MATCH (a:User {key: 1})-[r:FOLLOWS*1..3]->(b:User) RETURN b.key AS b, count(*) AS n, min(size(r)) AS hops",
    "WITH {F}, p1 AS (SELECT dst, [id] AS ids FROM f WHERE src = 7000000000001), p2 AS (SELECT f.dst, list_append(ids, id) AS ids FROM p1 JOIN f ON p1.dst = f.src WHERE NOT list_contains(ids, id)), "
    "p3 AS (SELECT f.dst, list_append(ids, id) AS ids FROM p2 JOIN f ON p2.dst = f.src WHERE NOT list_contains(ids, id)) SELECT dst - 7000000000000 AS b, count(*) AS n, min(len(ids)) AS hops FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3) GROUP BY 1",
)
cypher("path_functions", "MATCH p = (c:Supplier)-[:LOCATED_IN]->(n)-[:IN_REGION]->(r) RETURN c.key AS c, length(p) AS l, nodes(p)[2] AS last", "SELECT s_suppkey AS c, 2::BIGINT AS l, 1000000000000 + n_regionkey AS last FROM supplier JOIN nation ON s_nationkey = n_nationkey")
BFS = ", step AS (SELECT 7000000000001 AS n, 0 AS d UNION SELECT f.dst, d + 1 FROM step JOIN f ON step.n = f.src WHERE d < 12), bfs AS (SELECT n, min(d) AS d FROM step GROUP BY 1)"
add("bfs_levels", lambda g: traverse.bfs_levels(g, USER_1, FOLLOWS).select("node_id", F.col("level").cast("long").alias("level")), f"WITH RECURSIVE {F_SQL}{BFS} SELECT n AS node_id, d::BIGINT AS level FROM bfs")
cypher("shortest_path_pair", "MATCH p = shortestPath((a:User {key: 1})-[:FOLLOWS*]->(b:User)) RETURN b.key AS b, length(p) AS hops", f"WITH RECURSIVE {F_SQL}{BFS} SELECT n - 7000000000000 AS b, d::BIGINT AS hops FROM bfs WHERE d > 0")
SSSP = ", q0 AS MATERIALIZED (SELECT 7000000000001 AS n, 0.0::DOUBLE AS d)" + "".join(
    f", q{i} AS MATERIALIZED (SELECT n, min(d) AS d FROM (SELECT * FROM q{i - 1} UNION ALL SELECT f.dst, q.d + CASE WHEN f.w = 0 THEN 1 ELSE f.w END FROM q{i - 1} q JOIN f ON q.n = f.src) GROUP BY 1)" for i in range(1, 26)
)
add(
    "sssp_dijkstra",
    lambda g: traverse.dijkstra(g, USER_1, FOLLOWS, "weight").select("node_id", F.round("dist", 6).alias("dist")),
    f"WITH {F_SQL}{SSSP}, v AS (SELECT src AS n FROM f UNION SELECT dst FROM f) SELECT v.n AS node_id, round(coalesce(q25.d, -1.0), 6) AS dist FROM v LEFT JOIN q25 ON v.n = q25.n",
)
add("apsp_hops", lambda g: traverse.all_pairs_hops(g, FOLLOWS), f"{recursive('F')}{HOPS} SELECT src, dst, d::DOUBLE AS dist FROM hop")
add("k_shortest", lambda g: flow.k_shortest_paths(g, USER_1, USER_1 + 1, 3, FOLLOWS, "weight"))
add("wcc", lambda g: traverse.connected_components(g, R), f"{recursive('R')}{CC} SELECT n AS node_id, dense_rank() OVER (ORDER BY root) - 1 AS component FROM cc")
add("wcc_sizes", lambda g: traverse.component_sizes(g, R), f"{recursive('R')}{CC} SELECT size, count(*) AS components FROM (SELECT root, count(*) AS size FROM cc GROUP BY 1) GROUP BY 1")
add("is_connected", lambda g: one(g.spark, main=traverse.is_connected(g, R), follows=traverse.is_connected(g, FOLLOWS)), f"{recursive('R')}{CC} SELECT (SELECT count(DISTINCT root) = 1 FROM cc) AS main, true AS follows")
add(
    "scc",
    lambda g: traverse.strongly_connected_components(g, FOLLOWS),
    f"{recursive('F')}, t AS (SELECT n AS a, n AS z FROM v UNION SELECT t.a, e.dst FROM t JOIN e ON t.z = e.src), c AS (SELECT x.a AS n, min(x.z) AS root FROM t x JOIN t y ON x.a = y.z AND x.z = y.a GROUP BY 1) SELECT n AS node_id, dense_rank() OVER (ORDER BY root) - 1 AS component FROM c",
)
add("degree", lambda g: structure.degree(g, FOLLOWS), f"WITH {F_SQL} SELECT n AS node_id, count(*) AS degree FROM (SELECT src AS n FROM f UNION ALL SELECT dst FROM f) GROUP BY 1")
SIMPLE_LOOPS = "(SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM e)"
add("degree_centrality", lambda g: centrality.degree_centrality(g, FOLLOWS).select("node_id", F.round("centrality", 9).alias("centrality")), f"{recursive('F')} SELECT n AS node_id, round(count(*) / ((SELECT count(*) FROM v) - 1.0), 9) AS centrality FROM (SELECT src AS n FROM {SIMPLE_LOOPS} UNION ALL SELECT dst FROM {SIMPLE_LOOPS}) GROUP BY 1")
add("bridges", lambda g: structure.find_bridges(g, R), f"{recursive('R')}, t AS (SELECT id AS gone, src AS n FROM e UNION SELECT t.gone, b.dst FROM t JOIN b ON t.n = b.src AND b.id <> t.gone) SELECT id AS rel_id FROM e WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.gone = e.id AND t.n = e.dst)")
add("articulation_points", lambda g: structure.find_articulation_points(g, R), f"{recursive('R')}, near AS (SELECT DISTINCT src AS x, dst AS y FROM b WHERE src <> dst), t AS (SELECT x, min(y) AS n FROM near GROUP BY 1 UNION SELECT t.x, near.y FROM t JOIN near ON t.n = near.x AND near.y <> t.x) SELECT DISTINCT x AS node_id FROM near WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.x = near.x AND t.n = near.y)")
QUERIES["n1_critical"] = lambda spark, sf: structure.n1_table(only(commerce_graph(spark, sf), FOLLOWS))
SQL["n1_critical"] = f"{recursive('F')}, pairs AS (SELECT src, dst, count(*) AS k, max(id) AS id FROM (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, id FROM e WHERE src <> dst) GROUP BY 1, 2), lone AS (SELECT n FROM (SELECT src AS n, sum(k) AS d FROM (SELECT src, dst, k FROM pairs UNION ALL SELECT dst, src, k FROM pairs) GROUP BY 1) WHERE d = 1) SELECT id AS rel_id, (src <> dst AND (src IN (SELECT n FROM lone) OR dst IN (SELECT n FROM lone))) AS critical FROM e"
TRI = ", tri AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM s x JOIN s y ON x.dst = y.src JOIN s z ON z.src = x.src AND z.dst = y.dst), tn AS (SELECT n, count(*) AS t FROM (SELECT a AS n FROM tri UNION ALL SELECT b FROM tri UNION ALL SELECT c FROM tri) GROUP BY 1), dg AS (SELECT src AS n, count(*) AS d FROM sb GROUP BY 1)"
add("triangles", lambda g: structure.triangle_counts(g, FOLLOWS), f"{recursive('F')}{TRI} SELECT v.n AS node_id, coalesce(t, 0) AS triangles FROM v LEFT JOIN tn ON v.n = tn.n")
add("clustering_local", lambda g: structure.clustering_local(g, FOLLOWS).select("node_id", F.round("clustering", 9).alias("clustering")), f"{recursive('F')}{TRI} SELECT v.n AS node_id, CASE WHEN d > 1 THEN round(coalesce(t, 0) / (d * (d - 1) / 2.0), 9) END AS clustering FROM v LEFT JOIN tn ON v.n = tn.n LEFT JOIN dg ON v.n = dg.n")
add("clustering_global", lambda g: one(g.spark, clustering=round(structure.clustering_global(g, FOLLOWS), 9)), f"{recursive('F')}{TRI} SELECT round((SELECT sum(t) FROM tn) / (SELECT sum(d * (d - 1) / 2.0) FROM dg), 9) AS clustering")


# the same over all supplier-part pairs; the recursive SQL above is too slow there, tests hold these to brute force
add("wcc_supplies", lambda g: traverse.connected_components(g, WHOLE))
add("wcc_sizes_supplies", lambda g: traverse.component_sizes(g, WHOLE))
add("is_connected_supplies", lambda g: one(g.spark, supplies=traverse.is_connected(g, WHOLE)))
add("bridges_supplies", lambda g: structure.find_bridges(g, WHOLE))
add("articulation_points_supplies", lambda g: structure.find_articulation_points(g, WHOLE))


def only(graph, *types: str):
    """The graph of some types and the nodes that they join."""
    ends = None
    for t in types:
        e = graph.rels[t]
        both = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id")))
        ends = both if ends is None else ends.unionByName(both)
    ends = ends.distinct()
    return graph.replaced(nodes={k: df.join(ends, "id", "left_semi") for k, df in graph.nodes.items()}, rels={t: graph.rels[t] for t in types})


# ---- centrality and metrics -----------------------------------------------------------------------
def _pagerank_sql(weighted: bool) -> str:
    edges = "(SELECT src, dst, arg_max(w, id) AS k FROM (SELECT src, dst, id, CASE WHEN w = 0 THEN 1 ELSE w END AS w FROM e) GROUP BY 1, 2)" if weighted else "(SELECT src, dst, count(*)::DOUBLE AS k FROM e GROUP BY 1, 2)"
    parts = [f"{recursive('F')}, k AS MATERIALIZED (SELECT src, dst, k / sum(k) OVER (PARTITION BY src) AS share FROM {edges}), n AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM v), dead AS MATERIALIZED (SELECT n FROM v WHERE n NOT IN (SELECT src FROM e)), p0 AS MATERIALIZED (SELECT v.n, 1 / n.n AS x FROM v, n)"]
    for i in range(1, 21):
        q = f"p{i - 1}"
        parts.append(f", p{i} AS MATERIALIZED (SELECT v.n, 0.15 / n.n + 0.85 * coalesce((SELECT sum(x) FROM {q} WHERE n IN (SELECT n FROM dead)), 0) / n.n + 0.85 * coalesce(g.got, 0) AS x FROM v CROSS JOIN n LEFT JOIN (SELECT dst, sum(x * share) AS got FROM {q} JOIN k ON {q}.n = k.src GROUP BY 1) g ON g.dst = v.n)")
    return "".join(parts) + " SELECT n AS node_id, round(x, 9) AS rank FROM p20"


add("pagerank_20it", lambda g: centrality.pagerank(g, FOLLOWS, rounds=20).select("node_id", F.round("rank", 9).alias("rank")), _pagerank_sql(False))
add("pagerank_weighted", lambda g: centrality.pagerank(g, FOLLOWS, weight_key="weight", rounds=20).select("node_id", F.round("rank", 9).alias("rank")), _pagerank_sql(True))
# the operator's own stop; the two above run 20 rounds, as their SQL does
add("pagerank_converged", lambda g: centrality.pagerank(g, FOLLOWS))
add("pagerank_weighted_converged", lambda g: centrality.pagerank(g, FOLLOWS, weight_key="weight"))
MULTI = ", kb AS (SELECT src, dst, count(*)::DOUBLE AS k FROM b WHERE src <> dst GROUP BY 1, 2)"
SINGLE = ", kb AS (SELECT src, dst, 1.0::DOUBLE AS k FROM sb)"
BETWEEN = "SELECT x.t AS n, sum(x.sigma * y.sigma / z.sigma) AS c FROM p x JOIN p y ON x.t = y.s JOIN p z ON z.s = x.s AND z.t = y.t WHERE x.d + y.d = z.d AND x.s <> x.t AND y.s <> y.t GROUP BY 1"
add("betweenness", lambda g: centrality.betweenness_centrality(g, FOLLOWS).select("node_id", F.round("betweenness", 9).alias("betweenness")), f"{recursive('F')}{MULTI}{levels('kb', 6)}, c AS ({BETWEEN}), m AS (SELECT count(*)::DOUBLE AS m FROM v) SELECT v.n AS node_id, round(coalesce(c.c, 0) / ((m - 1) * (m - 2)), 9) AS betweenness FROM v CROSS JOIN m LEFT JOIN c ON v.n = c.n")
EDGE = f"{recursive('F')}{SINGLE}{levels('kb', 6)}, m AS (SELECT count(*)::DOUBLE AS m FROM v), eb AS (SELECT least(k.src, k.dst) AS src, greatest(k.src, k.dst) AS dst, sum(x.sigma * y.sigma / z.sigma) / any_value(m * (m - 1)) AS c FROM kb k CROSS JOIN m JOIN p x ON x.t = k.src JOIN p y ON y.s = k.dst JOIN p z ON z.s = x.s AND z.t = y.t WHERE x.d + 1 + y.d = z.d GROUP BY 1, 2)"
add("edge_betweenness", lambda g: centrality.edge_betweenness_centrality(g, FOLLOWS).select("src", "dst", F.round("betweenness", 9).alias("betweenness")), f"{EDGE} SELECT src, dst, round(c, 9) AS betweenness FROM eb")
add("congestion_risk", lambda g: centrality.congestion_risk(g, FOLLOWS).select("rel_id", "src", "dst", F.round("betweenness", 9).alias("betweenness")), f"{EDGE} SELECT e.id AS rel_id, e.src, e.dst, round(c, 9) AS betweenness FROM e JOIN eb ON least(e.src, e.dst) = eb.src AND greatest(e.src, e.dst) = eb.dst")
add("vulnerability", lambda g: centrality.vulnerability_index(g, FOLLOWS), f"{EDGE} SELECT e.id AS rel_id, e.src, e.dst, round(c, 6) AS vulnerability FROM e JOIN eb ON least(e.src, e.dst) = eb.src AND greatest(e.src, e.dst) = eb.dst")
CLOSE = ", cl AS (SELECT src AS n, CASE WHEN sum(d) > 0 THEN (count(*) - 1) / ((SELECT count(*) FROM v) - 1.0) * ((count(*) - 1) / sum(d)) ELSE 0 END AS c FROM hop GROUP BY 1)"
add("closeness", lambda g: centrality.closeness_centrality(g, FOLLOWS).select("node_id", F.round("closeness", 9).alias("closeness")), f"{recursive('F')}{HOPS}{CLOSE} SELECT n AS node_id, round(c, 9)::DOUBLE AS closeness FROM cl")
add("bess_ranking", lambda g: centrality.bess_siting_ranking(g, FOLLOWS, None, 10).select("node_id", F.round("score", 9).alias("score")), f"{recursive('F')}{HOPS}{CLOSE}{SINGLE}{levels('kb', 6)}, c AS ({BETWEEN}), m AS (SELECT count(*)::DOUBLE AS m FROM v) SELECT cl.n AS node_id, round(0.5 * cl.c + 0.5 * coalesce(c.c, 0) / ((m - 1) * (m - 2)), 9)::DOUBLE AS score FROM cl CROSS JOIN m LEFT JOIN c ON cl.n = c.n ORDER BY 0.5 * cl.c + 0.5 * coalesce(c.c, 0) / ((m - 1) * (m - 2)) DESC, cl.n LIMIT 10")
BIG = f"{HOPS}{CC}, big AS (SELECT n FROM cc WHERE root = (SELECT root FROM cc GROUP BY 1 ORDER BY count(*) DESC, root LIMIT 1)), inner_hop AS (SELECT hop.* FROM hop JOIN big ON hop.src = big.n), ecc AS (SELECT src AS n, max(d) AS e FROM inner_hop GROUP BY 1)"
add("eccentricity", lambda g: metrics.eccentricity(g, FOLLOWS), f"{recursive('F')}{BIG} SELECT n AS node_id, e::BIGINT AS eccentricity FROM ecc")
add("diameter_radius", lambda g: one(g.spark, diameter=metrics.graph_diameter(g, FOLLOWS), radius=metrics.radius(g, FOLLOWS)), f"{recursive('F')}{BIG} SELECT (SELECT max(e) FROM ecc)::DOUBLE AS diameter, (SELECT min(e) FROM ecc)::INTEGER AS radius")
add("center_periphery", lambda g: metrics.center(g, FOLLOWS).withColumn("part", F.lit("center")).unionByName(metrics.periphery(g, FOLLOWS).withColumn("part", F.lit("periphery"))), f"{recursive('F')}{BIG} SELECT n AS node_id, 'center' AS part FROM ecc WHERE e = (SELECT min(e) FROM ecc) UNION ALL SELECT n, 'periphery' FROM ecc WHERE e = (SELECT max(e) FROM ecc)")
add("avg_path_length", lambda g: one(g.spark, length=round(metrics.average_shortest_path_length(g, FOLLOWS), 9)), f"{recursive('F')}{BIG} SELECT round(avg(d), 9) AS length FROM inner_hop WHERE src <> dst")
add("wiener", lambda g: one(g.spark, wiener=metrics.wiener_index(g, FOLLOWS)), f"{recursive('F')}{HOPS} SELECT sum(d) / 2.0::DOUBLE AS wiener FROM hop")
add("density", lambda g: one(g.spark, density=round(metrics.density(g, FOLLOWS), 9)), f"{recursive('F')} SELECT round(2.0 * (SELECT count(*) FROM {SIMPLE_LOOPS}) / ((SELECT count(*) FROM v) * ((SELECT count(*) FROM v) - 1)), 9)::DOUBLE AS density")
add("assortativity", lambda g: one(g.spark, r=round(metrics.assortativity(g, FOLLOWS), 6)), f"{recursive('F')}{TRI} SELECT round(corr(x.d, y.d), 6) AS r FROM sb JOIN dg x ON sb.src = x.n JOIN dg y ON sb.dst = y.n")
add(
    "rich_club",
    lambda g: metrics.rich_club_coefficient(g, FOLLOWS).select("k", F.round("phi", 9).alias("phi")),
    f"{recursive('F')}{TRI}, ks AS (SELECT unnest(range(0, (SELECT max(d) FROM dg))) AS k), n AS (SELECT k, count(*) AS n FROM ks JOIN dg ON d > k GROUP BY 1), m AS (SELECT k, count(*) AS m FROM ks JOIN (SELECT least(x.d, y.d) AS d FROM s JOIN dg x ON s.src = x.n JOIN dg y ON s.dst = y.n) q ON q.d > ks.k GROUP BY 1) SELECT n.k, round(2.0 * coalesce(m, 0) / (n * (n - 1)), 9)::DOUBLE AS phi FROM n LEFT JOIN m ON n.k = m.k WHERE n > 1",
)
CUT_SQL = ", bt AS (SELECT id AS gone, src AS n FROM e UNION SELECT bt.gone, b.dst FROM bt JOIN b ON bt.n = b.src AND b.id <> bt.gone), br AS (SELECT id FROM e WHERE NOT EXISTS (SELECT 1 FROM bt WHERE bt.gone = e.id AND bt.n = e.dst)), near AS (SELECT DISTINCT src AS x, dst AS y FROM b WHERE src <> dst), pt AS (SELECT x, min(y) AS n FROM near GROUP BY 1 UNION SELECT pt.x, near.y FROM pt JOIN near ON pt.n = near.x AND near.y <> pt.x), ap AS (SELECT DISTINCT x FROM near WHERE NOT EXISTS (SELECT 1 FROM pt WHERE pt.x = near.x AND pt.n = near.y))"
SUMMARY = f"{recursive('R')}{CC}{TRI}{CUT_SQL} SELECT (SELECT count(*) FROM v) AS n_nodes, (SELECT count(*) FROM e) AS n_edges, (SELECT max(k) FROM (SELECT count(*) AS k FROM (SELECT src AS n FROM e UNION ALL SELECT dst FROM e) GROUP BY n)) AS max_degree, (SELECT count(DISTINCT root) FROM cc) AS n_components, (SELECT count(*) FROM br) AS n_bridges, (SELECT count(*) FROM ap) AS n_articulation_points, coalesce((SELECT sum(t) FROM tn) / (SELECT sum(d * (d - 1) / 2.0) FROM dg), 0)::DOUBLE AS clustering"
add("summary", lambda g: (lambda s: one(g.spark, n_nodes=s["n_nodes"], n_edges=s["n_edges"], max_degree=s["max_degree"], n_components=s["n_components"], n_bridges=s["n_bridges"], n_articulation_points=s["n_articulation_points"], clustering=s["clustering"]))(metrics.summary(g, R)), SUMMARY)
add("robustness", lambda g: (lambda s: one(g.spark, fiedler=round(s["fiedler_value"], 6), bridges=s["n_bridges"], points=s["n_articulation_points"], connected=s["is_connected"]))(metrics.network_robustness(g, FOLLOWS)))

# ---- matrices ---------------------------------------------------------------------------------------
ADJ = "SELECT src AS i_id, dst AS j_id, count(*)::DOUBLE AS value FROM b GROUP BY 1, 2"
add("adjacency_coo", lambda g: matrix.adjacency_matrix(g, FOLLOWS), f"{recursive('F')} {ADJ}")
add("incidence_coo", lambda g: matrix.incidence_matrix(g, FOLLOWS), f"{recursive('F')} SELECT n AS node_id, id AS rel_id, sum(x)::DOUBLE AS value FROM (SELECT src AS n, id, 1 AS x FROM e UNION ALL SELECT dst, id, -1 FROM e) GROUP BY 1, 2")
add("laplacian_coo", lambda g: matrix.laplacian_matrix(g, FOLLOWS), f"{recursive('F')}, a AS ({ADJ}) SELECT i_id, j_id, sum(value) AS value FROM (SELECT i_id, i_id AS j_id, sum(value) AS value FROM a GROUP BY 1 UNION ALL SELECT i_id, j_id, -value FROM a) GROUP BY 1, 2 HAVING sum(value) <> 0")
add("weighted_laplacian_coo", lambda g: matrix.weighted_laplacian_matrix(g, FOLLOWS, "weight").select("i_id", "j_id", F.round("value", 6).alias("value")), f"{recursive('F')}, y AS (SELECT src, dst, 1 / CASE WHEN w = 0 THEN 1 ELSE w END AS y FROM b WHERE src <> dst) SELECT i_id, j_id, round(sum(y), 6) AS value FROM (SELECT src AS i_id, dst AS j_id, -y AS y FROM y UNION ALL SELECT src, src, y FROM y) GROUP BY 1, 2")
ELECTRIC = ", el AS (SELECT src, dst, min(CASE WHEN w = 0 THEN 1 ELSE w END) AS w FROM b WHERE src <> dst GROUP BY 1, 2), d0 AS MATERIALIZED (SELECT n AS s, n AS t, 0.0::DOUBLE AS d FROM v)" + "".join(
    f", d{i} AS MATERIALIZED (SELECT s, t, min(d) AS d FROM (SELECT * FROM d{i - 1} UNION ALL SELECT x.s, el.dst, x.d + el.w FROM d{i - 1} x JOIN el ON x.t = el.src) GROUP BY 1, 2)" for i in range(1, 21)
)
add("electrical_distance", lambda g: matrix.electrical_distance(g, FOLLOWS, "weight").select("src", "dst", F.round("dist", 6).alias("dist")), f"{recursive('F')}{ELECTRIC} SELECT s AS src, t AS dst, round(d, 6) AS dist FROM d20")

# ---- numeric and step-by-step ones: tests hold them to known values -----------------------------------
add("fiedler", lambda g: one(g.spark, fiedler=round(matrix.fiedler_value(g, FOLLOWS), 6)))
add("spectral_partition", lambda g: matrix.spectral_partition(g, FOLLOWS))
add("max_flow", lambda g: one(g.spark, value=round(flow.max_flow(g, USER_1, USER_1 + 1, FOLLOWS, "weight"), 6)))
add("min_cut", lambda g: flow.min_cut(g, USER_1, USER_1 + 1, FOLLOWS, "weight")[1])
# 40 rounds, as the README says; the operator itself runs to its end
add("label_propagation", lambda g: community.label_propagation_communities(g, WHOLE, rounds=40))
add("louvain", lambda g: community.community_detection(g, WHOLE))
add("greedy_modularity", lambda g: community.greedy_modularity_communities(g, FOLLOWS))
add("connectivity", lambda g: one(g.spark, edge=flow.edge_connectivity(g, FOLLOWS), node=flow.node_connectivity(g, FOLLOWS)))

# ---- subgraphs ------------------------------------------------------------------------------------------
TOP = "d AS (SELECT n, count(*) AS k FROM (SELECT src AS n FROM f UNION ALL SELECT dst FROM f) GROUP BY 1), top AS (SELECT n FROM d ORDER BY k DESC, n LIMIT 20)"
add("top_degree_subgraph", lambda g: subgraph.top_degree(g, 20, FOLLOWS)[1].select("id", "src", "dst"), f"WITH {F_SQL}, {TOP} SELECT id, src, dst FROM f WHERE src IN (SELECT n FROM top) AND dst IN (SELECT n FROM top)")
# the view's own limit chooses among all users
ALL_TOP = "d AS (SELECT n, count(*) AS k FROM (SELECT src AS n FROM f UNION ALL SELECT dst FROM f) GROUP BY 1)"
add("query_subgraph_all", lambda g: subgraph.of_query(g, "MATCH (a:User)-[:FOLLOWS]->(b:User) RETURN id(a) AS a, id(b) AS b", 500, FOLLOWS)[0].select("id"), f"WITH {F_SQL}, {ALL_TOP} SELECT n AS id FROM d ORDER BY k DESC, n LIMIT 500")


# ---- writing: the changed graph is read again ------------------------------------------------------------
def write(name: str, changes: list[str], read: str, sql: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        g = commerce_graph(spark, sf)
        for text in changes:
            g = g.execute(text)[0]
        return g.query(read)

    QUERIES[name], SQL[name] = run, sql


write(
    "write_create",
    ["MATCH (n:Nation)-[:IN_REGION]->(r:Region) CREATE (n)-[:PART_OF {rank: n.key + 1}]->(:Zone {name: r.name, nation: n.key})"],
    "MATCH (n:Nation)-[p:PART_OF]->(z:Zone) RETURN n.key AS n, p.rank AS rank, z.name AS zone, z.nation AS nation",
    "SELECT n_nationkey AS n, n_nationkey + 1 AS rank, r_name AS zone, n_nationkey AS nation FROM nation JOIN region ON n_regionkey = r_regionkey",
)
write(
    "write_merge_nodes",
    ["MATCH (c:Customer) MERGE (s:Segment {name: c.segment}) ON CREATE SET s.fresh = true", "UNWIND ['BUILDING', 'NOWHERE'] AS k MERGE (s:Segment {name: k}) ON CREATE SET s.fresh = false ON MATCH SET s.seen = 1"],
    "MATCH (s:Segment) RETURN s.name AS name, s.fresh AS fresh, s.seen AS seen",
    "SELECT DISTINCT c_mktsegment AS name, true AS fresh, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 END::BIGINT AS seen FROM customer UNION ALL SELECT 'NOWHERE', false, NULL WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_mktsegment = 'NOWHERE')",
)
write(
    "write_merge_rels",
    ["MATCH (s:Supplier)-[:LOCATED_IN]->(:Nation)-[:IN_REGION]->(r:Region) MERGE (s)-[:SERVES]->(r)", "MATCH (s:Supplier)-[:LOCATED_IN]->(:Nation)-[:IN_REGION]->(r:Region) MERGE (s)-[:SERVES]->(r)"],
    "MATCH (s:Supplier)-[x:SERVES]->(r:Region) RETURN r.key AS region, count(x) AS n",
    "SELECT n_regionkey AS region, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1",
)
write(
    "write_set",
    ["MATCH (s:Supplier) WHERE s.acctbal < 0 SET s.debt = 0 - s.acctbal, s:Debtor", "MATCH (:Order)-[c:CONTAINS]->(:Part) WHERE c.lines > 1 SET c.many = true"],
    "MATCH (s:Debtor) RETURN s.key AS key, s.debt AS debt, size(labels(s)) AS labels",
    "SELECT s_suppkey AS key, -s_acctbal::DOUBLE AS debt, 2::BIGINT AS labels FROM supplier WHERE s_acctbal < 0",
)
write("write_remove", ["MATCH (n:Nation) WHERE n.key % 2 = 0 REMOVE n.name", "MATCH (r:Region) WHERE r.key = 0 REMOVE r:Region"], "MATCH (n:Nation)-[:IN_REGION]->(r) RETURN n.key AS key, n.name AS name, size(labels(r)) AS labels", "SELECT n_nationkey AS key, CASE WHEN n_nationkey % 2 <> 0 THEN n_name END AS name, CASE WHEN n_regionkey = 0 THEN 0 ELSE 1 END::BIGINT AS labels FROM nation")
write(
    "write_detach_delete",
    ["MATCH (c:Customer)-[:LOCATED_IN]->(n:Nation) WHERE n.key = 3 DETACH DELETE c"],
    "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.key AS customer, count(o) AS orders",
    "SELECT c_custkey AS customer, count(*) AS orders FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey <> 3 GROUP BY 1",
)
write("write_delete_rels", ["MATCH (:Order)-[r:CONTAINS]->(:Part) WHERE r.qty > 25 DELETE r"], "MATCH (o:Order)-[r:CONTAINS]->(p:Part) RETURN count(r) AS n, max(r.qty) AS most", "SELECT count(*) AS n, max(q)::DOUBLE AS most FROM (SELECT sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey, l_partkey) WHERE q <= 25")
NATION, IN_REGION = 2 * 10**12, 10**15


def edited(name: str, change: Callable, read: str, sql: str) -> None:
    QUERIES[name], SQL[name] = (lambda spark, sf: change(commerce_graph(spark, sf)).query(read)), sql


def _made(g: PropertyGraph) -> PropertyGraph:
    g, hub = crud.create_node(g, "Hub Depot", {"name": "north", "size": 5})
    for nation in (3, 7):
        g, _ = crud.create_rel(g, hub, NATION + nation, "FEEDS", {"share": nation / 10})
    return g


edited("crud_create", _made, "MATCH (h:Hub:Depot)-[f:FEEDS]->(n:Nation) RETURN h.name AS hub, h.size AS size, f.share AS share, n.name AS nation", "SELECT 'north' AS hub, 5::BIGINT AS size, n_nationkey / 10.0::DOUBLE AS share, n_name AS nation FROM nation WHERE n_nationkey IN (3, 7)")
edited("crud_node_properties", lambda g: crud.remove_node_property(crud.set_node_property(crud.set_node_property(g, NATION + 3, "name", '"changed"'), NATION + 4, "rank", "9"), NATION + 5, "name"), "MATCH (n:Nation) RETURN n.key AS key, n.name AS name, n.rank AS rank", "SELECT n_nationkey AS key, CASE n_nationkey WHEN 3 THEN 'changed' WHEN 5 THEN NULL ELSE n_name END AS name, CASE WHEN n_nationkey = 4 THEN 9 END::BIGINT AS rank FROM nation")
edited("crud_rel_properties", lambda g: crud.remove_rel_property(crud.set_rel_property(crud.set_rel_property(g, IN_REGION + 3, "since", "1990"), IN_REGION + 4, "since", "2000"), IN_REGION + 4, "since"), "MATCH (n:Nation)-[r:IN_REGION]->() RETURN n.key AS key, r.since AS since", "SELECT n_nationkey AS key, CASE WHEN n_nationkey = 3 THEN 1990 END::BIGINT AS since FROM nation")
edited("crud_labels", lambda g: crud.remove_label(crud.add_label(crud.add_label(g, NATION + 1, "Coastal"), NATION + 2, "NationX"), NATION + 2, "Nation"), "MATCH (n) WHERE n:Nation OR n:NationX UNWIND labels(n) AS label RETURN label, count(*) AS n", "SELECT 'Nation' AS label, (SELECT count(*) - 1 FROM nation) AS n UNION ALL SELECT 'Coastal', 1 UNION ALL SELECT 'NationX', 1")
edited("crud_delete", lambda g: crud.delete_rel(crud.delete_node(g, NATION + 4, detach=True), IN_REGION + 6), "MATCH (n:Nation) OPTIONAL MATCH (n)-[r:IN_REGION]->(x) RETURN n.key AS key, x.key AS region", "SELECT n_nationkey AS key, CASE WHEN n_nationkey <> 6 THEN n_regionkey END AS region FROM nation WHERE n_nationkey <> 4")
edited("crud_merge", lambda g: crud.merge_node(crud.merge_node(g, "Nation", {"key": 3}, on_match={"name": None, "seen": 1})[0], "Nation", {"key": 99}, on_create={"name": "new"})[0], "MATCH (n:Nation) RETURN n.key AS key, n.name AS name, n.seen AS seen", "SELECT n_nationkey AS key, CASE WHEN n_nationkey <> 3 THEN n_name END AS name, CASE WHEN n_nationkey = 3 THEN 1 END::BIGINT AS seen FROM nation UNION ALL SELECT 99, 'new', NULL")
edited("crud_clear", crud.clear, "MATCH (n) RETURN count(*) AS n", "SELECT 0::BIGINT AS n")
add("crud_get", lambda g: (lambda n, r: one(g.spark, id=n["id"], name=n["properties"]["name"], label=n["labels"][0], src=r["src"], dst=r["dst"], kind=r["type"], missing=crud.get_node(g, 5) is None))(crud.get_node(only(g, "IN_REGION"), NATION + 3), crud.get_rel(only(g, "IN_REGION"), IN_REGION + 3)), "SELECT 2000000000000 + n_nationkey AS id, n_name AS name, 'Nation' AS label, 2000000000000 + n_nationkey AS src, 1000000000000 + n_regionkey AS dst, 'IN_REGION' AS kind, true AS missing FROM nation WHERE n_nationkey = 3")
add("read_only_guard", lambda g: one(g.spark, read=is_read_only("MATCH (n {name: 'SET x'}) RETURN n"), write=is_read_only("match (n) set n.x = 1"), delete=is_read_only("MATCH (n) DETACH DELETE n")), "SELECT true AS read, false AS write, false AS delete")


def _saved(g: PropertyGraph) -> DataFrame:
    path = f"{shared_folder(g.spark)}/saved-{uuid.uuid4().hex}"
    with only(g, "IN_REGION", "LOCATED_IN") as own:
        own.save(path)
    return PropertyGraph.load(g.spark, path).query("MATCH (s:Supplier)-[:LOCATED_IN]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS region, count(s) AS suppliers, round(sum(s.acctbal), 2) AS balance")


add("save_and_open", _saved, "SELECT r_name AS region, count(*) AS suppliers, round(sum(s_acctbal), 2)::DOUBLE AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
cypher(
    "fn_conditional",
    "MATCH (s:Supplier) RETURN s.key AS key, ifnull(nullif(s.key, 3), -1) AS a, iif(s.acctbal > 0, 'in', 'out') AS b, typeof(s.acctbal) AS t",
    "SELECT s_suppkey AS key, coalesce(nullif(s_suppkey, 3), -1) AS a, CASE WHEN s_acctbal > 0 THEN 'in' ELSE 'out' END AS b, 'real' AS t FROM supplier",
)
cypher(
    "optional_match_exists",
    "MATCH (n:Nation) OPTIONAL MATCH (s:Supplier)-[:LOCATED_IN]->(n) WHERE s.acctbal > 0 AND EXISTS { (s)-[:LOCATED_IN]->(m:Nation)-[:IN_REGION]->(r:Region) WHERE r.key < 2 } RETURN n.key AS key, count(s) AS n",
    "SELECT n_nationkey AS key, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 0 AND n_regionkey < 2 GROUP BY 1",
)


def queries() -> dict[str, Query]:
    from .power import queries as power

    return QUERIES | power.QUERIES


def oracle_sql() -> dict[str, str]:
    from .power import queries as power

    return {k: v.replace("{F}", F_SQL).replace("{R}", R_SQL) for k, v in (SQL | power.SQL).items()}
