"""The registered graph queries over the driver's tables: name, query text, equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .operators import relational
from .sources.tables import driver_graph

FLAGSHIP = """
MATCH (n:Nation)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o:Order)
WHERE o.orderstatus = 'F'
RETURN n.name AS nation, count(o) AS orders, round(sum(o.totalprice), 2) AS revenue
ORDER BY revenue DESC LIMIT 10
"""

#: Chains of a user's events, and their paths of up to three hops.
_EDGE = "(SELECT event_id AS a, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)"
_PATHS = f"WITH RECURSIVE e AS (SELECT a, b FROM {_EDGE} WHERE b IS NOT NULL), p(s, t, h) AS (SELECT a, b, 1 FROM e UNION ALL SELECT p.s, e.b, p.h + 1 FROM p JOIN e ON p.t = e.a WHERE p.h < 3)"

TEXTS: dict[str, tuple[str, str, dict]] = {
    "node_scan_label": ("MATCH (c:Customer) RETURN c.name AS name, c.acctbal AS acctbal", "SELECT c_name AS name, c_acctbal AS acctbal FROM customer", {}),
    "node_scan_all": (
        "MATCH (n) RETURN labels(n)[0] AS label, count(*) AS n",
        "SELECT 'Region' AS label, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'Document', count(*) FROM documents UNION ALL SELECT 'Turn', count(*) FROM conversations UNION ALL SELECT 'Event', count(*) FROM events UNION ALL SELECT 'User', count(DISTINCT user_id) FROM events",
        {},
    ),
    "node_scan_props": ("MATCH (c:Customer {mktsegment: 'BUILDING'}) RETURN c.name AS name", "SELECT c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING'", {}),
    "create_unit": ("RETURN 1 + 2 AS a, 'x' AS b, [1, 2][0] AS c", "SELECT 3::BIGINT AS a, 'x' AS b, 1::BIGINT AS c", {}),
    "parameters": ("MATCH (o:Order) WHERE o.totalprice > $low AND o.orderstatus IN $st RETURN count(*) AS n", "SELECT count(*) AS n FROM orders WHERE o_totalprice > 200000 AND o_orderstatus IN ('F', 'O')", {"low": 200000.0, "st": ["F", "O"]}),
    "rel_scan_out": ("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.name AS c, id(o) % 281474976710656 AS o", "SELECT c_name AS c, o_orderkey AS o FROM customer JOIN orders ON c_custkey = o_custkey", {}),
    "rel_scan_in": ("MATCH (r:Region)<-[:IN_REGION]-(n:Nation) RETURN r.name AS r, n.name AS n", "SELECT r_name AS r, n_name AS n FROM region JOIN nation ON r_regionkey = n_regionkey", {}),
    "rel_scan_both": (
        "MATCH (a)-[:IN_REGION]-(b) RETURN a.name AS a, b.name AS b",
        "SELECT r_name AS a, n_name AS b FROM region JOIN nation ON r_regionkey = n_regionkey UNION ALL SELECT n_name, r_name FROM region JOIN nation ON r_regionkey = n_regionkey",
        {},
    ),
    "rel_types_or": (
        "MATCH (a)-[r:IN_NATION|IN_REGION]->(b) RETURN type(r) AS t, count(*) AS n",
        "SELECT 'IN_NATION' AS t, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n UNION ALL SELECT 'IN_REGION', count(*) FROM nation",
        {},
    ),
    "expand_2hop": (FLAGSHIP, "SELECT n_name AS nation, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY n_name ORDER BY revenue DESC LIMIT 10", {}),
    "expand_3hop_unique": (
        "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[a:IN_NATION]-(c:Customer)-[:PLACED]->(o:Order) RETURN r.name AS r, count(DISTINCT c) AS c, count(o) AS o",
        "SELECT r_name AS r, count(DISTINCT c_custkey) AS c, count(*) AS o FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY r_name",
        {},
    ),
    "rel_uniqueness": (
        "MATCH (a:Supplier)-[:IN_NATION]->(n:Nation)<-[:IN_NATION]-(b:Supplier) RETURN n.name AS n, count(*) AS pairs",
        "SELECT n_name AS n, count(*) AS pairs FROM nation JOIN supplier a ON a.s_nationkey = n_nationkey JOIN supplier b ON b.s_nationkey = n_nationkey AND a.s_suppkey <> b.s_suppkey GROUP BY n_name",
        {},
    ),
    "comma_pattern_fused": ("MATCH (c:Customer)-[:IN_NATION]->(n), (n)-[:IN_REGION]->(r) RETURN r.name AS r, count(c) AS n", "SELECT r_name AS r, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", {}),
    "rel_properties": (
        "MATCH (o:Order)-[l:CONTAINS]->(p:Part) WHERE l.quantity > 45 AND p.size < 10 RETURN p.brand AS brand, count(l) AS n, round(sum(l.extendedprice), 2) AS total",
        "SELECT p_brand AS brand, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_quantity > 45 AND p_size < 10 GROUP BY p_brand",
        {},
    ),
    "cross_product": ("MATCH (a:Region), (b:Nation) RETURN a.name AS a, b.name AS b", "SELECT r_name AS a, n_name AS b FROM region, nation", {}),
    "join_two_matches": (
        "MATCH (c:Customer)-[:IN_NATION]->(n:Nation) MATCH (s:Supplier)-[:IN_NATION]->(n) RETURN n.name AS n, count(*) AS pairs",
        "SELECT n_name AS n, count(*) AS pairs FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name",
        {},
    ),
    "theta_join": ("MATCH (a:Customer), (b:Supplier) WHERE a.acctbal = b.acctbal RETURN count(*) AS n", "SELECT count(*) AS n FROM customer JOIN supplier ON c_acctbal = s_acctbal", {}),
    "optional_match": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) RETURN c.name AS c, count(o) AS n", "SELECT c_name AS c, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_name", {}),
    "optional_match_where": (
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 300000 RETURN c.name AS c, count(o) AS n",
        "SELECT c_name AS c, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 GROUP BY c_name",
        {},
    ),
    "pattern_predicate": ("MATCH (c:Customer) WHERE (c)-[:PLACED]->() RETURN count(*) AS n", "SELECT count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", {}),
    "not_pattern": ("MATCH (c:Customer) WHERE NOT (c)-[:PLACED]->() RETURN c.name AS c", "SELECT c_name AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", {}),
    "size_pattern": ("MATCH (n:Nation) RETURN n.name AS n, size((n)<-[:IN_NATION]-()) AS k", "SELECT n_name AS n, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS k FROM nation", {}),
    "exists_property": ("MATCH (n) WHERE exists(n.acctbal) RETURN count(*) AS n", "SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n", {}),
    "pattern_comprehension": (
        "MATCH (r:Region) RETURN r.name AS r, size([(r)<-[:IN_REGION]-(n:Nation) WHERE n.name > 'C' | n.name]) AS k",
        "SELECT r_name AS r, count(n_name) AS k FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_name > 'C' GROUP BY r_name",
        {},
    ),
    "filter_bool_ops": (
        "MATCH (p:Part) WHERE (p.size > 10 AND p.size <= 20 OR NOT p.retailprice < 1500) XOR p.size = 15 RETURN count(*) AS n",
        "SELECT count(*) AS n FROM part WHERE ((p_size > 10 AND p_size <= 20 OR NOT p_retailprice < 1500) <> (p_size = 15))",
        {},
    ),
    "filter_compare": ("MATCH (p:Part) WHERE 5 < p.size <= 9 RETURN p.name AS name, p.size AS size", "SELECT p_name AS name, p_size::BIGINT AS size FROM part WHERE p_size > 5 AND p_size <= 9", {}),
    "filter_in": ("MATCH (p:Part) WHERE p.size IN [1, 7, 9] RETURN count(*) AS n", "SELECT count(*) AS n FROM part WHERE p_size IN (1, 7, 9)", {}),
    "filter_regex": ("MATCH (c:Customer) WHERE c.name =~ '.*7$' RETURN count(*) AS n", "SELECT count(*) AS n FROM customer WHERE regexp_matches(c_name, '.*7$')", {}),
    "filter_string_ops": ("MATCH (c:Customer) WHERE c.name STARTS WITH 'C' AND c.name ENDS WITH '5' AND c.name CONTAINS '0' RETURN count(*) AS n", "SELECT count(*) AS n FROM customer WHERE c_name LIKE 'C%' AND c_name LIKE '%5' AND c_name LIKE '%0%'", {}),
    "filter_null": ("MATCH (n) WHERE n.acctbal IS NULL AND n.name IS NOT NULL RETURN count(*) AS n", "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM part) AS n", {}),
    "case_simple": ("MATCH (o:Order) RETURN CASE o.orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS s, count(*) AS n", "SELECT CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS s, count(*) AS n FROM orders GROUP BY 1", {}),
    "case_generic": ("MATCH (p:Part) RETURN CASE WHEN p.size < 10 THEN 'small' WHEN p.size < 30 THEN 'mid' ELSE 'big' END AS s, count(*) AS n", "SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'mid' ELSE 'big' END AS s, count(*) AS n FROM part GROUP BY 1", {}),
    "quantifiers": (
        "MATCH (p:Part) WITH p, [p.size, 10, 20] AS l RETURN p.name AS name, all(x IN l WHERE x > 5) AS a, any(x IN l WHERE x > 20) AS b, none(x IN l WHERE x = 7) AS c, single(x IN l WHERE x = 10) AS d",
        "SELECT p_name AS name, p_size > 5 AS a, p_size > 20 AS b, p_size <> 7 AS c, p_size <> 10 AS d FROM part",
        {},
    ),
    "agg_group": ("MATCH (o:Order) RETURN o.orderstatus AS s, count(*) AS n, round(avg(o.totalprice), 2) AS a, min(o.totalprice) AS lo, max(o.totalprice) AS hi", "SELECT o_orderstatus AS s, count(*) AS n, round(avg(o_totalprice), 2) AS a, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1", {}),
    "agg_distinct": ("MATCH (c:Customer)-[:PLACED]->(o) RETURN count(DISTINCT c) AS c, count(DISTINCT o.orderpriority) AS p", "SELECT count(DISTINCT o_custkey) AS c, count(DISTINCT o_orderpriority) AS p FROM orders", {}),
    "agg_collect": (
        "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r, n ORDER BY n.name DESC WITH r.name AS r, collect(n.name) AS names RETURN r, names[0] AS first, size(names) AS k, reduce(s = '', x IN names | s + x + ',') AS joined",
        "SELECT r_name AS r, max(n_name) AS first, count(*) AS k, string_agg(n_name || ',', '' ORDER BY n_name DESC) AS joined FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
        {},
    ),
    "agg_stats": ("MATCH (p:Part) RETURN p.brand AS b, round(stDev(p.retailprice), 4) AS s, round(stDevP(p.retailprice), 4) AS sp", "SELECT p_brand AS b, round(coalesce(stddev_samp(p_retailprice), 0), 4) AS s, round(stddev_pop(p_retailprice), 4) AS sp FROM part GROUP BY 1", {}),
    "agg_percentiles": ("MATCH (p:Part) RETURN p.brand AS b, round(percentileCont(p.retailprice, 0.4), 4) AS c, percentileDisc(p.size, 0.5) AS d", "SELECT p_brand AS b, round(quantile_cont(p_retailprice, 0.4), 4) AS c, quantile_disc(p_size::BIGINT, 0.5) AS d FROM part GROUP BY 1", {}),
    "agg_empty": ("MATCH (p:Part) WHERE p.size < 0 RETURN count(p) AS n, sum(p.size) AS s, avg(p.size) AS a, max(p.size) AS m", "SELECT 0::BIGINT AS n, 0.0::DOUBLE AS s, NULL::DOUBLE AS a, NULL::BIGINT AS m", {}),
    "agg_expression": ("MATCH (o:Order) RETURN 1 + count(o) AS n, round(sum(o.totalprice) / count(*), 2) AS a", "SELECT 1 + count(*) AS n, round(sum(o_totalprice) / count(*), 2) AS a FROM orders", {}),
    "distinct_rows": ("MATCH (o:Order) RETURN DISTINCT o.orderstatus AS s, o.orderpriority AS p", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders", {}),
    "order_nulls": ("MATCH (n) WHERE n:Nation OR n:Supplier RETURN n.acctbal AS a ORDER BY a DESC LIMIT 30", "SELECT a FROM (SELECT NULL::DOUBLE AS a FROM nation UNION ALL SELECT s_acctbal FROM supplier) ORDER BY a DESC NULLS FIRST LIMIT 30", {}),
    "skip_limit": ("MATCH (o:Order) RETURN id(o) % 281474976710656 AS o ORDER BY o SKIP 100 LIMIT 25", "SELECT o_orderkey AS o FROM orders ORDER BY 1 OFFSET 100 LIMIT 25", {}),
    "topk": ("MATCH (o:Order) RETURN id(o) % 281474976710656 AS o, o.totalprice AS p ORDER BY p DESC, o LIMIT 20", "SELECT o_orderkey AS o, o_totalprice AS p FROM orders ORDER BY p DESC, o LIMIT 20", {}),
    "union_all": ("MATCH (r:Region) RETURN r.name AS x UNION ALL MATCH (n:Nation) RETURN n.name AS x", "SELECT r_name AS x FROM region UNION ALL SELECT n_name FROM nation", {}),
    "union_distinct": ("MATCH (c:Customer) RETURN c.mktsegment AS x UNION MATCH (o:Order) RETURN o.orderstatus AS x", "SELECT c_mktsegment AS x FROM customer UNION SELECT o_orderstatus FROM orders", {}),
    "unwind_list": ("UNWIND [3, null, 1] AS x RETURN x, x * 2 AS y", "SELECT * FROM (VALUES (3::BIGINT, 6::BIGINT), (NULL, NULL), (1, 2)) t(x, y)", {}),
    "unwind_nested": ("WITH [[1, 2], [3]] AS m UNWIND m AS l UNWIND l AS x RETURN x", "SELECT unnest([1, 2, 3])::BIGINT AS x", {}),
    "with_pipeline": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS n, sum(o.totalprice) AS t WHERE n > 10 MATCH (c)-[:IN_NATION]->(x:Nation) RETURN x.name AS nation, count(c) AS c, round(max(t), 2) AS t",
        "SELECT n_name AS nation, count(*) AS c, round(max(t), 2) AS t FROM (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS t FROM orders GROUP BY 1 HAVING count(*) > 10) JOIN customer ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
        {},
    ),
    "list_ops": ("MATCH (p:Part) WITH p.name AS name, [p.size, 1, 2] AS l RETURN name, head(l) AS h, last(l) AS t, size(tail(l)) AS s, reverse(l)[0] AS r, l[-2] AS m, (l + [9])[3] AS q, 2 IN l AS i", "SELECT p_name AS name, p_size::BIGINT AS h, 2::BIGINT AS t, 2::BIGINT AS s, 2::BIGINT AS r, 1::BIGINT AS m, 9::BIGINT AS q, true AS i FROM part", {}),
    "list_comprehension": ("MATCH (p:Part) RETURN p.name AS name, size([x IN range(1, p.size) WHERE x % 3 = 0 | x ^ 2]) AS n", "SELECT p_name AS name, (p_size // 3)::BIGINT AS n FROM part", {}),
    "reduce_expr": ("MATCH (p:Part) RETURN p.name AS name, reduce(a = 0, x IN range(1, p.size) | a + x) AS s", "SELECT p_name AS name, (p_size::BIGINT * (p_size + 1)) // 2 AS s FROM part", {}),
    "slices": ("MATCH (p:Part) WITH p.name AS name, range(0, p.size) AS l RETURN name, size(l[2..]) AS a, size(l[..-1]) AS b, size(l[1..3]) AS c", "SELECT p_name AS name, greatest(p_size - 1, 0)::BIGINT AS a, p_size::BIGINT AS b, least(p_size, 2)::BIGINT AS c FROM part", {}),
    "map_projection": ("MATCH (p:Part) WITH p {.name, .size, big: p.size > 25} AS m RETURN m.name AS name, m.size AS size, m.big AS big, m['name'] AS again", "SELECT p_name AS name, p_size::BIGINT AS size, p_size > 25 AS big, p_name AS again FROM part", {}),
    "string_functions": (
        "MATCH (c:Customer) RETURN c.name AS n, left(c.name, 3) AS l, right(c.name, 2) AS r, toUpper(c.mktsegment) AS u, toLower(c.mktsegment) AS w, substring(c.name, 1, 4) AS s, replace(c.name, '0', 'x') AS x, reverse(c.name) AS v, size(c.name) AS k, trim('  a ') AS t",
        "SELECT c_name AS n, left(c_name, 3) AS l, right(c_name, 2) AS r, upper(c_mktsegment) AS u, lower(c_mktsegment) AS w, substr(c_name, 2, 4) AS s, replace(c_name, '0', 'x') AS x, reverse(c_name) AS v, length(c_name) AS k, 'a' AS t FROM customer",
        {},
    ),
    "math_functions": (
        "MATCH (p:Part) RETURN p.name AS n, abs(-p.size) AS a, ceil(p.retailprice) AS c, floor(p.retailprice) AS f, round(p.retailprice) AS r, sign(p.size - 25) AS s, round(sqrt(p.size), 6) AS q, round(log(p.size + 1), 6) AS l, p.size / 7 AS d, p.size % 7 AS m, p.size ^ 2 AS w, round(sin(p.size) + cos(p.size) + atan2(p.size, 2), 6) AS t, round(haversin(0.5), 6) AS h",
        "SELECT p_name AS n, p_size::BIGINT AS a, ceil(p_retailprice) AS c, floor(p_retailprice) AS f, floor(p_retailprice + 0.5) AS r, sign(p_size - 25)::DOUBLE AS s, round(sqrt(p_size), 6) AS q, round(ln(p_size + 1), 6) AS l, (p_size // 7)::DOUBLE AS d, (p_size % 7)::BIGINT AS m, (p_size * p_size)::BIGINT AS w, round(sin(p_size) + cos(p_size) + atan2(p_size, 2), 6) AS t, round((1 - cos(0.5)) / 2, 6) AS h FROM part",
        {},
    ),
    "conversions": (
        "MATCH (p:Part) RETURN p.name AS n, toString(p.size) AS s, toInteger('10.2') AS i, toFloat('3.5') AS f, toInteger('x') AS z, toBoolean('TRUE') AS b, coalesce(p.nothing, p.size) AS c",
        "SELECT p_name AS n, p_size::VARCHAR AS s, 10::BIGINT AS i, 3.5::DOUBLE AS f, NULL::BIGINT AS z, true AS b, p_size::BIGINT AS c FROM part",
        {},
    ),
    "temporal_components": (
        "MATCH (o:Order) RETURN id(o) % 281474976710656 AS o, o.orderdate.year AS y, o.orderdate.quarter AS q, o.orderdate.month AS m, o.orderdate.week AS w, o.orderdate.day AS d, o.orderdate.dayOfWeek AS k, o.orderdate.ordinalDay AS n, o.orderdate.hour AS h",
        "SELECT o_orderkey AS o, year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m, week(o_orderdate) AS w, day(o_orderdate) AS d, isodow(o_orderdate) AS k, dayofyear(o_orderdate) AS n, hour(o_orderdate) AS h FROM orders",
        {},
    ),
    "temporal_truncate": (
        "MATCH (o:Order) RETURN id(o) % 281474976710656 AS o, toString(date.truncate('month', o.orderdate)) AS m, toString(date.truncate('week', o.orderdate)) AS w, toString(date.truncate('decade', o.orderdate)) AS d",
        "SELECT o_orderkey AS o, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS m, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS w, strftime(date_trunc('decade', o_orderdate), '%Y-%m-%d') AS d FROM orders",
        {},
    ),
    "temporal_arith": (
        "MATCH (o:Order) RETURN id(o) % 281474976710656 AS o, toString(date(o.orderdate) + duration({months: 1, days: 3})) AS a, toString(date(o.orderdate) - duration('P10D')) AS b",
        "SELECT o_orderkey AS o, strftime(o_orderdate::DATE + INTERVAL 1 MONTH + INTERVAL 3 DAY, '%Y-%m-%d') AS a, strftime(o_orderdate::DATE - INTERVAL 10 DAY, '%Y-%m-%d') AS b FROM orders",
        {},
    ),
    "duration_between": (
        "MATCH (o:Order) RETURN id(o) % 281474976710656 AS o, duration.inDays(date('1990-01-01'), date(o.orderdate)).days AS d, duration.inSeconds(date('1990-01-01'), date(o.orderdate)).seconds AS s",
        "SELECT o_orderkey AS o, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS d, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) * 86400 AS s FROM orders",
        {},
    ),
    "spatial_distance": (
        "MATCH (p:Part) RETURN p.name AS n, round(distance(point({x: p.size, y: 0}), point({x: 0, y: 3})), 6) AS d, round(distance(point({longitude: 12.5, latitude: 55.6}), point({longitude: 12.5, latitude: 55.6 + p.size / 100.0})), 3) AS g",
        "SELECT p_name AS n, round(sqrt(p_size * p_size + 9), 6) AS d, round(2 * 6378140.0 * asin(sqrt(pow(sin(radians(p_size / 100.0) / 2), 2))), 3) AS g FROM part",
        {},
    ),
    "var_length": ("MATCH (a:Event)-[:FOLLOWED_BY*1..3]->(b:Event) RETURN count(*) AS n", f"{_PATHS} SELECT count(*) AS n FROM p", {}),
    "var_length_zero": ("MATCH (n:Nation)-[:IN_REGION*0..1]-(x) RETURN n.name AS n, x.name AS x", "SELECT n_name AS n, n_name AS x FROM nation UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey", {}),
    "named_path": ("MATCH p = (c:Customer)-[:IN_NATION]->(:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS r, length(p) AS l, size(nodes(p)) AS k, count(*) AS n", "SELECT r_name AS r, 2::BIGINT AS l, 3::BIGINT AS k, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1", {}),
    "shortest_path": (
        "MATCH (a:Nation), (b:Nation), p = shortestPath((a)-[:IN_REGION*..2]-(b)) WHERE a.name < b.name RETURN a.name AS a, b.name AS b, length(p) AS l",
        "SELECT a.n_name AS a, b.n_name AS b, 2::BIGINT AS l FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name",
        {},
    ),
    "all_shortest_paths": (
        "MATCH (a:Nation), (b:Nation), p = allShortestPaths((a)-[:IN_REGION*..2]-(b)) WHERE a.name > b.name RETURN a.name AS a, b.name AS b, length(p) AS l, count(*) AS n",
        "SELECT a.n_name AS a, b.n_name AS b, 2::BIGINT AS l, count(*) AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name > b.n_name GROUP BY ALL",
        {},
    ),
    "shortest_path_where": (
        "MATCH (a:Nation {name: $from}), (b:Nation), p = shortestPath((a)-[:IN_REGION*..2]-(b)) WHERE b.name STARTS WITH 'C' OR b.name ENDS WITH '5' RETURN a.name AS a, b.name AS b, length(p) AS l, size(nodes(p)) AS k",
        "SELECT a.n_name AS a, b.n_name AS b, 2::BIGINT AS l, 3::BIGINT AS k FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name <> b.n_name WHERE a.n_name = (SELECT min(n_name) FROM nation) AND (b.n_name LIKE 'C%' OR b.n_name LIKE '%5')",
        {"from": None},
    ),
    "var_length_where": (
        "MATCH (a:Event)-[r:FOLLOWED_BY*1..3]->(b:Event) WHERE a.event_type = 'purchase' AND b.value > 50 RETURN size(r) AS hops, count(*) AS n",
        f"{_PATHS} SELECT p.h::BIGINT AS hops, count(*) AS n FROM p JOIN events a ON p.s = a.event_id JOIN events b ON p.t = b.event_id WHERE a.event_type = 'purchase' AND b.value > 50 GROUP BY 1",
        {},
    ),
    "turn_chain": (
        "MATCH p = (a:Turn)-[:NEXT*2..2]->(b:Turn) WHERE a.role = b.role RETURN a.role AS role, count(*) AS n",
        "SELECT a.role, count(*) AS n FROM (SELECT conv_id, role, lead(role, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS other FROM conversations) a WHERE a.role = a.other GROUP BY 1",
        {},
    ),
    "count_shortcut": ("MATCH (d:Document) RETURN count(d) AS n, count(*) AS m", "SELECT count(*) AS n, count(*) AS m FROM documents", {}),
    "count_rels_shortcut": ("MATCH ()-[r:DID]->() RETURN count(r) AS n", "SELECT count(*) AS n FROM events", {}),
    "deep_expression": ("MATCH (p:Part) RETURN p.name AS name, " + " + ".join(["p.size", *(str(i) for i in range(1, 40))]) + " AS s", "SELECT p_name AS name, (p_size + 780)::BIGINT AS s FROM part", {}),
    "mixed_values": (
        "MATCH (p:Part) WITH p.name AS name, [p.size, p.brand, p.size > 25] AS l RETURN name, 5 IN l AS five, l[1] STARTS WITH 'B' AS b, l[0] = l[1] AS same, toString(l[2]) AS t",
        "SELECT p_name AS name, p_size = 5 AS five, p_brand LIKE 'B%' AS b, false AS same, (p_size > 25)::VARCHAR AS t FROM part",
        {},
    ),
    "mixed_max": (
        "MATCH (p:Part) UNWIND [p.size, p.brand] AS x RETURN toString(max(x)) AS hi, toString(min(x)) AS lo, count(DISTINCT x) AS n",
        "SELECT max(p_size)::VARCHAR AS hi, min(p_brand) AS lo, count(DISTINCT p_size) + count(DISTINCT p_brand) AS n FROM part",
        {},
    ),
    "dynamic_key": ("UNWIND ['size', 'brand'] AS k MATCH (p:Part) RETURN p.name AS name, k, toString(p[k]) AS v, p[k] = p.size AS s", "SELECT p_name AS name, 'size' AS k, p_size::VARCHAR AS v, true AS s FROM part UNION ALL SELECT p_name, 'brand', p_brand, false FROM part", {}),
    "duration_distinct": (
        "MATCH (p:Part) RETURN sum(DISTINCT duration({days: p.size})).days AS d, sum(duration({days: p.size})).days AS s",
        "SELECT sum(DISTINCT p_size)::BIGINT AS d, sum(p_size)::BIGINT AS s FROM part",
        {},
    ),
    "duration_text": (
        "MATCH (p:Part) WITH p.name AS name, p.size AS k RETURN name, toString(duration({months: -k})) AS m, duration({months: -k}).years AS y, toString(duration({seconds: -60 * k - 1})) AS s, duration({seconds: -60 * k - 1}).minutes AS mi",
        "SELECT p_name AS name, 'P' || CASE WHEN p_size >= 12 THEN '-' || (p_size // 12) || 'Y' ELSE '' END || CASE WHEN p_size % 12 > 0 THEN '-' || (p_size % 12) || 'M' ELSE '' END AS m, -(p_size // 12)::BIGINT AS y, 'PT-' || p_size || 'M-1S' AS s, -p_size::BIGINT AS mi FROM part",
        {},
    ),
    "datetime_functions": (
        "MATCH (o:Order) WITH id(o) % 281474976710656 AS o, datetime({datetime: datetime(o.orderdate), timezone: '+02:00'}) AS d RETURN o, toString(d) AS t, d.hour AS h, d.timezone AS z, d.epochSeconds AS e, toString(datetime.truncate('day', d)) AS day, toString(d + duration('P1DT1H')) AS later",
        "SELECT o_orderkey AS o, strftime(o_orderdate + INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S') || '+02:00' AS t, hour(o_orderdate + INTERVAL 2 HOUR) AS h, '+02:00' AS z, epoch(o_orderdate)::BIGINT AS e, strftime(o_orderdate + INTERVAL 2 HOUR, '%Y-%m-%dT00:00:00') || '+02:00' AS day, strftime(o_orderdate + INTERVAL 27 HOUR, '%Y-%m-%dT%H:%M:%S') || '+02:00' AS later FROM orders",
        {},
    ),
    "localdatetime_functions": (
        "MATCH (o:Order) WITH id(o) % 281474976710656 AS o, localdatetime(o.orderdate) AS d RETURN o, toString(d) AS t, d.minute AS m, toString(localdatetime.truncate('month', d)) AS month, toString(localdatetime({date: date(o.orderdate), hour: 3, minute: 4})) AS at".replace("date(o.orderdate), hour", "date(d), hour"),
        "SELECT o_orderkey AS o, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS t, minute(o_orderdate) AS m, strftime(o_orderdate, '%Y-%m-01T00:00:00') AS month, strftime(o_orderdate, '%Y-%m-%dT03:04:00') AS at FROM orders",
        {},
    ),
    "time_functions": (
        "MATCH (o:Order) WITH id(o) % 281474976710656 AS o, o.orderdate AS d RETURN o, toString(time({datetime: datetime(d)})) AS t, toString(localtime(d)) AS l, localtime(d).hour AS h, toString(time.truncate('hour', time({hour: d.hour, minute: 30, timezone: '+01:00'}))) AS r, toString(localtime({hour: d.hour, minute: 5}) + duration('PT1H')) AS p".replace("localtime(d)", "localtime(localdatetime(d))"),
        "SELECT o_orderkey AS o, strftime(o_orderdate, '%H:%M:%S') || 'Z' AS t, strftime(o_orderdate, '%H:%M:%S') AS l, hour(o_orderdate) AS h, strftime(o_orderdate, '%H:00:00') || '+01:00' AS r, strftime(o_orderdate + INTERVAL 1 HOUR, '%H:05:00') AS p FROM orders",
        {},
    ),
    "duration_between_text": (
        "MATCH (o:Order) RETURN id(o) % 281474976710656 AS o, duration.between(date(o.orderdate), date('1990-01-01')).months AS m, duration.inMonths(date(o.orderdate), date('1990-01-01')).months AS n",
        "SELECT o_orderkey AS o, -datesub('month', DATE '1990-01-01', o_orderdate::DATE)::BIGINT AS m, -datesub('month', DATE '1990-01-01', o_orderdate::DATE)::BIGINT AS n FROM orders WHERE o_orderdate >= DATE '1990-01-01'",
        {},
    ),
    "split_text": ("MATCH (c:Customer) RETURN c.name AS n, split(c.name, '#')[0] AS a, size(split(c.name, '0')) > 0 AS b", "SELECT c_name AS n, split_part(c_name, '#', 1) AS a, true AS b FROM customer", {}),
    "rel_variable": ("MATCH (c:Customer)-[r]->(n:Nation) RETURN type(r) AS t, count(r) AS n, count(DISTINCT startNode(r).mktsegment) AS m", "SELECT 'IN_NATION' AS t, count(*) AS n, count(DISTINCT c_mktsegment) AS m FROM customer", {}),
    "keys_labels": ("MATCH (s:Supplier) RETURN labels(s)[0] AS l, size(keys(s)) AS k, properties(s).name AS n", "SELECT 'Supplier' AS l, 2::BIGINT AS k, s_name AS n FROM supplier", {}),
}


#: The nation that ``shortest_path_where`` starts from.
_FIRST_NATION = "MATCH (n:Nation) RETURN min(n.name) AS n"


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    text, _, params = TEXTS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark, driver_graph(spark, sf_dir))
        return engine.sql(text, {"from": engine.sql(_FIRST_NATION).first()[0]} if "from" in params else params)

    run.__name__ = name
    return run


def _steps(*texts: str):
    """Run update queries one after the other; the last one reads the new graph."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark, driver_graph(spark, sf_dir))
        for t in texts[:-1]:
            engine.run(t)
        return engine.sql(texts[-1])

    return run


WRITES: dict[str, tuple[tuple[str, ...], str]] = {
    "create_nodes": (("MATCH (r:Region) CREATE (h:Hub {name: r.name + ' hub'})-[:SERVES {w: 2}]->(r)", "MATCH (h:Hub)-[s:SERVES]->(r:Region) RETURN h.name AS h, r.name AS r, s.w AS w"), "SELECT r_name || ' hub' AS h, r_name AS r, 2::BIGINT AS w FROM region"),
    "set_props": (("MATCH (n:Nation) WHERE n.name STARTS WITH 'C' SET n.flag = 1, n:Marked", "MATCH (n:Nation) RETURN n.name AS n, n.flag AS f, n:Marked AS m"), "SELECT n_name AS n, CASE WHEN n_name LIKE 'C%' THEN 1::BIGINT END AS f, n_name LIKE 'C%' AS m FROM nation"),
    "set_map": (("MATCH (r:Region) SET r += {size: 5, name: 'X' + r.name}", "MATCH (r:Region) RETURN r.name AS n, r.size AS s"), "SELECT 'X' || r_name AS n, 5::BIGINT AS s FROM region"),
    "remove_props": (("MATCH (s:Supplier) WHERE s.acctbal < 0 REMOVE s.acctbal", "MATCH (s:Supplier) RETURN count(*) AS n, count(s.acctbal) AS k"), "SELECT count(*) AS n, count(*) FILTER (s_acctbal >= 0) AS k FROM supplier"),
    "delete_nodes": (("MATCH (c:Customer) WHERE NOT (c)-[:PLACED]->() DETACH DELETE c", "MATCH (c:Customer) RETURN count(*) AS n"), "SELECT count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)"),
    "detach_delete": (("MATCH (n:Nation) WHERE n.name < 'M' DETACH DELETE n", "MATCH (c:Customer)-[:IN_NATION]->(n) RETURN count(*) AS n"), "SELECT count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name >= 'M'"),
    "delete_rels": (("MATCH (n:Nation)-[r:IN_REGION]->() WHERE n.name < 'M' DELETE r", "MATCH (:Nation)-[r:IN_REGION]->() RETURN count(r) AS n"), "SELECT count(*) AS n FROM nation WHERE n_name >= 'M'"),
    "merge_node": (("MATCH (c:Customer) MERGE (m:Segment {name: c.mktsegment})", "MATCH (m:Segment) RETURN m.name AS n"), "SELECT DISTINCT c_mktsegment AS n FROM customer"),
    "merge_rel": (("MATCH (c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) WITH DISTINCT n, r MERGE (n)-[:PART_OF]->(r)", "MATCH (n)-[x:PART_OF]->(r) RETURN n.name AS n, r.name AS r"), "SELECT DISTINCT n_name AS n, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "foreach_set": (("MATCH (r:Region) FOREACH (x IN [1, 2] | SET r.mark = 7)", "MATCH (r:Region) RETURN r.name AS n, r.mark AS m"), "SELECT r_name AS n, 7::BIGINT AS m FROM region"),
    "foreach_fold": (
        ("MATCH (n:Nation) SET n.age = 13", "MATCH (n:Nation) FOREACH (x IN [1, 2, 3] | SET n.age = n.age + x, n.mark = x)", "MATCH (n:Nation) RETURN n.name AS n, n.age AS a, n.mark AS m"),
        "SELECT n_name AS n, 19::BIGINT AS a, 3::BIGINT AS m FROM nation",
    ),
    "foreach_create": (
        ("MATCH (r:Region) FOREACH (x IN [1, 2] | CREATE (:Leaf {at: x})-[:OF]->(r))", "MATCH (l:Leaf)-[:OF]->(r:Region) RETURN r.name AS n, l.at AS a"),
        "SELECT r_name AS n, x::BIGINT AS a FROM region, (VALUES (1), (2)) t(x)",
    ),
    "remove_label_type": (
        ("MATCH (n:Nation) SET n:Marked", "MATCH (n:Marked) WHERE n.name < 'M' REMOVE n:Marked", "MATCH (:Supplier)-[r:IN_NATION]->() REMOVE r:IN_NATION", "MATCH (n:Nation) OPTIONAL MATCH (n)<-[r:IN_NATION]-(x) RETURN n.name AS n, n:Marked AS m, count(r) AS k"),
        "SELECT n_name AS n, n_name >= 'M' AS m, count(c_custkey) AS k FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL",
    ),
    "merge_on": (
        ("MATCH (r:Region) MERGE (x:Region {name: r.name}) ON MATCH SET x.seen = 1", "UNWIND ['Nowhere', 'Nowhere', 'Else'] AS k MERGE (x:Region {name: k}) ON CREATE SET x.seen = 2", "MATCH (x:Region) RETURN x.name AS n, x.seen AS s"),
        "SELECT r_name AS n, 1::BIGINT AS s FROM region UNION ALL SELECT 'Nowhere', 2 UNION ALL SELECT 'Else', 2",
    ),
    "set_last_row": (
        ("MATCH (n:Nation) UNWIND [1, 2, 3] AS x WITH n, x ORDER BY n.name, x SET n.last = x", "MATCH (n:Nation) RETURN n.name AS n, n.last AS l"),
        "SELECT n_name AS n, 3::BIGINT AS l FROM nation",
    ),
}


def call_procedure(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, driver_graph(spark, sf_dir))
    engine.register_procedure("math.add", lambda a, b: a + b, "total")
    return engine.sql("MATCH (p:Part) CALL math.add(p.size, 2) YIELD total AS t WHERE t > 10 RETURN t, count(*) AS n")


def udf_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, driver_graph(spark, sf_dir))
    engine.register_function("initials", lambda s: F.concat(F.substring(s, 1, 1), F.lit("."), F.right(s, F.lit(1))))
    return engine.sql("MATCH (n:Nation) RETURN n.name AS n, initials(n.name) AS i")


def udaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, driver_graph(spark, sf_dir))
    engine.register_aggregate("spread", lambda x: F.max(x) - F.min(x))
    return engine.sql("MATCH (p:Part) RETURN p.brand AS brand, spread(p.size) AS s, 1 + spread(p.size) * 2 AS t")


def index_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, driver_graph(spark, sf_dir))
    for text in ("CREATE INDEX ON :Customer(name)", "CREATE INDEX ON :Order(orderdate, totalprice)", "CREATE INDEX ON :Part(size)", "DROP INDEX ON :Part(size)"):
        engine.run(text)
    return spark.createDataFrame([(label, ",".join(props)) for label, props in engine.indexes()], "label string, properties string")


def node_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = driver_graph(spark, sf_dir)
    return graph.node_at((3 << 48) + 7).select(F.col("n.name").alias("name"), F.col("n.labels")[0].alias("label"))


def count_from_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = driver_graph(spark, sf_dir)
    rows = [("Customer", g.count_nodes("Customer")), ("PLACED", g.count_rels("PLACED"))]
    return spark.createDataFrame(rows, "what string, n long")


def _df_join(how: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("c"))
        s = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("s"))
        return relational.join(c, s, how)

    return run


def _df_sql(how: str) -> str:
    return f"SELECT k, c, s FROM (SELECT c_nationkey AS k, c_name AS c FROM customer WHERE c_acctbal > 5000) {how} JOIN (SELECT s_nationkey AS k, s_name AS s FROM supplier WHERE s_acctbal > 5000) USING (k)"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: _query(n) for n in TEXTS}
QUERIES |= {n: _steps(*t) for n, (t, _) in WRITES.items()}
QUERIES |= {"call_procedure": call_procedure, "udf_scalar": udf_scalar, "udaf": udaf, "index_catalog": index_catalog, "node_at": node_at, "count_from_stats": count_from_stats, "df_right_join": _df_join("right"), "df_full_join": _df_join("outer")}

ORACLES: dict[str, str] = {n: s for n, (_, s, _) in TEXTS.items()} | {n: s for n, (_, s) in WRITES.items()}
ORACLES |= {
    "call_procedure": "SELECT p_size + 2::BIGINT AS t, count(*) AS n FROM part WHERE p_size + 2 > 10 GROUP BY 1",
    "udf_scalar": "SELECT n_name AS n, left(n_name, 1) || '.' || right(n_name, 1) AS i FROM nation",
    "udaf": "SELECT p_brand AS brand, (max(p_size) - min(p_size))::BIGINT AS s, (1 + (max(p_size) - min(p_size)) * 2)::BIGINT AS t FROM part GROUP BY 1",
    "index_catalog": "SELECT * FROM (VALUES ('Customer', 'name'), ('Order', 'orderdate,totalprice')) t(label, properties)",
    "node_at": "SELECT c_name AS name, 'Customer' AS label FROM customer WHERE c_custkey = 7",
    "count_from_stats": "SELECT 'Customer' AS what, count(*) AS n FROM customer UNION ALL SELECT 'PLACED', count(*) FROM orders",
    "df_right_join": _df_sql("RIGHT"),
    "df_full_join": _df_sql("FULL"),
}
