"""Queries of the graph engine over the driver's tables, each with its SQL where the semantics coincide."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trellis.cypher.values import ref
from trellis.functions.filters import LabelFilter, PropertyFilter, PropertyFilterGroup, SortOrder
from trellis.graph import Graph
from trellis.operators import search, traversal
from trellis.plans.problems import Query
from trellis.sources import export
from trellis.streaming import windows
from trellis.tables import read, spread

KEYS = {"Region": ("region", "r_regionkey"), "Nation": ("nation", "n_nationkey"), "Customer": ("customer", "c_custkey"), "Supplier": ("supplier", "s_suppkey"), "Part": ("part", "p_partkey"), "Order": ("orders", "o_orderkey"), "Event": ("events", "event_id"), "Document": ("documents", "doc_id"), "Vec": ("embeddings", "vec_id")}


def trade(spark: SparkSession, d: str) -> Graph:
    """Customers, orders, parts, suppliers, nations and regions as a typed graph."""
    g = Graph(spark)
    table = lambda name, *columns: lambda: read(spark, d, name).select(*columns or "*")
    for label in ("Region", "Nation", "Customer", "Supplier", "Part", "Order"):
        name, key = KEYS[label]
        g.register_nodes(label, table(name), key)
    g.register_relationships("IN_REGION", table("nation", "n_nationkey", "n_regionkey"), ("Nation", "n_nationkey"), ("Region", "n_regionkey"))
    g.register_relationships("FROM_NATION", table("customer", "c_custkey", "c_nationkey"), ("Customer", "c_custkey"), ("Nation", "c_nationkey"))
    g.register_relationships("FROM_NATION", table("supplier", "s_suppkey", "s_nationkey"), ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"))
    g.register_relationships("PLACED", table("orders", "o_custkey", "o_orderkey"), ("Customer", "o_custkey"), ("Order", "o_orderkey"))
    g.register_relationships("HOLDS", table("lineitem"), ("Order", "l_orderkey"), ("Part", "l_partkey"))
    g.register_relationships("SUPPLIES", lambda: read(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct(), ("Supplier", "l_suppkey"), ("Part", "l_partkey"))
    return g


def clicks(spark: SparkSession, d: str) -> Graph:
    """Events, their users, and each user's next event."""
    g = Graph(spark)
    events = read(spark, d, "events")
    g.register_nodes("Event", events, "event_id")
    g.register_nodes("User", events.select("user_id").distinct(), "user_id")
    g.register_relationships("BY_USER", events.select("event_id", "user_id"), ("Event", "event_id"), ("User", "user_id"))
    following = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    g.register_relationships("NEXT", events.select("event_id", following.alias("next_id")).where("next_id IS NOT NULL"), ("Event", "event_id"), ("Event", "next_id"))
    return g


def social(spark: SparkSession, d: str) -> Graph:
    """The nodes and relationships tables with JSON properties."""
    return Graph(spark).register_json(read(spark, d, "nodes"), read(spark, d, "relationships"), {"name": "string", "title": "string", "city": "string"}, {"role": "string"})


def cypher(make: Callable[[SparkSession, str], Graph], text: str) -> Query:
    return lambda spark, d: make(spark, d).execute(text)


PLACED = "customer JOIN orders ON o_custkey = c_custkey"
# name: graph, query, SQL
CYPHER: dict[str, tuple[Callable[[SparkSession, str], Graph], str, str]] = {
    "top_customers": (
        trade,
        "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE c.c_mktsegment = 'BUILDING' RETURN c.c_name AS c_name, c.c_custkey AS k, COUNT(*) AS n_orders, round(SUM(o.o_totalprice), 2) AS total ORDER BY total DESC, k LIMIT 10",
        f"SELECT c_name, c_custkey AS k, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM {PLACED} WHERE c_mktsegment = 'BUILDING' GROUP BY c_name, c_custkey ORDER BY total DESC, k LIMIT 10",
    ),
    "match_where": (
        trade,
        "MATCH (c:customer) WHERE c.c_acctbal > 5000 AND c.c_mktsegment IN ['BUILDING', 'MACHINERY'] RETURN c.c_custkey AS k, c.c_name AS name",
        "SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_acctbal > 5000 AND c_mktsegment IN ('BUILDING', 'MACHINERY')",
    ),
    "match_inline_map": (trade, "MATCH (o:Order {o_orderstatus: 'F'}) RETURN o.o_orderkey AS k", "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F'"),
    "match_all_labels": (
        trade,
        "MATCH (n) RETURN labels(n)[0] AS label, COUNT(*) AS n",
        "SELECT 'Region' AS label, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders",
    ),
    "three_valued_logic": (
        trade,
        "MATCH (p:Part) RETURN p.p_partkey AS k, p.p_size > 10 AND p.missing = 1 AS a, p.p_size > 10 OR p.missing = 1 AS o, NOT p.missing AS n, p.p_size XOR true AS x, p.p_brand = 1 AS e, p.p_brand < 1 AS l, p.p_size IN [1, null] AS i",
        "SELECT p_partkey AS k, CASE WHEN p_size > 10 THEN NULL ELSE false END AS a, CASE WHEN p_size > 10 THEN true END AS o, CAST(NULL AS BOOLEAN) AS n, CAST(NULL AS BOOLEAN) AS x, false AS e, CAST(NULL AS BOOLEAN) AS l, CASE WHEN p_size = 1 THEN true END AS i FROM part",
    ),
    "string_predicates": (
        trade,
        "MATCH (p:Part) WHERE p.p_name STARTS WITH 'a' OR p.p_name ENDS WITH 'e' OR p.p_name CONTAINS 'gi' OR p.p_type =~ 'S.*' RETURN p.p_partkey AS k",
        "SELECT p_partkey AS k FROM part WHERE starts_with(p_name, 'a') OR ends_with(p_name, 'e') OR contains(p_name, 'gi') OR regexp_full_match(p_type, 'S.*')",
    ),
    "case_when": (
        trade,
        "MATCH (o:Order) RETURN CASE o.o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS s, CASE WHEN o.o_totalprice > 200000 THEN 'big' ELSE 'small' END AS b, COUNT(*) AS n",
        "SELECT CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS s, CASE WHEN o_totalprice > 200000 THEN 'big' ELSE 'small' END AS b, count(*) AS n FROM orders GROUP BY 1, 2",
    ),
    "arithmetic": (
        trade,
        "MATCH (p:Part) RETURN p.p_partkey AS k, p.p_size * 2 + 1 AS a, p.p_size / 4 AS d, p.p_size % 7 AS m, -p.p_size AS u, round(p.p_retailprice - 1.5, 4) AS f, p.p_brand + '/' + p.p_type AS s",
        "SELECT p_partkey AS k, CAST(p_size * 2 + 1 AS BIGINT) AS a, CAST(p_size // 4 AS BIGINT) AS d, CAST(p_size % 7 AS BIGINT) AS m, CAST(-p_size AS BIGINT) AS u, round(p_retailprice - 1.5, 4) AS f, p_brand || '/' || p_type AS s FROM part",
    ),
    "order_skip_limit": (
        trade,
        "MATCH (p:Part) RETURN p.p_brand AS brand, p.p_partkey AS k ORDER BY brand DESC, k SKIP 5 LIMIT 20",
        "SELECT p_brand AS brand, p_partkey AS k FROM part ORDER BY brand DESC, k LIMIT 20 OFFSET 5",
    ),
    "nulls_last": (
        trade,
        "MATCH (n) RETURN n.p_size AS size, id(n) % 1000 AS i ORDER BY size DESC, i, labels(n)[0] LIMIT 7",
        "SELECT CAST(p_size AS BIGINT) AS size, CAST((5 * 1099511627776 + p_partkey) % 1000 AS BIGINT) AS i FROM part ORDER BY size DESC, i LIMIT 7",
    ),
    "distinct": (trade, "MATCH (o:Order) RETURN DISTINCT o.o_orderstatus AS s, o.o_orderpriority AS p", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders"),
    "aggregates": (
        trade,
        "MATCH (o:Order) RETURN COUNT(*) AS n, COUNT(DISTINCT o.o_orderstatus) AS d, round(SUM(o.o_totalprice), 0) AS s, round(AVG(o.o_totalprice), 4) AS a, MIN(o.o_totalprice) AS lo, MAX(o.o_orderpriority) AS hi, round(STDDEV(o.o_totalprice), 4) AS sd, round(PERCENTILECONT(o.o_totalprice, 0.9), 4) AS p90",
        "SELECT count(*) AS n, count(DISTINCT o_orderstatus) AS d, round(sum(o_totalprice), 0) AS s, round(avg(o_totalprice), 4) AS a, min(o_totalprice) AS lo, max(o_orderpriority) AS hi, round(stddev_pop(o_totalprice), 4) AS sd, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders",
    ),
    "aggregate_distinct": (
        trade,
        "MATCH (p:Part) RETURN p.p_brand AS brand, SUM(DISTINCT p.p_size) AS s, round(AVG(DISTINCT p.p_size), 6) AS a, round(STDDEV(DISTINCT p.p_size), 6) AS sd, round(PERCENTILECONT(DISTINCT p.p_size, 0.5), 6) AS m",
        "SELECT p_brand AS brand, CAST(sum(DISTINCT p_size) AS BIGINT) AS s, round(avg(DISTINCT p_size), 6) AS a, round(stddev_pop(DISTINCT p_size), 6) AS sd, round(quantile_cont(DISTINCT p_size, 0.5), 6) AS m FROM part GROUP BY p_brand",
    ),
    "aggregate_nested": (
        trade,
        "MATCH (c:Customer) RETURN c.c_mktsegment AS s, COUNT(*) * 2 + 1 AS n, round(MAX(c.c_acctbal) - MIN(c.c_acctbal), 4) AS spread ORDER BY n",
        "SELECT c_mktsegment AS s, count(*) * 2 + 1 AS n, round(max(c_acctbal) - min(c_acctbal), 4) AS spread FROM customer GROUP BY c_mktsegment",
    ),
    "aggregate_empty": (trade, "MATCH (c:Customer) WHERE c.c_acctbal > 1000000000 RETURN COUNT(c) AS n, SUM(c.c_acctbal) AS s, MAX(c.c_name) AS m", "SELECT count(*) AS n, sum(c_acctbal) AS s, max(c_name) AS m FROM customer WHERE c_acctbal > 1000000000"),
    "collect": (
        trade,
        "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r.r_name AS region, n.n_name AS nation ORDER BY nation WITH region, COLLECT(nation) AS names RETURN region, size(names) AS n, reduce(s = 0, x IN names | s + size(x)) AS letters",
        "SELECT r_name AS region, count(*) AS n, CAST(sum(length(n_name)) AS BIGINT) AS letters FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    ),
    "with_having": (
        trade,
        "MATCH (c:Customer)-[:PLACED]->(o) WITH c, COUNT(o) AS n WHERE n > 12 RETURN c.c_custkey AS k, c.c_mktsegment AS s, n",
        f"SELECT c_custkey AS k, c_mktsegment AS s, count(*) AS n FROM {PLACED} GROUP BY c_custkey, c_mktsegment HAVING count(*) > 12",
    ),
    "with_top": (
        trade,
        "MATCH (o:Order) WITH o ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 50 MATCH (c:Customer)-[:PLACED]->(o) RETURN c.c_custkey AS k, o.o_orderkey AS ok",
        "SELECT o_custkey AS k, o_orderkey AS ok FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50",
    ),
    "unwind": (trade, "UNWIND [1, 2, 3] AS x UNWIND ['a', 'b'] AS y WITH x, y WHERE x <> 2 RETURN x, y, x + 1 AS z", "SELECT CAST(x AS BIGINT) AS x, y, CAST(x + 1 AS BIGINT) AS z FROM (SELECT unnest([1, 3]) AS x), (SELECT unnest(['a', 'b']) AS y)"),
    "union_all": (trade, "MATCH (c:Customer) RETURN c.c_nationkey AS n UNION ALL MATCH (s:Supplier) RETURN s.s_nationkey AS n", "SELECT CAST(c_nationkey AS BIGINT) AS n FROM customer UNION ALL SELECT CAST(s_nationkey AS BIGINT) FROM supplier"),
    "union_distinct": (trade, "MATCH (c:Customer) RETURN c.c_nationkey AS n UNION MATCH (s:Supplier) RETURN s.s_nationkey AS n", "SELECT CAST(c_nationkey AS BIGINT) AS n FROM customer UNION SELECT CAST(s_nationkey AS BIGINT) FROM supplier"),
    "call_subquery": (
        trade,
        "MATCH (n:Nation) CALL { WITH n MATCH (n)<-[:FROM_NATION]-(s:Supplier) RETURN s.s_suppkey AS best, s.s_acctbal AS bal ORDER BY bal DESC, best LIMIT 2 } RETURN n.n_name AS nation, best, bal",
        "SELECT n_name AS nation, s_suppkey AS best, s_acctbal AS bal FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rn FROM supplier) JOIN nation ON s_nationkey = n_nationkey WHERE rn <= 2",
    ),
    "call_aggregate": (
        trade,
        "MATCH (r:Region) CALL { WITH r MATCH (r)<-[:IN_REGION]-(n)<-[:FROM_NATION]-(c:Customer) RETURN COUNT(*) AS customers } RETURN r.r_name AS region, customers",
        "SELECT r_name AS region, count(*) AS customers FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name",
    ),
    "hop_incoming": (trade, "MATCH (o:Order)<-[:PLACED]-(c:Customer) WHERE o.o_orderstatus = 'P' RETURN o.o_orderkey AS o, c.c_custkey AS c", "SELECT o_orderkey AS o, o_custkey AS c FROM orders WHERE o_orderstatus = 'P'"),
    "hop_undirected": (
        trade,
        "MATCH (a)-[:IN_REGION]-(b) RETURN labels(a)[0] AS a, labels(b)[0] AS b, COUNT(*) AS n",
        "SELECT 'Nation' AS a, 'Region' AS b, count(*) AS n FROM nation UNION ALL SELECT 'Region', 'Nation', count(*) FROM nation",
    ),
    "hop_types": (
        trade,
        "MATCH (n:Nation)-[r:IN_REGION|FROM_NATION]-(x) RETURN type(r) AS t, labels(x)[0] AS l, COUNT(*) AS n",
        "SELECT 'IN_REGION' AS t, 'Region' AS l, count(*) AS n FROM nation UNION ALL SELECT 'FROM_NATION', 'Customer', count(*) FROM customer UNION ALL SELECT 'FROM_NATION', 'Supplier', count(*) FROM supplier",
    ),
    "rel_properties": (
        trade,
        "MATCH (o:Order)-[l:HOLDS]->(p:Part) WHERE l.l_quantity >= 45 AND p.p_size < 10 RETURN p.p_brand AS brand, COUNT(*) AS n, round(SUM(l.l_extendedprice * (1 - l.l_discount)), 0) AS revenue",
        "SELECT p_brand AS brand, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE l_quantity >= 45 AND p_size < 10 GROUP BY p_brand",
    ),
    "multi_hop": (
        trade,
        "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:FROM_NATION]-(c:Customer)-[:PLACED]->(o:Order) RETURN r.r_name AS region, COUNT(*) AS n, round(SUM(o.o_totalprice), 0) AS total",
        f"SELECT r_name AS region, count(*) AS n, round(sum(o_totalprice), 0) AS total FROM {PLACED} JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    ),
    "cyclic": (
        trade,
        "MATCH (c:Customer)-[:PLACED]->(o:Order)-[:HOLDS]->(p:Part)<-[:SUPPLIES]-(s:Supplier)-[:FROM_NATION]->(n:Nation)<-[:FROM_NATION]-(c) RETURN n.n_name AS nation, COUNT(*) AS n",
        "SELECT n_name AS nation, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem l ON l.l_orderkey = o_orderkey JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) x ON x.l_partkey = l.l_partkey JOIN supplier ON s_suppkey = x.l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE s_nationkey = c_nationkey GROUP BY n_name",
    ),
    "theta_join": (
        trade,
        "MATCH (a:Supplier), (b:Supplier) WHERE a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal RETURN a.s_suppkey AS a, b.s_suppkey AS b",
        "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal",
    ),
    "comma_patterns": (
        trade,
        "MATCH (c:Customer)-[:FROM_NATION]->(n:Nation), (s:Supplier)-[:FROM_NATION]->(n) RETURN n.n_name AS nation, COUNT(*) AS pairs",
        "SELECT n_name AS nation, count(*) AS pairs FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name",
    ),
    "optional_match": (
        trade,
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 300000 RETURN c.c_custkey AS k, COUNT(o) AS big, MAX(o.o_totalprice) AS top",
        "SELECT c_custkey AS k, count(o_orderkey) AS big, max(o_totalprice) AS top FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 GROUP BY c_custkey",
    ),
    "exists_pattern": (
        trade,
        "MATCH (c:Customer) WHERE EXISTS((c)-[:PLACED]->(:Order {o_orderstatus: 'P'})) RETURN c.c_custkey AS k",
        "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    ),
    "not_exists_pattern": (trade, "MATCH (c:Customer) WHERE NOT (c)-[:PLACED]->() RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    "exists_in_or": (
        trade,
        "MATCH (c:Customer) WHERE c.c_acctbal < 0 OR EXISTS { MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 400000 } RETURN c.c_custkey AS k",
        "SELECT c_custkey AS k FROM customer WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    ),
    "pattern_comprehension": (
        trade,
        "MATCH (n:Nation) RETURN n.n_name AS nation, size([(n)<-[:FROM_NATION]-(s:Supplier) WHERE s.s_acctbal > 0 | s.s_suppkey]) AS suppliers",
        "SELECT n_name AS nation, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 0 GROUP BY n_name",
    ),
    "list_functions": (
        trade,
        "MATCH (p:Part) WITH p.p_partkey AS k, split(p.p_name, ' ') AS w RETURN k, size(w) AS n, head(w) AS h, last(w) AS l, size(tail(w)) AS t, w[0] AS a, w[-1] AS z, w[9] AS none, size(w[0..2]) AS s, any(x IN w WHERE x CONTAINS 'e') AS e, all(x IN w WHERE size(x) > 2) AS al, none(x IN w WHERE x = 'red') AS no, single(x IN w WHERE x STARTS WITH 'b') AS si, [x IN w WHERE size(x) > 4 | toUpper(x)][0] AS u, size(range(1, size(w))) AS r",
        "SELECT k, len(w) AS n, w[1] AS h, w[-1] AS l, greatest(len(w) - 1, 0) AS t, w[1] AS a, w[-1] AS z, w[10] AS none, least(len(w), 2) AS s, len(list_filter(w, lambda x: contains(x, 'e'))) > 0 AS e, len(list_filter(w, lambda x: length(x) <= 2)) = 0 AS al, NOT list_contains(w, 'red') AS no, len(list_filter(w, lambda x: starts_with(x, 'b'))) = 1 AS si, upper(list_filter(w, lambda x: length(x) > 4)[1]) AS u, len(w) AS r FROM (SELECT p_partkey AS k, string_split(p_name, ' ') AS w FROM part)",
    ),
    "string_functions": (
        trade,
        "MATCH (p:Part) RETURN p.p_partkey AS k, toUpper(p.p_name) AS u, toLower(p.p_brand) AS l, substring(p.p_type, 1, 3) AS s, replace(p.p_name, 'e', '3') AS r, levenshtein(p.p_name, p.p_type) AS d, matches(p.p_name, 'e.$') AS m, size(p.p_name) AS n, snake_case('PartName') AS c, toInteger('42') AS i, toFloat('1.5') AS f, toString(p.p_size) AS t, coalesce(p.missing, p.p_brand) AS co, trim('  x ') AS tr, strip_html('<b>x</b>') AS h",
        "SELECT p_partkey AS k, upper(p_name) AS u, lower(p_brand) AS l, substr(p_type, 2, 3) AS s, replace(p_name, 'e', '3') AS r, levenshtein(p_name, p_type) AS d, regexp_matches(p_name, 'e.$') AS m, length(p_name) AS n, 'part_name' AS c, CAST(42 AS BIGINT) AS i, CAST(1.5 AS DOUBLE) AS f, CAST(p_size AS VARCHAR) AS t, p_brand AS co, 'x' AS tr, 'x' AS h FROM part",
    ),
    "jaccard": (
        trade,
        "MATCH (p:Part) RETURN p.p_partkey AS k, round(jaccard(p.p_name, 'red green blue'), 6) AS j",
        "SELECT p_partkey AS k, round(len(list_intersect(list_distinct(w), ['red', 'green', 'blue'])) / len(list_distinct(list_concat(w, ['red', 'green', 'blue']))), 6) AS j FROM (SELECT p_partkey, list_filter(string_split_regex(p_name, '\\s+'), lambda x: x <> '') AS w FROM part)",
    ),
    "temporal": (
        trade,
        "MATCH (o:Order) WHERE o.o_orderdate >= localdatetime('1995-01-01T00:00:00') RETURN date.truncate('month', date(o.o_orderdate)) AS m, date(o.o_orderdate).year AS y, COUNT(*) AS n, MIN(date(o.o_orderdate) + duration('P1W')) AS w",
        "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, year(o_orderdate) AS y, count(*) AS n, CAST(min(CAST(o_orderdate AS DATE) + 7) AS DATE) AS w FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1, 2",
    ),
    "spatial": (
        trade,
        "MATCH (p:Part) RETURN p.p_partkey AS k, round(distance(point({x: p.p_size, y: 0}), point({x: 0, y: 4})), 6) AS flat, round(distance(point({longitude: 0.0, latitude: 0.0}), point({longitude: 1.0, latitude: p.p_size})), 0) AS ball",
        "SELECT p_partkey AS k, round(sqrt(p_size * p_size + 16), 6) AS flat, round(2 * 6371000 * atan2(sqrt(h), sqrt(1 - h)), 0) AS ball FROM (SELECT p_partkey, p_size, pow(sin(radians(p_size) / 2), 2) + cos(radians(p_size)) * pow(sin(radians(1) / 2), 2) AS h FROM part)",
    ),
    "maps": (
        trade,
        "MATCH (p:Part) WITH p.p_partkey AS k, {a: p.p_size, b: p.p_brand} AS m RETURN k, m.a AS a, m['b'] AS b, apoc.map.get(apoc.map.merge(m, {a: 0}), 'a') AS z, size(keys(m)) AS n, apoc.text.join([m.b, 'x'], '-') AS j, apoc.text.replace(m.b, '[0-9]+', '#') AS r, apoc.coll.contains([1, 2], 2) AS c",
        "SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS a, p_brand AS b, CAST(0 AS BIGINT) AS z, CAST(2 AS BIGINT) AS n, p_brand || '-x' AS j, regexp_replace(p_brand, '[0-9]+', '#', 'g') AS r, true AS c FROM part",
    ),
    "list_membership": (trade, "MATCH (p:Part) WHERE p.p_size = [1, 2, 3] RETURN p.p_partkey AS k", "SELECT p_partkey AS k FROM part WHERE p_size IN (1, 2, 3)"),
    "var_length": (
        clicks,
        "MATCH (a:Event)-[:NEXT*1..3]->(b:Event) WHERE a.event_type = 'purchase' RETURN b.event_type AS t, COUNT(*) AS n",
        "WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) SELECT b.event_type AS t, count(*) AS n FROM o a JOIN o b ON a.user_id = b.user_id AND b.r - a.r BETWEEN 1 AND 3 WHERE a.event_type = 'purchase' GROUP BY 1",
    ),
    "var_length_zero": (
        clicks,
        "MATCH (a:Event {event_type: 'error'})<-[:NEXT*0..2]-(b) RETURN a.event_id AS a, b.event_id AS b",
        "WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) SELECT a.event_id AS a, b.event_id AS b FROM o a JOIN o b ON a.user_id = b.user_id AND a.r - b.r BETWEEN 0 AND 2 WHERE a.event_type = 'error'",
    ),
    "named_path": (
        clicks,
        "MATCH p = (a:Event)-[:NEXT*2]->(b:Event) RETURN a.event_id AS a, length(p) AS l, [n IN nodes(p) | n.event_id][1] AS middle, size(relationships(p)) AS r",
        "WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) SELECT a.event_id AS a, CAST(2 AS BIGINT) AS l, m.event_id AS middle, CAST(2 AS BIGINT) AS r FROM o a JOIN o m ON a.user_id = m.user_id AND m.r = a.r + 1 JOIN o b ON a.user_id = b.user_id AND b.r = a.r + 2",
    ),
    "shortest_path": (
        trade,
        "MATCH (r:Region {r_name: 'ASIA'}), (s:Supplier) MATCH p = shortestPath((r)-[:IN_REGION|FROM_NATION*..2]-(s)) RETURN s.s_suppkey AS k, length(p) AS l",
        "SELECT s_suppkey AS k, CAST(2 AS BIGINT) AS l FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'",
    ),
    "all_shortest_paths": (
        trade,
        "MATCH (a:Supplier {s_suppkey: 1}), (p:Part) WHERE p.p_size = 1 MATCH q = allShortestPaths((a)-[:SUPPLIES*..1]->(p)) RETURN p.p_partkey AS k, length(q) AS l",
        "SELECT DISTINCT p_partkey AS k, CAST(1 AS BIGINT) AS l FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey = 1 AND p_size = 1",
    ),
    "json_graph": (
        social,
        "MATCH (a:Person)-[r:KNOWS]->(b) WHERE r.role = 'owner' RETURN a.city AS city, COUNT(*) AS n",
        """WITH n AS (SELECT DISTINCT id, list_transform(labels, lambda x: lower(x)) AS l, CASE WHEN json_valid(properties) THEN properties ->> '$.city' END AS city FROM nodes WHERE id IS NOT NULL),
        r AS (SELECT DISTINCT id, source_node_id AS s, target_node_id AS t FROM relationships WHERE id IS NOT NULL AND source_node_id IS NOT NULL AND target_node_id IS NOT NULL AND lower(type) = 'knows' AND json_valid(properties) AND properties ->> '$.role' = 'owner')
        SELECT a.city, count(*) AS n FROM r JOIN n a ON a.id = r.s JOIN n b ON b.id = r.t WHERE list_contains(a.l, 'person') GROUP BY a.city""",
    ),
}


def _nodes(spark: SparkSession, d: str, *args: object, **how: object) -> DataFrame:
    return trade(spark, d).match_nodes(*args, **how)  # type: ignore[arg-type]


def filters_and(spark: SparkSession, d: str) -> DataFrame:
    f = {"p_size": PropertyFilter.between(5, 20), "p_brand": PropertyFilter.ne("Brand#11"), "p_name": PropertyFilter.contains("RED", case_sensitive=False)}
    return _nodes(spark, d, ["Part"], f).select(ref("p_p_partkey").alias("k"))


def filters_or(spark: SparkSession, d: str) -> DataFrame:
    f = PropertyFilterGroup.or_({"p_size": PropertyFilter.gt(45)}, PropertyFilterGroup.and_({"p_name": PropertyFilter.starts_with("b")}, {"p_type": PropertyFilter.regex("^S")}), {"p_size": PropertyFilterGroup.or_(PropertyFilter.lte(2), 7)})
    return _nodes(spark, d, ["Part"], f).select(ref("p_p_partkey").alias("k"))


def filters_page(spark: SparkSession, d: str) -> DataFrame:
    page = _nodes(spark, d, LabelFilter.any("Part", "Supplier"), {"p_partkey": PropertyFilter.gte(0)}, [SortOrder.desc("p_size"), SortOrder.asc("p_partkey")], limit=25, offset=10)
    return page.select(ref("p_p_partkey").alias("k"), ref("p_p_size").alias("size"))


def match_relationships(spark: SparkSession, d: str) -> DataFrame:
    df = trade(spark, d).match_relationships(kind="HOLDS", properties={"l_returnflag": "R", "l_quantity": PropertyFilter.gt(48)})
    return df.groupBy(ref("p_l_linestatus").alias("status")).agg(F.count("*").alias("n"))


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    g = trade(spark, d)
    return g.get_neighbors(g.global_id("Nation", 3), "in", "FROM_NATION").select(F.element_at("labels", 1).alias("label"), F.coalesce("p_c_custkey", "p_s_suppkey").alias("k"))


def counts(spark: SparkSession, d: str) -> DataFrame:
    g = trade(spark, d)
    n = g.nodes_frame().select(F.explode("labels").alias("what")).groupBy("what").agg(F.count("*").alias("n"))
    return n.unionByName(g.relationships_frame().groupBy(F.col("type").alias("what")).agg(F.count("*").alias("n")))


def bfs(spark: SparkSession, d: str) -> DataFrame:
    """Least number of steps, either way, from one region over three hops."""
    g = trade(spark, d)
    found = traversal.reachable(g, g.global_id("Region", 2), 2, "in")
    return found.select((F.col("node_id") % F.lit(1 << 40)).alias("k"), (F.col("node_id") / F.lit(1 << 40)).cast("int").alias("label"), "depth")


def find_all_paths(spark: SparkSession, d: str) -> DataFrame:
    g = trade(spark, d)
    parts = [traversal.find_all_paths(g, g.global_id("Supplier", 1), g.global_id("Region", k), 2).select(F.lit(k).cast("bigint").alias("region"), F.size("path").alias("n")) for k in (0, 1)]
    return parts[0].unionByName(parts[1])


def text_search(spark: SparkSession, d: str) -> DataFrame:
    """The documents with both words, best first by BM25."""
    return search.bm25(spread(read(spark, d, "documents").select("doc_id", "text")), ["doc_id"], "text", "harbour auditor", 20).select("doc_id", F.round("score", 6).alias("score"))


def text_search_terms(spark: SparkSession, d: str) -> DataFrame:
    """OR, a banned word, a prefix: which parts satisfy the query."""
    parts = read(spark, d, "part")
    return search.bm25(parts, ["p_partkey"], "p_name", "gi* OR red -bolt").select("p_partkey")


def knn(metric: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        vectors = read(spark, d, "embeddings")
        query = vectors.where("vec_id = 7").first().embedding  # type: ignore[union-attr]
        return search.nearest(vectors, "vec_id", "embedding", query, 10, metric).select("vec_id", F.round("score", 5).alias("score"))

    return run


def knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    g = Graph(spark)
    vectors = read(spark, d, "embeddings")
    g.register_nodes("Vec", vectors, "vec_id", ["vec_id", "label"])
    g.create_vector_index("v", 64)
    g.upsert_embeddings("v", vectors.select((F.col("vec_id") + g.global_id("Vec", 0)).alias("node_id"), F.col("embedding").alias("vector")))
    query = list(vectors.where("vec_id = 7").first().embedding)  # type: ignore[union-attr]
    found = g.semantic_search(query, 5, "v", LabelFilter.any("Vec"), {"label": PropertyFilter.gte(3)})
    return found.select((F.col("node_id") - g.global_id("Vec", 0)).alias("vec_id"), F.round("score", 5).alias("score"))


def rdf(spark: SparkSession, d: str) -> DataFrame:
    g = Graph(spark)
    g.register_nodes("Region", read(spark, d, "region"), "r_regionkey").register_nodes("Nation", read(spark, d, "nation"), "n_nationkey", ["n_name"])
    g.register_relationships("IN_REGION", read(spark, d, "nation").select("n_nationkey", "n_regionkey"), ("Nation", "n_nationkey"), ("Region", "n_regionkey"))
    return export.triples(g, "http://x/").groupBy("predicate").agg(F.count("*").alias("n"))


def writes(spark: SparkSession, d: str) -> DataFrame:
    """CREATE, MERGE, SET, REMOVE and DELETE over the nations; what is left."""
    g = trade(spark, d)
    g.execute("MATCH (n:Nation) MERGE (h:Hub {region: n.n_regionkey}) ON CREATE SET h.fresh = true")
    g.execute("MATCH (n:Nation), (h:Hub) WHERE h.region = n.n_regionkey CREATE (n)-[:SERVED_BY {since: 2000 + n.n_nationkey}]->(h)")
    g.execute("MATCH (h:Hub) WHERE h.region > 2 SET h.big = 'yes', h.fresh = false")
    g.execute("MATCH (h:Hub {region: 4}) DELETE h")
    g.execute("MATCH (h:Hub {region: 3}) REMOVE h.big")
    return g.execute("MATCH (n:Nation)-[s:SERVED_BY]->(h:Hub) RETURN h.region AS region, h.fresh AS fresh, h.big AS big, COUNT(*) AS n, MAX(s.since) AS last")


def tumbling(spark: SparkSession, d: str) -> DataFrame:
    out = windows.tumbling(read(spark, d, "events"), "ts", "1 day", ["event_type"], "value")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(spark: SparkSession, d: str) -> DataFrame:
    out = windows.sessions(read(spark, d, "events"), "ts", "6 hours", ["user_id"])
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


FUNCTIONS: dict[str, tuple[Query, str | None]] = {
    "filters_and": (filters_and, "SELECT p_partkey AS k FROM part WHERE p_size BETWEEN 5 AND 20 AND p_brand IS DISTINCT FROM 'Brand#11' AND contains(lower(p_name), 'red')"),
    "filters_or": (filters_or, "SELECT p_partkey AS k FROM part WHERE p_size > 45 OR (starts_with(p_name, 'b') AND regexp_matches(p_type, '^S')) OR p_size <= 2 OR p_size = 7"),
    "filters_page": (filters_page, "SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS size FROM part ORDER BY p_size DESC, p_partkey LIMIT 25 OFFSET 10"),
    "match_relationships": (match_relationships, "SELECT l_linestatus AS status, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 48 GROUP BY 1"),
    "neighbours": (neighbours, "SELECT 'Customer' AS label, c_custkey AS k FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'Supplier', s_suppkey FROM supplier WHERE s_nationkey = 3"),
    "counts": (
        counts,
        "SELECT 'Region' AS what, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'IN_REGION', count(*) FROM nation UNION ALL SELECT 'FROM_NATION', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) UNION ALL SELECT 'PLACED', count(*) FROM orders UNION ALL SELECT 'HOLDS', count(*) FROM lineitem UNION ALL SELECT 'SUPPLIES', count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)",
    ),
    "bfs": (
        bfs,
        "SELECT CAST(2 AS BIGINT) AS k, CAST(1 AS INT) AS label, CAST(0 AS INT) AS depth UNION ALL SELECT n_nationkey, 2, 1 FROM nation WHERE n_regionkey = 2 UNION ALL SELECT c_custkey, 3, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 UNION ALL SELECT s_suppkey, 4, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2",
    ),
    "find_all_paths": (
        find_all_paths,
        "SELECT CAST(n_regionkey AS BIGINT) AS region, CAST(3 AS INT) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 1 AND n_regionkey IN (0, 1)",
    ),
    "text_search": (text_search, None),
    "text_search_terms": (
        text_search_terms,
        "SELECT p_partkey FROM (SELECT p_partkey, list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM part) WHERE (len(list_filter(w, lambda x: starts_with(x, 'gi'))) > 0 OR list_contains(w, 'red')) AND NOT list_contains(w, 'bolt')",
    ),
    "knn_cosine": (
        knn("cosine"),
        "SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7)), 5) AS score FROM embeddings ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7)) DESC, vec_id LIMIT 10",
    ),
    "knn_l2": (
        knn("l2"),
        "SELECT vec_id, round(0 - list_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7)), 5) AS score FROM embeddings ORDER BY list_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7)), vec_id LIMIT 10",
    ),
    "knn_ip": (
        knn("ip"),
        "SELECT vec_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7)), 5) AS score FROM embeddings ORDER BY list_inner_product(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7)) DESC, vec_id LIMIT 10",
    ),
    "knn_filtered": (
        knn_filtered,
        "SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7)), 5) AS score FROM embeddings WHERE label >= 3 ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7)) DESC, vec_id LIMIT 5",
    ),
    "rdf_triples": (
        rdf,
        "SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS predicate, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) AS n UNION ALL SELECT 'http://x/IN_REGION', count(*) FROM nation UNION ALL SELECT 'http://x/r_regionkey', count(*) FROM region UNION ALL SELECT 'http://x/r_name', count(*) FROM region UNION ALL SELECT 'http://x/n_name', count(*) FROM nation",
    ),
    "writes": (
        writes,
        "SELECT CAST(n_regionkey AS BIGINT) AS region, n_regionkey <= 2 AS fresh, CAST(NULL AS VARCHAR) AS big, count(*) AS n, CAST(2000 + max(n_nationkey) AS BIGINT) AS last FROM nation WHERE n_regionkey < 4 GROUP BY n_regionkey",
    ),
    "tumbling_window": (tumbling, "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"),
    "session_window": (
        sessions,
        "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events), h AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM h GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY 1",
    ),
}

QUERIES: dict[str, Query] = {n: cypher(g, q) for n, (g, q, _) in CYPHER.items()} | {n: f for n, (f, _) in FUNCTIONS.items()}
SQL: dict[str, str] = {n: s for n, (_, _, s) in CYPHER.items()} | {n: s for n, (_, s) in FUNCTIONS.items() if s}
