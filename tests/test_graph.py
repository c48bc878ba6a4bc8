"""The query language and the programmatic interface on small graphs with written answers."""

import pytest

from trellis.exceptions import ConstraintError, CypherExecutionError, InvalidFilterError, InvalidLabelError, InvalidPropertyError, NodeNotFoundError, TrellisError
from trellis.functions.embedding import HashingEmbedder
from trellis.functions.filters import LabelFilter, PropertyFilter, PropertyFilterGroup, SortOrder
from trellis.graph import Graph


def people(spark):
    g = Graph(spark)
    ids = g.create_nodes(
        [
            (["Person"], {"name": "Ann", "age": 30, "city": "X", "tags": ["a", "b"], "odd": 1}, None),
            (["Person", "Employee"], {"name": "Bob", "age": 41, "odd": "one"}, "urn:bob"),
            (["Person"], {"name": "Cid", "age": 25, "city": "Y", "odd": [1, "x"]}, None),
            (["Company"], {"name": "Acme_%"}, None),
        ]
    )
    a, b, c, d = ids
    g.create_relationships([(a, b, "KNOWS", {"since": 2010}, None), (b, c, "KNOWS", {"since": 2015}, None), (c, a, "KNOWS", {"since": 2020}, None), (a, d, "WORKS_AT", {"role": "dev"}, None), (b, d, "WORKS_AT", {"role": "boss"}, None)])
    return g


@pytest.fixture(scope="module")
def g(spark):
    return people(spark)


def rows(g, q, **params):
    return [tuple(r.values()) for r in g.rows(q, params)]


READS = {
    "MATCH (n:person) WHERE n.age > 26 RETURN n.name, n.age + 1 ORDER BY n.name": [("Ann", 31), ("Bob", 42)],
    "MATCH (a)-[:WORKS_AT]->(c:Company) WITH a ORDER BY a.name DESC RETURN COUNT(*) AS n, COLLECT(a.name) AS l, AVG(a.age) AS m": [(2, ["Bob", "Ann"], 35.5)],
    "MATCH (a:Person) OPTIONAL MATCH (a)-[:WORKS_AT]->(c) RETURN a.name, c.name ORDER BY a.name": [("Ann", "Acme_%"), ("Bob", "Acme_%"), ("Cid", None)],
    "MATCH (a:Person) OPTIONAL MATCH (a)-[:WORKS_AT]->(c) WITH a, c WHERE c.name IS NULL RETURN a.name": [("Cid",)],
    "MATCH p = (a {name: 'Ann'})-[:KNOWS*1..3]->(b) RETURN length(p) AS l, [n IN nodes(p) | n.name] AS s ORDER BY l": [(1, ["Ann", "Bob"]), (2, ["Ann", "Bob", "Cid"])],
    "MATCH p = shortestPath((a {name: 'Ann'})-[:KNOWS*]->(b {name: 'Cid'})) RETURN length(p), [r IN relationships(p) | r.since]": [(2, [2010, 2015])],
    "MATCH (a:Person) WHERE NOT (a)-[:WORKS_AT]->(:Company) OR a.age > 40 RETURN a.name ORDER BY a.name": [("Bob",), ("Cid",)],
    "MATCH (a:Person) RETURN a.name AS n, [(a)-[:KNOWS]->(x) WHERE x.age > 26 | x.name] AS k ORDER BY n": [("Ann", ["Bob"]), ("Bob", []), ("Cid", ["Ann"])],
    "MATCH (a:Person) CALL { WITH a MATCH (a)-[:KNOWS]->(b) RETURN COUNT(*) AS n } RETURN a.name, n ORDER BY a.name": [("Ann", 1), ("Bob", 1), ("Cid", 1)],
    "MATCH (a)-[r]-(b) RETURN COUNT(*)": [(10,)],
    "MATCH (a:Person)-[:KNOWS]->(b), (b)-[:KNOWS]->(c), (c)-[:KNOWS]->(a) RETURN COUNT(*)": [(3,)],
    "MATCH (n:Person) WHERE n.odd = 1 RETURN n.name": [("Ann",)],
    "MATCH (n:Person) WHERE n.odd > 0 RETURN n.name": [("Ann",)],
    "MATCH (n:Person) WHERE n.odd = 'one' RETURN n.name": [("Bob",)],
    "MATCH (n:Person) WHERE 'b' IN n.tags RETURN n.name": [("Ann",)],
    "MATCH (n:Person {name: $who}) RETURN n:Employee, labels(n), keys(n)": [(True, ["Employee", "Person"], ["name", "age", "odd"])],
    "UNWIND [3, 1, null, 2] AS x WITH x ORDER BY x DESC RETURN COLLECT(x) AS l": [([3, 2, 1, None],)],
    "UNWIND [] AS x RETURN COUNT(x), SUM(x)": [(0, None)],
    "MATCH (a:Person) RETURN a.name AS x UNION MATCH (b:Person) RETURN b.name AS x ORDER BY x": [("Ann",), ("Bob",), ("Cid",)],
    "MATCH (n:Person) RETURN n.city AS c, COUNT(*) AS n ORDER BY c": [("X", 1), ("Y", 1), (None, 1)],
    "MATCH (n:Nobody) RETURN COUNT(*), MAX(n.x)": [(0, None)],
    "MATCH (a:Person), (b:Person) WHERE a.age < b.age RETURN COUNT(*)": [(3,)],
    "MATCH (a:Person) WITH COLLECT(a) AS l UNWIND l AS p RETURN p.name ORDER BY p.name SKIP 1 LIMIT 1": [("Bob",)],
}


@pytest.mark.parametrize("query", READS)
def test_reads(g, query):
    assert rows(g, query, who="Bob") == READS[query]


VALUES = {
    "2 = [1, 2]": True, "2 <> [1, 2]": False, "1 = 'a'": False, "1 < 'a'": None, "null = 1": None, "1 IN [2, null]": None, "1 IN [1, null]": True, "'b' IN 'abc'": True, "'a' IN {a: 1}": True,
    "any(x IN [1, null] WHERE x > 5)": None, "all(x IN [] WHERE x)": True, "none(x IN [1] WHERE x > 1)": True, "single(x IN [1, 2] WHERE x = 1)": True,
    "[x IN [1, 2, 3] WHERE x > 1 | x * x]": [4, 9], "reduce(s = 0, x IN [1, 2] | s + x)": 3, "[1, 2, 3][-1]": 3, "[1, 2][7]": None, "[1, 2, 3][1..]": [2, 3], "[1, 2, 3][..-1]": [1, 2], "[1] + 2 + [3]": [1, 2, 3],
    "'a' + 'b'": "ab", "7 / 2": 3, "-7 / 2": -3, "7.0 / 2": 3.5, "7 % 4": 3, "2 ^ 3": 8.0, "1 / 0": None, "null + 1": None, "{a: {b: 5}}.a.b": 5, "{a: 1}['a']": 1, "{a: 1} = {a: 1}": True,
    "toInteger('3.14')": 3, "toInteger('x')": None, "toInteger(true)": 1, "toFloat('1e2')": 100.0, "toString(1)": "1", "substring('hello', 1, 3)": "ell", "split('a.b', '.')": ["a", "b"], "trim('\\u00a0 x ')": "x",
    "reverse('abc')": ["c", "b", "a"], "reverse([1, 2])": [2, 1], "head([])": None, "tail(null)": [], "last([1, 2])": 2, "range(3, 1)": [], "range(1, 5, 2)": [1, 3, 5], "range(3, 1, -1)": [3, 2, 1], "size('abc')": 3, "size({a: 1})": 1,
    "deaccent('é')": "e", "snake_case('HelloWorld Foo-Bar')": "hello_world_foo_bar", "strip_emoji('a\\ud83d\\ude00b')": None, "levenshtein('kitten', 'sitting')": 3, "jaccard('a b', 'b c')": 1 / 3, "jaccard('', ' ')": 1.0,
    "matches('hello', 'l+')": True, "'hello' =~ 'l+'": False, "coalesce(null, 2)": 2, "CASE 2 WHEN [1, 2] THEN 'in' ELSE 'out' END": "in",
    "toString(date('2024-02-28') + duration('P2D'))": "2024-03-01", "date.truncate('week', date('2024-02-29')).day": 26, "datetime('2024-01-01T10:00:00Z').year": 2024, "duration.between(date('2024-01-01'), date('2024-01-03')).days": 2,
    "date('2024-01-02') > date('2024-01-01')": True, "date('2024-01-02') > '2024'": None, "time.truncate('hour', time('10:20:30'))": "10:00:00", "time('23:00:00') + duration('PT2H')": "01:00:00",
    "round(distance(point({x: 0, y: 0}), point({x: 3, y: 4})), 3)": 5.0, "apoc.text.join(['a', null], '-')": None, "apoc.text.replace('a1', '([0-9])', '<\\\\1>')": "a<1>", "apoc.map.merge({a: 1}, {a: 2, b: 3}).a": 2, "apoc.map.get({a: 1}, 'z', 9)": 9,
    "size(keys(apoc.map.removeKey({a: 1, b: 2}, 'a')))": 1, "apoc.map.fromPairs([['a', 1], ['b', 2]])['b']": 2, "apoc.map.clean({a: 1, b: 2, c: null}, ['a'], [3])['b']": 2, "apoc.coll.contains([1, null], 2)": None, "apoc.coll.toSet([1, 1, 2])": [1, 2],
    "size(apoc.text.split('a1b22c', '[0-9]+'))": 3, "1 < 2 < 3": True, "true XOR null": None, "NOT null": None, "null AND false": False, "null OR true": True, "filter(x IN [1, 2] WHERE x > 1)": [2], "extract(x IN [1, 2] | x + 1)": [2, 3],
}
VALUES.pop("strip_emoji('a\\ud83d\\ude00b')")


def test_values(g):
    items = list(VALUES.items())
    for k in range(0, len(items), 12):
        part = items[k : k + 12]
        got = g.rows("RETURN " + ", ".join(f"{e} AS c{i}" for i, (e, _) in enumerate(part)))[0]
        for i, (e, want) in enumerate(part):
            assert got[f"c{i}"] == (pytest.approx(want) if isinstance(want, float) else want), e


@pytest.mark.parametrize("bad", ["toUpper(1)", "substring('a', -1)", "matches('a', '[')", "keys(1)", "range(1, 2, 0)", "percentileCont(1)", "nope(1)", "split('a', '')", "missing", "date.truncate('age', date())", "point({x: 1})", "'a' - 1", "$none", "duration('1 day')"])
def test_errors_at_planning(g, bad):
    with pytest.raises(CypherExecutionError):
        g.execute(f"RETURN {bad}")


def test_writes(spark):
    g = people(spark)
    assert rows(g, "CREATE (x:City {name: 'Rome', pop: 3})-[:IN {w: 1.5}]->(y:Country {name: 'Italy'}) RETURN x.name, y.name") == [("Rome", "Italy")]
    assert rows(g, "MATCH (x:City)-[r:IN]->(y) RETURN r.w, y.name") == [(1.5, "Italy")]
    assert rows(g, "MERGE (x:City {name: 'Rome'}) ON MATCH SET x.seen = true ON CREATE SET x.new = 1 RETURN x.seen, x.pop") == [(True, 3)]
    assert sorted(rows(g, "MATCH (a:Person) WHERE a.city IS NOT NULL MERGE (t:Town {name: a.city}) ON CREATE SET t.by = a.name RETURN t.name, t.by")) == [("X", "Ann"), ("Y", "Cid")]
    assert rows(g, "MATCH (n {name: 'Bob'}) SET n.city = 'Z', n += {age: 42}, n:Boss RETURN n.city, n.age, labels(n)") == [("Z", 42, ["Boss", "Employee", "Person"])]
    assert rows(g, "MATCH (n:Boss) REMOVE n.city, n:Boss RETURN n.city, labels(n)") == [(None, ["Employee", "Person"])]
    g.execute("FOREACH (x IN [1, 2] | CREATE (:Num {v: x}))")
    assert rows(g, "MATCH (n:Num) RETURN SUM(n.v)") == [(3,)]
    assert rows(g, "MATCH (n:Num) DELETE n") == [(2, 0)] and rows(g, "MATCH (n:Num) RETURN COUNT(n)") == [(0,)]
    assert rows(g, "MATCH (n {name: 'Ann'}) DETACH DELETE n") == [(1, 0)] and rows(g, "MATCH ()-[r:KNOWS]->() RETURN COUNT(r)") == [(1,)]
    before = g.state
    with pytest.raises(ZeroDivisionError), g:
        g.create_node(["Tmp"], {})
        raise ZeroDivisionError
    assert g.state is before


def test_constraints_and_indexes(spark):
    g = people(spark)
    g.execute("CREATE CONSTRAINT ON (n:Person) ASSERT n.name IS UNIQUE")
    with pytest.raises(ConstraintError):
        g.execute("CREATE (n:Person {name: 'Ann'})")
    with pytest.raises(ConstraintError):
        g.execute("CREATE CONSTRAINT ON (n:Person) ASSERT n.city IS NOT NULL")
    g.execute("CREATE CONSTRAINT ON (n:Person) ASSERT n.age IS INTEGER")
    assert rows(g, "SHOW CONSTRAINTS WHERE kind = 'unique'")[0][0] == "constraint_node_person_name_unique" and g.drop_constraint("constraint_node_person_name_unique")
    g.execute("CREATE INDEX ON :Person(name)")
    assert [i.name for i in g.list_indexes()] == ["idx_node_person_name"] and rows(g, "DROP INDEX none IF EXISTS") == [("none", False)]


def test_programmatic_reading(g):
    names = lambda *a, **k: [r.p_name for r in g.match_nodes(*a, **k).collect()]
    assert names(["Person"], {"age": PropertyFilter.gt(26)}, "name") == ["Ann", "Bob"] and names(["Person"], {"city": None}) == ["Bob"]
    assert names(["Person"], PropertyFilterGroup.or_({"age": 30}, {"city": PropertyFilter.regex("^Y")}), SortOrder.desc("age")) == ["Ann", "Cid"]
    assert names(None, {"name": PropertyFilter.contains("_%")}) == ["Acme_%"] and names(["Person"], {"name": PropertyFilter.starts_with("a", case_sensitive=False)}) == ["Ann"]
    assert names(LabelFilter.any("company", "employee"), order_by="name") == ["Acme_%", "Bob"] and names(["Person"], order_by="city", ascending=False) == ["Cid", "Ann", "Bob"]
    assert names(["Person"], {"age": PropertyFilter.ne(30)}, "name", offset=1) == ["Cid"] and names(["Person"], limit=0) == [] and names(None, {"name": PropertyFilter.ends_with("")}, limit=9).__len__() == 4
    assert [r.p_since for r in g.match_relationships(kind="knows", properties={"since": PropertyFilter.between(2011, 2016)}).collect()] == [2015]
    assert sorted(r.id for r in g.get_neighbors(1, "both").collect()) == [2, 3, 4] and g.get_all_labels() == ["Company", "Employee", "Person"]
    assert g.find_shortest_path(1, 3) == [1, 2, 3] and g.find_shortest_path(4, 1) is None and g.find_path(1, 1) == [1] and [r.path for r in g.find_all_paths(1, 3, 3).collect()] == [[1, 2, 3]]
    for bad in (lambda: g.match_nodes(limit=-1), lambda: g.match_nodes(None, {"a-b": 1}), lambda: PropertyFilter.regex("["), lambda: LabelFilter.any(), lambda: PropertyFilter.gt("x", "int")):
        with pytest.raises(InvalidFilterError):
            bad()
    with pytest.raises(NodeNotFoundError):
        g.get_neighbors(99)
    with pytest.raises(InvalidPropertyError):
        g.create_node([], {"x": object()})
    with pytest.raises(InvalidLabelError):
        g.create_node(["A", "a"])


def test_crud(spark):
    g = people(spark)
    n, made = g.merge_node(["Person"], {"name": "Dan"}, {"age": 1})
    assert made and g.merge_node(["Person"], {"name": "Dan"}, on_match={"age": 2}) == (n, False) and g.get_node(n)["properties"] == {"name": "Dan", "age": 2}
    g.replace_node_properties(n, {"x": 1.5})
    g.add_labels(n, ["Z"])
    g.remove_labels(n, ["person"])
    assert g.get_node(n) == {"id": n, "labels": ["Z"], "uri": None, "properties": {"x": 1.5}}
    r = g.create_relationship(n, 1, "T", {"a": [1, 2]})
    g.update_relationship_properties(r, {"b": True})
    assert g.get_relationship(r)["properties"] == {"a": [1, 2], "b": True}
    assert g.delete_relationship(r) and not g.delete_relationship(r) and g.delete_node(n) and g.get_node(n) is None
    with pytest.raises(NodeNotFoundError):
        g.create_relationship(1, 99, "T")


def test_search(spark):
    g = people(spark)
    g.create_text_index("node", "Person", ["name", "city"])
    g.create_text_index("relationship", "WORKS_AT", "role")
    assert [r.entity_id for r in g.text_search("ANN").collect()] == [1] and len(g.text_search("boss OR dev", rel_types=["WORKS_AT"]).collect()) == 2 and g.text_search("boss", labels=["Person"]).count() == 0
    g.create_vector_index("v", 2)
    g.upsert_embeddings("v", [(1, [1, 0]), (2, [0, 1]), (3, [1, 1]), (77, [1, 0])])
    assert [r.node_id for r in g.semantic_search([1, 0.1], 2, "v").collect()] == [1, 3]
    assert rows(g, "CALL db.vector.search('v', [1.0, 0.1], 2, {labels: ['Employee']}) YIELD node, score MATCH (node)-[:KNOWS]->(m) RETURN node.name, m.name") == [("Bob", "Cid")]
    with pytest.raises(TrellisError):
        g.semantic_search([1, 0.1], 2, "v", probes=1)
    g.build_vector_index("v", lists=2)
    near = [r.node_id for r in g.semantic_search([1, 0.1], 2, "v", probes=1).collect()]
    assert near[0] == 1 and [r.node_id for r in g.semantic_search([1, 0.1], 2, "v", probes=2).collect()] == [1, 3]
    g.register_reranker("last", lambda q, c: [(x["id"], -x["score"]) for x in c])
    assert [r.node_id for r in g.semantic_search([1, 0.1], 1, "v", reranker="last", candidate_multiplier=3).collect()] == [2]
    g.register_text_index("notes").add([(1, "the spare pump and the pump house"), (2, "the ferry"), (3, None)])
    assert [r.doc_id for r in g.text_search_custom("the pump", index="notes").collect()] == [1]
    g.text_indexes["notes"].remove([1])
    assert g.text_search_custom("pump", index="notes").count() == 0
    g.create_vector_index("h", 32, embedder=HashingEmbedder(32))
    g.embed_nodes("h", ["name"], "Person")
    assert g.semantic_search("Bob", 1, "h").first().node_id == 2


def test_shortest_paths_stop_when_all_pairs_are_met(spark):
    g = Graph(spark)
    ids = g.create_nodes([(["N"], {"k": k}, None) for k in range(6)])
    g.create_relationships([(ids[a], ids[b], "T", {}, None) for a, b in ((0, 1), (1, 2), (2, 3), (0, 2), (3, 0), (4, 5))])
    text = "MATCH (a:N), (b:N) WHERE a.k IN [0, 1, 4] AND b.k IN [0, 3, 5] MATCH p = shortestPath((a)-[:T*..5]->(b)) RETURN a.k AS a, b.k AS b, length(p) AS l"
    assert sorted(rows(g, text)) == [(0, 3, 2), (1, 0, 3), (1, 3, 2), (4, 5, 1)]
    assert sorted(rows(g, text.replace("shortestPath", "allShortestPaths").replace("*..5", "*0..5"))) == [(0, 0, 0), (0, 3, 2), (1, 0, 3), (1, 3, 2), (4, 5, 1)]


def test_paths_have_no_depth_limit_of_their_own(spark):
    g = Graph(spark)
    ids = g.create_nodes([(["N"], {"k": k}, None) for k in range(8)])
    g.create_relationships([(a, b, "T", {}, None) for a, b in zip(ids, ids[1:])] + [(ids[1], ids[0], "T", {}, None), (ids[5], ids[7], "T", {}, None)])
    assert g.find_path(ids[0], ids[6]) == ids[:7] and g.find_path(ids[0], ids[6], 5) is None and g.find_path(ids[7], ids[0]) is None
    assert sorted(r.path for r in g.find_all_paths(ids[0], ids[7]).collect()) == sorted([ids, [*ids[:6], ids[7]]]) and g.find_all_paths(ids[7], ids[0]).count() == 0
    assert g.find_all_paths(ids[0], ids[7], 5).count() == 0
