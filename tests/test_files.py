"""Loaders, exports and event windows."""

import gzip
import json
import tarfile

import pytest

from trellis.exceptions import CypherExecutionError, NodeNotFoundError
from trellis.graph import Graph
from trellis.sources import export
from trellis.streaming import windows


def rows(g, q):
    return [tuple(r.values()) for r in g.rows(q)]


def test_loaders(spark, tmp_path):
    g = Graph(spark)
    (tmp_path / "a.csv").write_text('name,age\nZed,9\n"Yo, ""y""",\n')
    (tmp_path / "a.json").write_text('﻿[{"name":"q","n":[1,2,]},{"name":"w","n":[3]},null]')
    (tmp_path / "o.json").write_text('{"name":"one"}')
    (tmp_path / "a.html").write_text('<table class="t x"><tr><td>a<br></td><td> b </td></tr><tr><td>c</td><td>d</td></tr></table>')
    (tmp_path / "a.xml").write_text('<root><beer id="1"><name>A</name></beer><beer><name>B</name></beer></root>')
    (tmp_path / "a.json.gz").write_bytes(gzip.compress(b'[{"name":"z"}]'))
    with tarfile.open(tmp_path / "t.tgz", "w:gz") as t:
        t.add(tmp_path / "o.json", "in/o.json")
    at = str(tmp_path)
    assert rows(g, f"LOAD CSV WITH HEADERS FROM '{at}/a.csv' AS r RETURN r.name, toInteger(r.age), r.none") == [("Zed", 9, None), ('Yo, "y"', None, None)]
    assert rows(g, f"LOAD CSV FROM 'file://{at}/a.csv' AS r RETURN r[0]") == [("name",), ("Zed",), ('Yo, "y"',)]
    assert rows(g, f"CALL apoc.load.json('{at}/a.json') YIELD value RETURN value.name, size(value.n)") == [("q", 2), ("w", 1)]
    assert rows(g, f"CALL apoc.load.json('{at}/a.json.gz') YIELD value RETURN value.name") == [("z",)] and rows(g, f"CALL apoc.load.json('{at}/t.tgz!in/o.json') YIELD value RETURN value.name") == [("one",)]
    assert rows(g, f"CALL apoc.load.html('{at}/a.html', {{c: 'table.t tr td:eq(1)'}}) YIELD value RETURN [x IN value.c | x.text]") == [(["b", "d"],)]
    assert rows(g, f"CALL apoc.load.xml('{at}/a.xml', '/root/beer') YIELD value RETURN value.name._text, value._attributes.id") == [("A", "1"), ("B", None)]
    for bad in (f"CALL apoc.load.jsonArray('{at}/o.json') YIELD value RETURN value", f"CALL apoc.load.json('{at}/none.json.gz') YIELD value RETURN value", "CALL no.such() YIELD x RETURN x"):
        with pytest.raises(CypherExecutionError):
            g.rows(bad)


def test_loaders_with_places_from_rows(spark, tmp_path):
    g = Graph(spark)
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text(f'name,n\n"x, {k}",{k}\nshort\n')
        (tmp_path / f"{k}.json").write_text(f'[{{"k":{k}}},null,]')
        (tmp_path / f"{k}.html").write_text(f"<p class='a'>{k}</p>")
        (tmp_path / f"{k}.xml").write_text(f"<r><b>{k}</b></r>")
    at = str(tmp_path)
    each = lambda what, rest: sorted(rows(g, f"UNWIND [0, 1, 1, 2] AS k WITH k, '{at}/' + toString(k) + '.{what}' AS u {rest}"), key=str)
    assert each("csv", "LOAD CSV WITH HEADERS FROM u AS r RETURN k, r.name, r.n") == sorted([(k, *r) for k in (0, 1, 1, 2) for r in ((f"x, {k}", str(k)), ("short", None))], key=str)
    assert each("csv", "LOAD CSV FROM u AS r RETURN k, size(r)") == sorted([(k, n) for k in (0, 1, 1, 2) for n in (2, 2, 1)], key=str)
    assert each("json", "CALL apoc.load.json(u) YIELD value RETURN k, toInteger(value.k)") == [(k, k) for k in (0, 1, 1, 2)]
    assert each("html", "CALL apoc.load.html(u, {t: 'p.a'}) YIELD value UNWIND value.t AS x RETURN k, toString(x.text)") == [(k, str(k)) for k in (0, 1, 1, 2)]
    assert each("xml", "CALL apoc.load.xml(u, '/r/b') YIELD value RETURN k, toString(value._text)") == [(k, str(k)) for k in (0, 1, 1, 2)]
    assert rows(g, "UNWIND [] AS u CALL apoc.load.json(u) YIELD value RETURN value") == [] and rows(g, f"UNWIND [null, '{at}/1.csv'] AS u LOAD CSV FROM u AS r RETURN COUNT(*)") == [(3,)]
    with pytest.raises(CypherExecutionError):
        g.rows("UNWIND ['a'] AS u CALL db.text.search(u) YIELD node RETURN node")


def test_import_json(spark, tmp_path):
    g = Graph(spark)
    lines = [{"type": "node", "id": "1", "labels": ["P"], "properties": {"name": "i"}}, {"type": "node", "id": "2", "labels": ["P"], "properties": {"name": "j"}}, {"type": "relationship", "start": {"id": "1"}, "end": "2", "label": "L", "properties": {"w": 1}}]
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, lines)))
    assert rows(g, f"CALL apoc.import.json('{tmp_path}/p.jsonl') YIELD nodes, relationships RETURN nodes, relationships") == [(2, 1)]
    assert rows(g, "MATCH (a:P)-[r:L]->(b) RETURN a.name, b.name, r.w") == [("i", "j", 1)]
    (tmp_path / "b.jsonl").write_text(json.dumps(lines[0]) + "\n" + json.dumps(lines[2]))
    with pytest.raises(NodeNotFoundError):
        g.rows(f"CALL apoc.import.json('{tmp_path}/b.jsonl') YIELD nodes RETURN nodes")


def test_exports_round_trip(spark, tmp_path):
    g = Graph(spark)
    a, b = g.create_nodes([(["A", "Odd Name"], {"name": "it's \\ \"q\"\n", "x": 1, "l": [1, 2]}, None), ([], {"y": 2.5, "t": True}, "urn:b")])
    g.create_relationship(a, b, "T", {"w": 3})
    export.dump(g, str(tmp_path / "d.cypher"))
    h = Graph(spark)
    export.restore(h, str(tmp_path / "d.cypher"), clear_existing=True)
    key = lambda g: sorted((r["labels"], sorted(r["properties"].items(), key=str)) for r in export.records(g.nodes_frame()))
    assert key(h) == key(g) and rows(h, "MATCH (a)-[r:T]->(b) RETURN a.x, r.w, b.y") == [(1, 3, 2.5)]
    export.save(g, str(tmp_path / "pq"))
    assert key(export.load(Graph(spark), str(tmp_path / "pq"))) == key(g)
    lines = [r.value for r in export.ntriples(g, "http://x/").collect()]
    assert '<urn:b> <http://x/y> "2.5"^^<http://www.w3.org/2001/XMLSchema#double> .' in lines and f"<http://x/node/{a}> <http://x/T> <urn:b> ." in lines and sum("rdf-syntax-ns#subject" in x for x in lines) == 1
    data = [json.loads(r.value) for r in export.jsonld(g, "http://x/").collect()]
    own = next(x for x in data if x["@id"] == f"http://x/node/{a}" and "@type" in x)
    assert sorted(own["@type"]) == ["http://x/A", "http://x/Odd Name"] and own["http://x/name"] == [{"@value": "it's \\ \"q\"\n"}] and own["http://x/x"] == [{"@value": "1", "@type": "http://www.w3.org/2001/XMLSchema#integer"}]
    assert {"@id": f"http://x/node/{a}", "http://x/T": [{"@id": "urn:b"}]} in data and export.jsonld(Graph(spark)).count() == 0
    assert sum("/l> " in x for x in lines) == 2 and "n1 -->|T| n2" in export.diagram(g, "mermaid") and json.loads(export.diagram(g, "d3"))["links"][0]["type"] == "T"
    assert export.vector_literal([1.0, 0.25]) == "[1, 0.25]"


def test_windows_on_a_stream(spark, tmp_path):
    events = spark.createDataFrame([(k, k % 2, 1.0) for k in range(20)], "k bigint, u bigint, v double").selectExpr("timestampadd(MINUTE, k * 10, timestamp'2024-01-01 00:00:00') AS ts", "u", "v")
    events.unionByName(events.selectExpr("timestampadd(HOUR, 240, ts) AS ts", "u", "v")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out = windows.tumbling(stream, "ts", "1 hour", ["u"], "v")
    q = out.writeStream.format("memory").queryName("win").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("win").where("window_start < '2024-01-05'").groupBy().sum("n").first()[0]
    assert got == 20
    batch = windows.sessions(events, "ts", "15 minutes", ["u"]).groupBy("u").count().collect()
    assert {r.u: r["count"] for r in batch} == {0: 10, 1: 10} and windows.first_of(events, "ts", ["u"]).count() == 2
