"""Queries of the loaders, exports, catalogue, search and programmatic interface over the driver's tables, with their SQL."""

from __future__ import annotations

import gzip
import io
import json
import tarfile
import uuid
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.exceptions import ConstraintError, CypherExecutionError, InvalidFilterError, InvalidLabelError, InvalidPropertyError, NodeNotFoundError, RelationshipNotFoundError
from trellis.functions.embedding import HashingEmbedder
from trellis.functions.filters import LabelFilter, PropertyFilter, SortOrder
from trellis.graph import Graph
from trellis.operators import search
from trellis.plans.graph_queries import trade
from trellis.plans.problems import Query
from trellis.sources import export
from trellis.tables import read, shared_folder, spread


def place(spark: SparkSession, name: str, data: bytes) -> str:
    """Writes a file for the loaders into the shared folder."""
    folder = shared_folder(spark)
    path = f"{folder.removeprefix('file://')}/files-{uuid.uuid4().hex[:12]}-{name}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path if folder.startswith("file://") else f"{folder}/{path.rsplit('/', 1)[1]}")  # type: ignore[union-attr]
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(hadoop, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
        fs.deleteOnExit(hadoop)
    return path


def regions(spark: SparkSession, d: str) -> list[dict[str, Any]]:
    """The five regions and their nations: fixed dimension tables."""
    nations: dict[int, list[str]] = {}
    for n in read(spark, d, "nation").orderBy("n_nationkey").collect():
        nations.setdefault(n.n_regionkey, []).append(n.n_name)
    return [{"key": r.r_regionkey, "name": r.r_name, "nations": nations.get(r.r_regionkey, [])} for r in read(spark, d, "region").orderBy("r_regionkey").collect()]


def nation_lines(spark: SparkSession, d: str) -> list[str]:
    return [f'{n.n_nationkey},"{n.n_name}",{n.n_regionkey}' for n in read(spark, d, "nation").orderBy("n_nationkey").collect()]


def loaded(make: Callable[[SparkSession, str], tuple[str, bytes]], query: str) -> Query:
    """A query over a file made from the tables; $PLACE is where it lies."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        name, data = make(spark, d)
        return Graph(spark).execute(query.replace("$PLACE", place(spark, name, data)))

    return run


def as_csv(headers: bool) -> Callable[[SparkSession, str], tuple[str, bytes]]:
    return lambda spark, d: ("nation.csv", "\n".join((["key,name,region"] if headers else []) + nation_lines(spark, d)).encode())


def as_json(spark: SparkSession, d: str) -> tuple[str, bytes]:
    return "regions.json", json.dumps(regions(spark, d)).encode()


def as_gzip(spark: SparkSession, d: str) -> tuple[str, bytes]:
    return "regions.json.gz", gzip.compress(as_json(spark, d)[1])


def as_tar(spark: SparkSession, d: str) -> tuple[str, bytes]:
    data, out = as_json(spark, d)[1], io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        entry = tarfile.TarInfo("in/regions.json")
        entry.size = len(data)
        t.addfile(entry, io.BytesIO(data))
    return "regions.tgz", out.getvalue()


def as_html(spark: SparkSession, d: str) -> tuple[str, bytes]:
    rows = "".join(f"<tr><td>{r['key']}</td><td><b>{r['name']}</b></td></tr>" for r in regions(spark, d))
    return "regions.html", f"<html><body><table class='plain wide'><tbody>{rows}</tbody></table></body></html>".encode()


def as_xml(spark: SparkSession, d: str) -> tuple[str, bytes]:
    rows = "".join(f"<region key='{r['key']}'><name>{r['name']}</name>" + "".join(f"<nation>{n}</nation>" for n in r["nations"]) + "</region>" for r in regions(spark, d))
    return "regions.xml", f"<world>{rows}</world>".encode()


def as_graph(spark: SparkSession, d: str) -> tuple[str, bytes]:
    lines: list[dict] = [{"type": "node", "id": f"r{r.r_regionkey}", "labels": ["Region"], "properties": {"name": r.r_name}} for r in read(spark, d, "region").collect()]
    for n in read(spark, d, "nation").collect():
        lines.append({"type": "node", "id": f"n{n.n_nationkey}", "labels": ["Nation", "Place"], "properties": {"name": n.n_name}})
        lines.append({"type": "relationship", "start": {"id": f"n{n.n_nationkey}"}, "end": f"r{n.n_regionkey}", "label": "IN", "properties": {"key": n.n_nationkey}})
    return "graph.jsonl", "\n".join(map(json.dumps, lines)).encode()


def import_json(spark: SparkSession, d: str) -> DataFrame:
    g = Graph(spark)
    name, data = as_graph(spark, d)
    g.rows(f"CALL apoc.import.json('{place(spark, name, data)}') YIELD nodes, relationships RETURN nodes, relationships")
    return g.execute("MATCH (n:Place)-[r:IN]->(x:Region) RETURN x.name AS region, COUNT(*) AS n, SUM(r.key) AS s")


def csv_for_each(spark: SparkSession, d: str) -> DataFrame:
    """LOAD CSV from places that come from rows."""
    lines = nation_lines(spark, d)
    places = [place(spark, f"part{k}.csv", "\n".join(["key,name,region", *lines[k::2]]).encode()) for k in range(2)]
    return Graph(spark).execute("UNWIND $places AS u LOAD CSV WITH HEADERS FROM u AS row RETURN toInteger(row.key) AS k, row.name AS name", {"places": places})


def json_for_each(spark: SparkSession, d: str) -> DataFrame:
    """CALL apoc.load.json of places that come from rows."""
    all_of = regions(spark, d)
    places = [place(spark, f"part{k}.json", json.dumps(all_of[k::2]).encode()) for k in range(2)]
    return Graph(spark).execute("UNWIND $places AS u CALL apoc.load.json(u) YIELD value RETURN toInteger(value.key) AS k, toString(value.name) AS name, size(value.nations) AS n", {"places": places})


def script(spark: SparkSession, d: str) -> DataFrame:
    """Statements of a script, among them a quoted semicolon and a comment."""
    g = trade(spark, d)
    g.execute_script("CREATE (:Note {text: 'a;b', n: 1}); // first\nMATCH (r:Region) CREATE (:Note {text: r.r_name, n: 2});")
    return g.execute("MATCH (n:Note) RETURN n.text AS text, n.n AS n")


def lookups(spark: SparkSession, d: str) -> DataFrame:
    g = trade(spark, d)
    nodes = [g.get_node(g.global_id("Nation", k)) for k in (0, 3, 24, 999)]
    return spark.createDataFrame([(k, n["labels"][0], n["properties"]["n_name"]) if n else (k, None, None) for k, n in zip((0, 3, 24, 999), nodes)], "k bigint, label string, name string")


def restored(spark: SparkSession, d: str) -> DataFrame:
    """Regions, each linked to the next one, through a script and back."""
    g, h = Graph(spark), Graph(spark)
    ids = g.create_nodes([(["Region"], {"key": r["key"], "name": r["name"], "nations": r["nations"]}, None) for r in regions(spark, d)])
    g.create_relationships([(a, b, "NEXT", {"n": k}, None) for k, (a, b) in enumerate(zip(ids, ids[1:]))])
    export.restore(h, place(spark, "dump.cypher", "\n".join(export.script(g)).encode()).removeprefix("file://"), clear_existing=True)
    return h.execute("MATCH (a:Region)-[r:NEXT]->(b) RETURN a.name AS name, r.n AS n, b.key AS k, size(b.nations) AS nations")


def saved(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and relationships as Parquet and back."""
    folder = f"{shared_folder(spark)}/saved-{uuid.uuid4().hex[:12]}"
    export.save(trade(spark, d), folder)
    return export.load(Graph(spark), folder).execute("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.c_mktsegment AS s, COUNT(*) AS n, round(SUM(o.o_totalprice), 0) AS total")


def diagrams(spark: SparkSession, d: str) -> DataFrame:
    """What the kinds of diagram hold of regions and nations."""
    g = Graph(spark)
    g.register_nodes("Region", read(spark, d, "region"), "r_regionkey").register_nodes("Nation", read(spark, d, "nation"), "n_nationkey")
    g.register_relationships("IN_REGION", read(spark, d, "nation").select("n_nationkey", "n_regionkey"), ("Nation", "n_nationkey"), ("Region", "n_regionkey"))
    text = {kind: export.diagram(g, kind) for kind in ("mermaid", "dot", "d2", "d3", "cytoscape")}
    rows = [(k, text[k].count(mark)) for k, mark in (("mermaid", "-->|IN_REGION|"), ("dot", "->"), ("d2", "->"))]
    rows += [("d3", len(json.loads(text["d3"])["links"])), ("cytoscape", len(json.loads(text["cytoscape"])["elements"]["edges"]))]
    return spark.createDataFrame(rows, "kind string, edges bigint")


def triples(spark: SparkSession, d: str) -> DataFrame:
    g = Graph(spark)
    g.register_nodes("Region", read(spark, d, "region"), "r_regionkey").register_nodes("Nation", read(spark, d, "nation"), "n_nationkey", ["n_name"])
    g.register_relationships("IN_REGION", read(spark, d, "nation").select("n_nationkey", "n_regionkey"), ("Nation", "n_nationkey"), ("Region", "n_regionkey"))
    lines = export.triples(g, "http://x/")
    base = g.global_id("Nation", 0)
    key = (F.regexp_extract("subject", "([0-9]+)$", 1).cast("bigint") - base).alias("k")
    return lines.where("predicate = 'http://x/n_name'").select(key, F.col("object").alias("name"), "datatype")


def linked_data(spark: SparkSession, d: str) -> DataFrame:
    """JSON-LD objects of regions, nations and their links."""
    g = Graph(spark)
    g.register_nodes("Region", read(spark, d, "region"), "r_regionkey").register_nodes("Nation", read(spark, d, "nation"), "n_nationkey", ["n_name"])
    g.register_relationships("IN_REGION", read(spark, d, "nation").select("n_nationkey", "n_regionkey"), ("Nation", "n_nationkey"), ("Region", "n_regionkey"))
    lines = export.jsonld(g, "http://x/")
    return lines.select(
        F.get_json_object("value", "$['@type'][0]").alias("type"), F.get_json_object("value", "$['http://x/n_name'][0]['@value']").alias("nation"), F.get_json_object("value", "$['http://x/IN_REGION'][0]['@id']").isNotNull().alias("link")
    )


def _part_keys(df: DataFrame) -> DataFrame:
    return df.select(F.col("p_p_partkey").alias("k"))


def filter_values(spark: SparkSession, d: str) -> DataFrame:
    """Null values, expected kinds, an empty ending and option maps."""
    g = trade(spark, d)
    parts = [
        ("null", _part_keys(g.match_nodes(["Part"], {"p_size": None}))),
        ("typed", _part_keys(g.match_nodes(["Part"], {"p_size": PropertyFilter.gt(48, "int")}))),
        ("ending", _part_keys(g.match_nodes(["Part"], {"p_name": PropertyFilter.ends_with(""), "p_size": 1}))),
        ("word", _part_keys(g.match_nodes(["Part"], {"p_name": PropertyFilter.ends_with("E", case_sensitive=False), "p_size": PropertyFilter.lt(4)}))),
    ]
    out = parts[0][1].select(F.lit(parts[0][0]).alias("what"), "k")
    for name, df in parts[1:]:
        out = out.unionByName(df.select(F.lit(name).alias("what"), "k"))
    return out


def nested_filter(spark: SparkSession, d: str) -> DataFrame:
    """A path into a map property."""
    g = Graph(spark)
    g.create_nodes([(["Shop"], {"name": r["name"], "at": {"key": r["key"], "many": len(r["nations"]) > 4}}, None) for r in regions(spark, d)])
    return g.match_nodes(["Shop"], {"at.key": PropertyFilter.gte(2)}, SortOrder.desc("name")).select(F.col("p_name").alias("name"))


def foreach(spark: SparkSession, d: str) -> DataFrame:
    g = trade(spark, d)
    g.execute("MATCH (r:Region) WITH COLLECT(r.r_regionkey) AS keys FOREACH (k IN keys | CREATE (:Mark {key: k, twice: k * 2}))")
    return g.execute("MATCH (m:Mark) RETURN m.key AS k, m.twice AS t")


def catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Index and constraint statements and what SHOW tells of them."""
    g = trade(spark, d)
    for s in ("CREATE INDEX ON :Nation(n_name)", "CREATE CONSTRAINT ON (n:Nation) ASSERT n.n_name IS UNIQUE", "CREATE CONSTRAINT ON (n:Region) ASSERT n.r_name IS NOT NULL", "CREATE INDEX ON :Part(p_size)", "DROP INDEX idx_node_part_p_size"):
        g.execute(s)
    g.rows("CALL db.uri_index.create('node', false, 'uris') YIELD name RETURN name")
    indexes = g.execute("SHOW INDEXES").select("name", F.lit("index").alias("kind"))
    return indexes.unionByName(g.execute("SHOW CONSTRAINTS WHERE kind <> 'type'").select("name", "kind"))


def labels_and_types(spark: SparkSession, d: str) -> DataFrame:
    g = trade(spark, d)
    labels = g.execute("CALL db.labels() YIELD label RETURN label AS name").select(F.lit("label").alias("what"), "name")
    return labels.unionByName(g.execute("CALL db.relationshipTypes() YIELD relationshipType RETURN relationshipType AS name").select(F.lit("type").alias("what"), "name"))


def paths(spark: SparkSession, d: str) -> DataFrame:
    """find_shortest_path and find_path from a nation to its region and to one that isn't its own."""
    g = Graph(spark)
    nations = read(spark, d, "nation")
    g.register_nodes("Region", read(spark, d, "region"), "r_regionkey").register_nodes("Nation", nations, "n_nationkey")
    g.register_relationships("IN_REGION", nations.select("n_nationkey", "n_regionkey"), ("Nation", "n_nationkey"), ("Region", "n_regionkey"))
    own = nations.where("n_nationkey = 7").first().n_regionkey  # type: ignore[union-attr]
    rows = []
    for how, f, to in (("shortest", g.find_shortest_path, own), ("shortest", g.find_shortest_path, (own + 1) % 5), ("any", g.find_path, own)):
        found = f(g.global_id("Nation", 7), g.global_id("Region", to))
        rows.append((how, to, len(found) if found else None))
    return spark.createDataFrame(rows, "how string, region bigint, n int")


def _vectors(spark: SparkSession, d: str, metric: str = "cosine") -> tuple[Graph, list[float]]:
    g = Graph(spark)
    vectors = read(spark, d, "embeddings")
    g.register_nodes("Vec", vectors, "vec_id", ["vec_id", "label"])
    g.create_vector_index("v", 64, metric)
    g.upsert_embeddings("v", vectors.select((F.col("vec_id") + g.global_id("Vec", 0)).alias("node_id"), F.col("embedding").alias("vector")))
    return g, list(vectors.where("vec_id = 7").first().embedding)  # type: ignore[union-attr]


def _own_ids(g: Graph, found: DataFrame) -> DataFrame:
    return found.select((F.col("node_id") - g.global_id("Vec", 0)).alias("vec_id"), F.round("score", 4).alias("score"))


def reranked(spark: SparkSession, d: str) -> DataFrame:
    """Squared distances where results are ranked again exactly."""
    g, query = _vectors(spark, d, "l2")
    return _own_ids(g, g.semantic_search(query, 10, "v", rerank=True))


def custom_reranked(spark: SparkSession, d: str) -> DataFrame:
    """The worst five of the twenty best."""
    g, query = _vectors(spark, d)
    g.register_reranker("worst", lambda q, found: [(x["id"], -x["score"]) for x in found])
    return _own_ids(g, g.semantic_search(query, 5, "v", reranker="worst", candidate_multiplier=4))


def vector_procedure(spark: SparkSession, d: str) -> DataFrame:
    g, query = _vectors(spark, d)
    return g.execute("CALL db.vector.search('v', $q, 8, {labels: ['Vec']}) YIELD node, score RETURN node.vec_id AS vec_id, round(score, 4) AS score", {"q": query})


def vector_index_saved(spark: SparkSession, d: str) -> DataFrame:
    """An index written, dropped, made anew and read; then without one vector and with another one's place changed."""
    g, query = _vectors(spark, d)
    folder = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex[:12]}"
    g.save_vector_index("v", folder)
    g.drop_vector_index("v")
    g.create_vector_index("v", 64)
    g.load_vector_index("v", folder)
    g.remove_embeddings("v", [g.global_id("Vec", 7)])
    g.upsert_embeddings("v", [(g.global_id("Vec", 8), query)])
    return _own_ids(g, g.semantic_search(query, 5, "v"))


def inverted_file(spark: SparkSession, d: str) -> DataFrame:
    """Whether half the lists give nine tenths of the ten nearest, for the vectors whose id is divisible by 100."""
    vectors = read(spark, d, "embeddings")
    index, centroids = search.inverted_lists(vectors, "vec_id", "embedding", 16)
    index = index.cache()
    rows = []
    for q in vectors.where("vec_id % 100 = 0").collect():
        near = {r.vec_id for r in search.probe(index, centroids, "vec_id", "embedding", list(q.embedding), 10, 8).collect()}
        exact = {r.vec_id for r in search.nearest(vectors, "vec_id", "embedding", list(q.embedding), 10).collect()}
        rows.append((q.vec_id, len(near), q.vec_id in near, len(near & exact)))
    index.unpersist()
    hits = sum(r[3] for r in rows)
    return spark.createDataFrame([(*r[:3], hits >= 9 * len(rows)) for r in rows], "query bigint, n int, itself boolean, recalled boolean")


def approximate_search(spark: SparkSession, d: str) -> DataFrame:
    """Of a graph's vector index in lists: whether a search of five of eight lists, filtered, finds the vector itself and most of the exact answer."""
    g, query = _vectors(spark, d)
    g.build_vector_index("v", lists=8)
    some = {"label": PropertyFilter.gte(1)}
    exact, near = ([r.node_id for r in g.semantic_search(query, 10, "v", LabelFilter.any("Vec"), some, probes=n).collect()] for n in (None, 5))
    return spark.createDataFrame([(len(near), near[0] == exact[0], len(set(near) & set(exact)) >= 7)], "n int, first boolean, recalled boolean")


def embedded(spark: SparkSession, d: str) -> DataFrame:
    """The customers' segments found by their own names through a hashing embedder."""
    g = Graph(spark)
    g.register_embedder("words", HashingEmbedder(64))
    ids = g.create_nodes([(["Word"], {"name": r["name"]}, None) for r in regions(spark, d)])
    g.create_vector_index("w", 64, embedder="words")
    g.embed_nodes("w", ["name"], "Word")
    rows = [(r["name"], g.semantic_search(r["name"], 1, "w").first().node_id == i) for r, i in zip(regions(spark, d), ids, strict=True)]  # type: ignore[union-attr]
    return spark.createDataFrame(rows, "name string, found boolean")


def text_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Text indexes made, listed and dropped; a search over nodes and one over relationships."""
    g = trade(spark, d)
    g.create_text_index("node", "Nation", ["n_name"])
    g.create_text_index("node", "Region", "r_name")
    g.create_text_index("relationship", "HOLDS", ["l_returnflag"])
    dropped = g.drop_text_index("relationship", "HOLDS")
    rows = [(x["label"], ",".join(x["props"]), dropped) for x in g.list_text_indexes()]
    found = g.text_search("asia OR china", 10)
    listed = spark.createDataFrame(rows, "label string, props string, dropped boolean").select(F.lit("index").alias("what"), "label", F.lit(None).cast("bigint").alias("k"))
    return listed.unionByName(found.select(F.lit("hit").alias("what"), F.col("label_type").alias("label"), (F.col("entity_id") % F.lit(1 << 40)).alias("k")))


def custom_text(spark: SparkSession, d: str) -> DataFrame:
    """A text index of the parts' names beside the graph, with stop words, after documents were replaced and removed."""
    g = Graph(spark)
    index = g.register_text_index("parts")
    names = read(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text"))
    index.add(names)
    index.add(names.where("doc_id % 3 = 0").withColumn("text", F.lit("the plain thing")))
    index.remove([1, 2])
    return g.text_search_custom("the plain thing", 1_000_000, "parts").select(F.col("doc_id").alias("k"))


def text_procedure(spark: SparkSession, d: str) -> DataFrame:
    g = trade(spark, d)
    g.create_text_index("node", "Part", ["p_name"])
    return g.execute("CALL db.text.search('red', 1000000) YIELD node, score RETURN node.p_partkey AS k")


def hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Reciprocal ranks of a text ranking and a vector ranking of things with one id."""
    docs = spread(read(spark, d, "documents").select("doc_id", "text"))
    query = list(read(spark, d, "embeddings").where("vec_id = 7").first().embedding)  # type: ignore[union-attr]
    texts = search.bm25(docs, ["doc_id"], "text", "harbour team", 50)
    vectors = search.nearest(read(spark, d, "embeddings"), "vec_id", "embedding", query, 50).withColumnRenamed("vec_id", "doc_id")
    return search.reciprocal_ranks([texts, vectors], "doc_id", 20).select("doc_id", F.round("score", 8).alias("score"))


def crud(spark: SparkSession, d: str) -> DataFrame:
    """Every change of the programmatic interface; what is left."""
    g = Graph(spark)
    ids = g.create_nodes([(["Region"], {"name": r["name"], "key": r["key"]}, f"urn:r{r['key']}") for r in regions(spark, d)])
    first, made = g.merge_node(["Region"], {"key": 0}, on_match={"seen": True})
    other, made_other = g.merge_node(["Region"], {"key": 9}, {"name": "NEW"})
    g.update_node_properties(ids[1], {"name": "ONE"})
    g.replace_node_properties(ids[2], {"key": 2})
    g.add_labels(ids[3], ["Big"])
    g.remove_labels(ids[3], ["region"])
    r = [g.create_relationship(a, b, "NEXT", {"n": k}) for k, (a, b) in enumerate(zip(ids, ids[1:]))]
    g.update_relationship_properties(r[0], {"m": 1})
    g.replace_relationship_properties(r[1], {"m": 2})
    g.delete_relationship(r[2])
    g.delete_node(ids[4])
    left = [(n["properties"].get("key"), n["properties"].get("name"), n["labels"][0], n["properties"].get("seen"), n["id"] in (first, other)) for i in (*ids, other) if (n := g.get_node(i))]
    edges = [(x["properties"].get("n"), None, x["type"], x["properties"].get("m") == 1, made_other and not made) for i in r if (x := g.get_relationship(i))]
    return spark.createDataFrame(left + edges, "key bigint, name string, kind string, flag boolean, merged boolean")


def transactions(spark: SparkSession, d: str) -> DataFrame:
    """What is there after a rollback, after a commit, and after a block that fails."""
    g = trade(spark, d)
    rows = []

    def count(what: str) -> None:
        rows.append((what, g.get_node_count("Nation"), g.get_node_count("Tmp")))

    g.begin_transaction()
    g.execute("MATCH (n:Nation) WHERE n.n_regionkey = 0 DETACH DELETE n")
    g.create_node(["Tmp"], {})
    count("inside")
    g.rollback()
    count("rolled back")
    g.begin_transaction()
    g.create_node(["Tmp"], {})
    g.commit()
    count("committed")
    try:
        with g:
            g.create_nodes([(["Tmp"], {}, None)] * 3)
            raise ZeroDivisionError
    except ZeroDivisionError:
        count("failed")
    return spark.createDataFrame(rows, "what string, nations bigint, tmp bigint")


def refusals(spark: SparkSession, d: str) -> DataFrame:
    """Wrong calls and the errors they raise."""
    g = trade(spark, d)
    wrong: list[tuple[str, type[Exception], Callable[[], object]]] = [
        ("unique", ConstraintError, lambda: g.create_uniqueness_constraint("node", "Customer", "c_mktsegment")),
        ("exists", ConstraintError, lambda: g.create_existence_constraint("node", "Part", "missing")),
        ("type", ConstraintError, lambda: g.create_type_constraint("node", "Part", "p_name", "INTEGER")),
        ("filter", InvalidFilterError, lambda: g.match_nodes(["Part"], {"a-b": 1})),
        ("page", InvalidFilterError, lambda: g.match_nodes(["Part"], limit=-1)),
        ("label", InvalidLabelError, lambda: g.create_node(["A", "a"], {})),
        ("property", InvalidPropertyError, lambda: g.create_node(["A"], {"x": object()})),
        ("node", NodeNotFoundError, lambda: g.get_neighbors(3)),
        ("end", NodeNotFoundError, lambda: g.create_relationship(g.global_id("Part", 0), 3, "T")),
        ("relationship", RelationshipNotFoundError, lambda: g.update_relationship_properties(3, {"a": 1})),
        ("query", CypherExecutionError, lambda: g.execute("MATCH (p:Part) RETURN toUpper(1)")),
    ]

    def raised(error: type[Exception], f: Callable[[], object]) -> bool:
        try:
            f()
        except error:
            return True
        return False

    return spark.createDataFrame([(what, raised(error, f)) for what, error, f in wrong], "what string, raised boolean")


def managed(spark: SparkSession, d: str) -> DataFrame:
    """Indexes and constraints by the interface, as listed."""
    g = trade(spark, d)
    g.create_node_index("Part", "p_brand")
    g.create_relationship_index("HOLDS", "l_quantity")
    g.create_uniqueness_constraint("node", "Part", "p_partkey")
    g.create_existence_constraint("node", "Part", "p_name")
    g.create_type_constraint("node", "Part", "p_size", "INTEGER")
    g.drop_constraint("constraint_node_part_p_name_exists")
    return spark.createDataFrame([(i.name,) for i in g.list_indexes()] + [(c.name,) for c in g.list_constraints()], "name string")


def cypher(make: Callable[[SparkSession, str], Graph], *texts: str, **params: Any) -> Query:
    """The last query's rows, after the others."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        g = make(spark, d)
        for t in texts[:-1]:
            g.execute(t, params)
        return g.execute(texts[-1], params)

    return run


_COSINE = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7))"
_WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_PARTS_WORDS = "list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '')"
_NATIONS = "nation JOIN region ON n_regionkey = r_regionkey"


def _bm25(words: Iterable[str]) -> str:
    """BM25 of documents that hold all of the words: doc_id and score."""
    terms = list(words)
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{k}" for k, t in enumerate(terms))
    df = ", ".join(f"sum(CAST(tf{k} > 0 AS INTEGER)) AS df{k}" for k in range(len(terms)))
    parts = " + ".join(f"ln(1 + (n - df{k} + 0.5) / (df{k} + 0.5)) * tf{k} * 2.2 / (tf{k} + 1.2 * (0.25 + 0.75 * dl / mean))" for k in range(len(terms)))
    held = " AND ".join(f"tf{k} > 0" for k in range(len(terms)))
    return f"(WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), t AS (SELECT doc_id, len(w) AS dl, {tf} FROM w), s AS (SELECT count(*) AS n, avg(dl) AS mean, {df} FROM t) SELECT doc_id, {parts} AS score FROM t, s WHERE {held})"


ENTRIES: dict[str, tuple[Query, str | None]] = {
    "load_csv_headers": (loaded(as_csv(True), "LOAD CSV WITH HEADERS FROM '$PLACE' AS row RETURN toInteger(row.key) AS k, row.name AS name, row.none AS none"), "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name, CAST(NULL AS VARCHAR) AS none FROM nation"),
    "load_csv": (loaded(as_csv(False), "LOAD CSV FROM '$PLACE' AS row RETURN toInteger(row[0]) AS k, row[1] AS name, row[7] AS none"), "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name, CAST(NULL AS VARCHAR) AS none FROM nation"),
    "load_csv_each": (csv_for_each, "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name FROM nation"),
    "load_json": (loaded(as_json, "CALL apoc.load.json('$PLACE') YIELD value RETURN toInteger(value.key) AS k, toString(value.name) AS name, size(value.nations) AS n"), f"SELECT CAST(r_regionkey AS BIGINT) AS k, r_name AS name, count(*) AS n FROM {_NATIONS} GROUP BY ALL"),
    "load_json_array": (loaded(as_json, "CALL apoc.load.jsonArray('$PLACE') YIELD value RETURN toInteger(value.key) AS k"), "SELECT CAST(r_regionkey AS BIGINT) AS k FROM region"),
    "load_json_params": (loaded(as_gzip, "CALL apoc.load.jsonParams('$PLACE', {a: 1}, null) YIELD value RETURN toInteger(value.key) AS k"), "SELECT CAST(r_regionkey AS BIGINT) AS k FROM region"),
    "load_json_member": (loaded(as_tar, "CALL apoc.load.json('$PLACE!in/regions.json') YIELD value RETURN toInteger(value.key) AS k"), "SELECT CAST(r_regionkey AS BIGINT) AS k FROM region"),
    "load_json_each": (json_for_each, f"SELECT CAST(r_regionkey AS BIGINT) AS k, r_name AS name, count(*) AS n FROM {_NATIONS} GROUP BY ALL"),
    "load_html": (loaded(as_html, "CALL apoc.load.html('$PLACE', {names: 'table.wide tr td:eq(1)'}) YIELD value UNWIND value.names AS x RETURN toString(x.text) AS name"), "SELECT r_name AS name FROM region"),
    "load_xml": (loaded(as_xml, "CALL apoc.load.xml('$PLACE', '/world/region') YIELD value RETURN toInteger(toString(value._attributes.key)) AS k, toString(value.name._text) AS name"), "SELECT CAST(r_regionkey AS BIGINT) AS k, r_name AS name FROM region"),
    "load_xml_params": (loaded(as_xml, "CALL apoc.load.xmlParams('$PLACE', '//nation', {a: 1}, null) YIELD value RETURN toString(value._text) AS name"), "SELECT n_name AS name FROM nation"),
    "import_json": (import_json, f"SELECT r_name AS region, count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS s FROM {_NATIONS} GROUP BY r_name"),
    "execute_script": (script, "SELECT 'a;b' AS text, CAST(1 AS BIGINT) AS n UNION ALL SELECT r_name, 2 FROM region"),
    "point_lookups": (lookups, "SELECT CAST(n_nationkey AS BIGINT) AS k, 'Nation' AS label, n_name AS name FROM nation WHERE n_nationkey IN (0, 3, 24) UNION ALL SELECT 999, NULL, NULL"),
    "dump_restore": (restored, f"SELECT a.r_name AS name, CAST(a.r_regionkey AS BIGINT) AS n, CAST(a.r_regionkey + 1 AS BIGINT) AS k, b.n AS nations FROM region a JOIN (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1) b ON b.n_regionkey = a.r_regionkey + 1"),
    "save_load": (saved, "SELECT c_mktsegment AS s, count(*) AS n, round(sum(o_totalprice), 0) AS total FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment"),
    "diagrams": (diagrams, "SELECT unnest(['mermaid', 'dot', 'd2', 'd3', 'cytoscape']) AS kind, (SELECT count(*) FROM nation) AS edges"),
    "rdf_values": (triples, "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name, 'http://www.w3.org/2001/XMLSchema#string' AS datatype FROM nation"),
    "rdf_jsonld": (linked_data, "SELECT 'http://x/Region' AS type, CAST(NULL AS VARCHAR) AS nation, false AS link FROM region UNION ALL SELECT 'http://x/Nation', n_name, false FROM nation UNION ALL SELECT NULL, NULL, true FROM nation"),
    "filter_values": (
        filter_values,
        "SELECT 'null' AS what, p_partkey AS k FROM part WHERE p_size IS NULL UNION ALL SELECT 'typed', p_partkey FROM part WHERE p_size > 48 UNION ALL SELECT 'ending', p_partkey FROM part WHERE p_size = 1 UNION ALL SELECT 'word', p_partkey FROM part WHERE p_size < 4 AND ends_with(lower(p_name), 'e')",
    ),
    "filter_nested": (nested_filter, "SELECT r_name AS name FROM region WHERE r_regionkey >= 2"),
    "foreach": (foreach, "SELECT CAST(r_regionkey AS BIGINT) AS k, CAST(2 * r_regionkey AS BIGINT) AS t FROM region"),
    "show_catalogue": (catalogue, "SELECT * FROM (VALUES ('idx_node_nation_n_name', 'index'), ('idx_node_uri', 'index'), ('constraint_node_nation_n_name_unique', 'unique'), ('constraint_node_region_r_name_exists', 'exists')) AS t(name, kind)"),
    "managed_catalogue": (managed, "SELECT unnest(['idx_node_part_p_brand', 'idx_relationship_holds_l_quantity', 'constraint_node_part_p_partkey_unique', 'constraint_node_part_p_size_type']) AS name"),
    "labels_and_types": (
        labels_and_types,
        "SELECT 'label' AS what, unnest(['Region', 'Nation', 'Customer', 'Supplier', 'Part', 'Order']) AS name UNION ALL SELECT 'type', unnest(['IN_REGION', 'FROM_NATION', 'PLACED', 'HOLDS', 'SUPPLIES'])",
    ),
    "find_paths": (
        paths,
        "SELECT how, CAST((n_regionkey + o) % 5 AS BIGINT) AS region, CASE WHEN o = 0 THEN 2 END AS n FROM nation, (VALUES ('shortest', 0), ('shortest', 1), ('any', 0)) AS t(how, o) WHERE n_nationkey = 7",
    ),
    "vector_rerank": (
        reranked,
        "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 7) SELECT vec_id, round(0 - pow(list_distance(CAST(embedding AS DOUBLE[]), q), 2), 4) AS score FROM embeddings, q ORDER BY list_distance(CAST(embedding AS DOUBLE[]), q), vec_id LIMIT 10",
    ),
    "vector_reranker": (custom_reranked, f"SELECT vec_id, round(0 - c, 4) AS score FROM (SELECT vec_id, {_COSINE} AS c FROM embeddings ORDER BY c DESC, vec_id LIMIT 20) ORDER BY c LIMIT 5"),
    "vector_procedure": (vector_procedure, f"SELECT vec_id, round({_COSINE}, 4) AS score FROM embeddings ORDER BY {_COSINE} DESC, vec_id LIMIT 8"),
    "vector_index_saved": (vector_index_saved, f"SELECT vec_id, round(c, 4) AS score FROM (SELECT vec_id, CASE WHEN vec_id = 8 THEN 1.0 ELSE {_COSINE} END AS c FROM embeddings WHERE vec_id <> 7) ORDER BY c DESC, vec_id LIMIT 5"),
    "vector_index_lists": (approximate_search, "SELECT CAST(10 AS INTEGER) AS n, true AS first, true AS recalled"),
    "ivf_search": (inverted_file, "SELECT vec_id AS query, CAST(10 AS INTEGER) AS n, true AS itself, true AS recalled FROM embeddings WHERE vec_id % 100 = 0"),
    "embedding_function": (embedded, "SELECT r_name AS name, true AS found FROM region"),
    "text_index_catalogue": (
        text_catalogue,
        "SELECT 'index' AS what, unnest(['Nation', 'Region']) AS label, CAST(NULL AS BIGINT) AS k UNION ALL SELECT 'hit', 'Region', r_regionkey FROM region WHERE list_contains(string_split_regex(lower(r_name), '[^a-z0-9]+'), 'asia') UNION ALL SELECT 'hit', 'Nation', n_nationkey FROM nation WHERE list_contains(string_split_regex(lower(n_name), '[^a-z0-9]+'), 'china')",
    ),
    "text_custom_index": (custom_text, f"SELECT p_partkey AS k FROM part WHERE p_partkey NOT IN (1, 2) AND (p_partkey % 3 = 0 OR (list_contains({_PARTS_WORDS}, 'plain') AND list_contains({_PARTS_WORDS}, 'thing')))"),
    "text_procedure": (text_procedure, f"SELECT p_partkey AS k FROM part WHERE list_contains({_PARTS_WORDS}, 'red')"),
    "hybrid_search": (
        hybrid,
        f"WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM {_bm25(('harbour', 'team'))} QUALIFY r <= 50), b AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY {_COSINE} DESC, vec_id) AS r FROM embeddings QUALIFY r <= 50) "
        "SELECT doc_id, round(sum(1.0 / (60 + r)), 8) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id ORDER BY sum(1.0 / (60 + r)) DESC, doc_id LIMIT 20",
    ),
    "crud": (
        crud,
        """SELECT CAST(r_regionkey AS BIGINT) AS key, CASE r_regionkey WHEN 1 THEN 'ONE' WHEN 2 THEN NULL ELSE r_name END AS name, CASE WHEN r_regionkey = 3 THEN 'Big' ELSE 'Region' END AS kind, CASE WHEN r_regionkey = 0 THEN true END AS flag, r_regionkey = 0 AS merged FROM region WHERE r_regionkey < 4
        UNION ALL SELECT * FROM (VALUES (9, 'NEW', 'Region', NULL, true), (0, NULL, 'NEXT', true, true), (NULL, NULL, 'NEXT', false, true))""",
    ),
    "transactions": (
        transactions,
        "SELECT 'inside' AS what, count(*) FILTER (n_regionkey <> 0) AS nations, CAST(1 AS BIGINT) AS tmp FROM nation UNION ALL SELECT 'rolled back', count(*), 0 FROM nation UNION ALL SELECT 'committed', count(*), 1 FROM nation UNION ALL SELECT 'failed', count(*), 1 FROM nation",
    ),
    "refusals": (refusals, "SELECT unnest(['unique', 'exists', 'type', 'filter', 'page', 'label', 'property', 'node', 'end', 'relationship', 'query']) AS what, true AS raised"),
    "parameters": (
        cypher(trade, "MATCH (p:Part) WHERE p.p_brand = $brand AND $low < p.p_size < $high RETURN p.p_partkey AS k, p.p_size IN $sizes AS listed", brand="Brand#11", low=5, high=40, sizes=[7, 8, 9]),
        "SELECT p_partkey AS k, p_size IN (7, 8, 9) AS listed FROM part WHERE p_brand = 'Brand#11' AND p_size > 5 AND p_size < 40",
    ),
    "detach_delete": (
        cypher(trade, "MATCH (n:Nation) WHERE n.n_regionkey = 1 DETACH DELETE n", "MATCH (n:Nation) WHERE n.n_regionkey = 2 SET n:Kept", "MATCH (c)-[:FROM_NATION]->(n:Nation) RETURN labels(n)[0] AS first, COUNT(*) AS n"),
        "SELECT CASE WHEN n_regionkey = 2 THEN 'Kept' ELSE 'Nation' END AS first, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) JOIN nation ON n_nationkey = k WHERE n_regionkey <> 1 GROUP BY 1",
    ),
    "text_functions": (
        cypher(trade, "MATCH (p:Part) RETURN p.p_partkey AS k, deaccent('é' + p.p_brand) AS a, strip_emoji($face + p.p_brand) AS e, size(apoc.text.split(p.p_name, ' +')) AS n, reverse(p.p_brand)[0] AS r, apoc.text.replace(p.p_name, '[aeiou]', '') AS v", face="\U0001f600"),
        "SELECT p_partkey AS k, 'e' || p_brand AS a, p_brand AS e, len(string_split_regex(p_name, ' +')) AS n, substr(p_brand, length(p_brand), 1) AS r, regexp_replace(p_name, '[aeiou]', '', 'g') AS v FROM part",
    ),
    "time_functions": (
        cypher(
            trade,
            "MATCH (o:Order) WHERE o.o_orderkey < 500 RETURN o.o_orderkey AS k, toString(time.truncate('hour', time('10:20:30'))) AS t, duration.between(date('1990-01-01'), date(o.o_orderdate)).days AS days, datetime.truncate('year', datetime(toString(date(o.o_orderdate)) + 'T10:00:00Z')).year AS y, date(o.o_orderdate).month AS m",
        ),
        "SELECT o_orderkey AS k, '10:00:00' AS t, CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders WHERE o_orderkey < 500",
    ),
    "map_functions": (
        cypher(
            trade,
            "MATCH (p:Part) WITH p.p_partkey AS k, {a: p.p_brand, b: p.p_type} AS m RETURN k, apoc.map.fromPairs([['x', m.a], ['y', m.b]])['y'] AS y, size(keys(apoc.map.removeKey(m, 'a'))) AS one, apoc.map.clean({a: 1, b: 2, c: null}, ['a'], [3])['b'] AS b, size(apoc.coll.toSet([m.a, m.a, m.b])) AS s",
        ),
        "SELECT p_partkey AS k, p_type AS y, CAST(1 AS BIGINT) AS one, CAST(2 AS BIGINT) AS b, CAST(CASE WHEN p_brand = p_type THEN 1 ELSE 2 END AS BIGINT) AS s FROM part",
    ),
}
QUERIES: dict[str, Query] = {n: q for n, (q, _) in ENTRIES.items()}
SQL: dict[str, str] = {n: s for n, (_, s) in ENTRIES.items() if s}
SQL["text_search"] = f"SELECT doc_id, round(score, 6) AS score FROM {_bm25(('harbour', 'auditor'))} ORDER BY score DESC, doc_id LIMIT 20"
