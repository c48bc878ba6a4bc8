"""Graphs written out: scripts of the query language, RDF, diagrams, other libraries' graphs."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis import catalog
from trellis.cypher.values import family, ref, to_variant
from trellis.cypher.values import Val as Value
from trellis.exceptions import TrellisError

if TYPE_CHECKING:
    from trellis.graph import Graph

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDF_STATEMENT = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
MOST_DRAWN = 100_000
XSD = "http://www.w3.org/2001/XMLSchema#"


def literal(value: Any) -> str:
    """A value in the query language."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(literal, value)) + "]"
    if isinstance(value, dict):
        return "{" + ", ".join(f"{name(k)}: {literal(v)}" for k, v in value.items()) + "}"
    text = str(value)
    for a, b in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = text.replace(a, b)
    return f"'{text}'"


def name(x: str) -> str:
    return x if x.isidentifier() else f"`{x}`"


def vector_literal(vector: list[float], precision: int = 6) -> str:
    import math

    if not vector or not all(math.isfinite(x) for x in vector):
        raise TrellisError("a vector is a list of finite numbers")
    return "[" + ", ".join(f"{x:.{precision}f}".rstrip("0").rstrip(".") if "." in f"{x:.{precision}f}" else f"{x:.{precision}f}" for x in vector) + "]"


def records(df: DataFrame) -> Iterator[dict[str, Any]]:
    from trellis.graph import record

    for r in df.toLocalIterator(prefetchPartitions=True):  # one partition at a time
        yield record(r.asDict(recursive=True))


def script(graph: Graph) -> Iterator[str]:
    """Statements that rebuild the graph: constraints, indexes, nodes under a temporary id, relationships, clean-up."""
    kinds = {"unique": "IS UNIQUE", "exists": "IS NOT NULL"}
    for c in graph.state.constraints:
        target = f"(x:{name(c.label)})" if c.entity == "node" else f"()-[x:{name(c.label)}]-()"
        yield f"CREATE CONSTRAINT {c.name} ON {target} ASSERT x.{name(c.property)} {kinds.get(c.kind) or 'IS ' + str(c.type)};"
    for i in graph.state.indexes:
        if i.label:
            yield f"CREATE {'UNIQUE ' if i.unique else ''}INDEX ON {'NODE' if i.entity == 'node' else 'RELATIONSHIP'} :{name(i.label)}({name(i.property)});"
    for r in records(graph.nodes_frame().orderBy("id")):
        labels = "".join(":" + name(x) for x in r["labels"])
        yield f"CREATE (n{labels} {literal({'_dump_id': r['id']} | r['properties'])});"
    for r in records(graph.relationships_frame().orderBy("id")):
        props = " " + literal(r["properties"]) if r["properties"] else ""
        yield f"MATCH (a {{_dump_id: {r['src']}}}), (b {{_dump_id: {r['dst']}}}) CREATE (a)-[:{name(r['type'])}{props}]->(b);"
    yield "MATCH (n) REMOVE n._dump_id;"


def dump(graph: Graph, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(s + "\n" for s in script(graph))


def restore(graph: Graph, path: str, clear_existing: bool = False) -> None:
    """All statements are parsed before the first is applied."""
    from trellis.cypher.parser import parse, split_statements

    with open(path, encoding="utf-8") as f:
        statements = split_statements(f.read())
    for s in statements:
        parse(s)
    if clear_existing:
        graph.state = catalog.State()
    for s in statements:
        graph.execute(s)


def save(graph: Graph, folder: str) -> None:
    """Nodes and relationships as Parquet."""
    graph.nodes_frame().write.mode("overwrite").parquet(f"{folder}/nodes")
    graph.relationships_frame().write.mode("overwrite").parquet(f"{folder}/relationships")


def load(graph: Graph, folder: str) -> Graph:
    tables = []
    for kind, sub in (("node", "nodes"), ("rel", "relationships")):
        df = graph.spark.read.parquet(f"{folder}/{sub}")
        tables.append(catalog.Table(kind, df, {c[2:]: df.schema[c].dataType for c in df.columns if c.startswith("p_")}))
    top = lambda df: (df.agg(F.max("id")).first()[0] or 0) + 1
    graph.state = graph.state.but(nodes=(tables[0],), rels=(tables[1],), next_node=top(tables[0].df), next_rel=top(tables[1].df))
    return graph


def triples(graph: Graph, base: str = "http://example.org/") -> DataFrame:
    """subject, predicate, object, datatype: labels as types, properties as predicates, relationships, and reified relationship properties.

    datatype is null where the object is a resource.
    """
    iri = lambda uri, kind, key: F.coalesce(uri, F.concat(F.lit(f"{base}{kind}/"), key.cast("string")))
    nodes, rels = graph.nodes_frame(), graph.relationships_frame()
    types = catalog.merged_props(list(graph.state.nodes)), catalog.merged_props(list(graph.state.rels))
    subject = iri(F.col("uri"), "node", F.col("id"))
    none = F.lit(None).cast("string")
    parts = [nodes.select(subject.alias("subject"), F.lit(RDF_TYPE).alias("predicate"), F.explode(F.transform("labels", lambda x: F.concat(F.lit(base), x))).alias("object"), none.alias("datatype"))]

    def properties(df: DataFrame, subject: Any, props: dict) -> DataFrame | None:
        entries = []
        for k, t in props.items():
            if "p_" + k not in df.columns:
                continue
            col = ref("p_" + k)
            kind = {"number": "integer" if t.typeName() == "long" else "double", "boolean": "boolean", "date": "date", "zoned": "dateTime", "naive": "dateTime"}.get(family(t), "string")
            values = F.transform(col, lambda x: x.cast("string")) if family(t) == "list" else F.array(F.to_json(col) if family(t) == "variant" else F.to_json(to_variant(Value(col, t))) if family(t) == "map" else col.cast("string"))
            entries.append(F.struct(F.lit(base + k).alias("p"), values.alias("v"), F.lit(XSD + kind).alias("t"), col.isNotNull().alias("ok")))
        if not entries:
            return None
        x = df.select(subject.alias("subject"), F.explode(F.array(*entries)).alias("e")).where("e.ok")
        return x.select("subject", F.col("e.p").alias("predicate"), F.explode("e.v").alias("object"), F.col("e.t").alias("datatype")).where(F.col("object").isNotNull())

    ends = nodes.select(F.col("id").alias("n_id"), subject.alias("n_iri"))
    linked = rels.join(ends.select(F.col("n_id").alias("s_id"), F.col("n_iri").alias("s_iri")), F.col("src") == F.col("s_id")).join(ends.select(F.col("n_id").alias("o_id"), F.col("n_iri").alias("o_iri")), F.col("dst") == F.col("o_id"))
    parts.append(linked.select(F.col("s_iri").alias("subject"), F.concat(F.lit(base), F.col("type")).alias("predicate"), F.col("o_iri").alias("object"), none.alias("datatype")))
    names = [k for k in types[1] if "p_" + k in rels.columns]
    if names:
        held = linked.where(F.coalesce(*(F.when(ref("p_" + k).isNotNull(), F.lit(True)) for k in names), F.lit(False)))
        statement = iri(F.col("uri"), "relationship", F.col("id"))
        for what, col in (("subject", F.col("s_iri")), ("predicate", F.concat(F.lit(base), F.col("type"))), ("object", F.col("o_iri"))):
            parts.append(held.select(statement.alias("subject"), F.lit(RDF_STATEMENT + what).alias("predicate"), col.alias("object"), none.alias("datatype")))
        p = properties(held, statement, types[1])
        parts += [p] if p is not None else []
    p = properties(nodes, subject, types[0])
    parts += [p] if p is not None else []
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def ntriples(graph: Graph, base: str = "http://example.org/") -> DataFrame:
    """A column `value` of N-Triples lines, to be written as text."""
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.regexp_replace("object", r"\\", r"\\\\"), '"', '\\\\"'), "\n", r"\\n"), F.lit('"'))
    plain = F.col("datatype") == XSD + "string"
    obj = F.when(F.col("datatype").isNull(), F.concat(F.lit("<"), "object", F.lit(">"))).when(plain, quoted).otherwise(F.concat(quoted, F.lit("^^<"), "datatype", F.lit(">")))
    return triples(graph, base).select(F.concat(F.lit("<"), "subject", F.lit("> <"), "predicate", F.lit("> "), obj, F.lit(" .")).alias("value"))


def jsonld(graph: Graph, base: str = "http://example.org/") -> DataFrame:
    """A column `value` of JSON-LD node objects in expanded form: one for each resource with its types and values, and one for each link.

    Objects of one @id belong together, as JSON-LD has it, so a resource of very many links is never gathered in one place.
    """
    rows = triples(graph, base)
    is_type = F.col("predicate") == RDF_TYPE
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    plain = F.concat(F.lit('{"@value":'), quoted("object"), F.lit("}"))
    typed = F.concat(F.lit('{"@value":'), quoted("object"), F.lit(',"@type":'), quoted("datatype"), F.lit("}"))
    entry = F.when(is_type, quoted("object")).when(F.col("datatype") == XSD + "string", plain).when(F.col("datatype").isNotNull(), typed).otherwise(F.concat(F.lit('{"@id":'), quoted("object"), F.lit("}")))
    key = F.when(is_type, F.lit('"@type"')).otherwise(quoted("predicate"))
    each = rows.select("subject", key.alias("key"), entry.alias("entry"), (is_type | F.col("datatype").isNotNull()).alias("own"))
    member = lambda entries: F.concat("key", F.lit(":["), entries, F.lit("]"))
    whole = lambda members: F.concat(F.lit('{"@id":'), quoted("subject"), F.lit(","), members, F.lit("}")).alias("value")
    own = each.where("own").groupBy("subject", "key").agg(member(F.array_join(F.array_sort(F.collect_list("entry")), ",")).alias("member"))
    nodes = own.groupBy("subject").agg(F.array_join(F.array_sort(F.collect_list("member")), ",").alias("members")).select(whole(F.col("members")))
    return nodes.unionByName(each.where(~F.col("own")).select(whole(member(F.col("entry")))))


def _labelled(graph: Graph) -> tuple[DataFrame, DataFrame]:
    nodes = graph.nodes_frame()
    title = F.coalesce(*([ref("p_name").cast("string")] if "p_name" in nodes.columns else []), F.concat(F.array_join("labels", ":"), F.lit(" "), F.col("id").cast("string")))
    return nodes.select("id", F.regexp_replace(title, '["\\[\\]{}|]', " ").alias("title"), "labels"), graph.relationships_frame().select("src", "dst", "type")


def _mermaid(ns: list, rs: list) -> str:
    return "\n".join(["graph LR", *(f'  n{n.id}["{n.title}"]' for n in ns), *(f"  n{r.src} -->|{r.type}| n{r.dst}" for r in rs)])


def _dot(ns: list, rs: list) -> str:
    return "\n".join(["digraph G {", *(f'  n{n.id} [label="{n.title}"];' for n in ns), *(f'  n{r.src} -> n{r.dst} [label="{r.type}"];' for r in rs), "}"])


def _d2(ns: list, rs: list) -> str:
    return "\n".join([*(f"n{n.id}: {json.dumps(n.title)}" for n in ns), *(f"n{r.src} -> n{r.dst}: {r.type}" for r in rs)])


def _d3(ns: list, rs: list) -> str:
    return json.dumps({"nodes": [{"id": n.id, "name": n.title, "labels": n.labels} for n in ns], "links": [{"source": r.src, "target": r.dst, "type": r.type} for r in rs]})


def _cytoscape(ns: list, rs: list) -> str:
    edges = [{"data": {"source": str(r.src), "target": str(r.dst), "label": r.type}} for r in rs]
    return json.dumps({"elements": {"nodes": [{"data": {"id": str(n.id), "label": n.title}} for n in ns], "edges": edges}})


DIAGRAMS: dict[str, Callable[[list, list], str]] = {"mermaid": _mermaid, "dot": _dot, "d2": _d2, "d3": _d3, "cytoscape": _cytoscape}


def register_diagram(kind: str, f: Callable[[list, list], str]) -> None:
    """f gets rows of (id, title, labels) and of (src, dst, type)."""
    DIAGRAMS[kind] = f


def diagram(graph: Graph, kind: str) -> str:
    """Text of a diagram: for graphs that a person can look at, of at most MOST_DRAWN nodes and as many links, as all of it comes to the driver."""
    if kind not in DIAGRAMS:
        raise TrellisError(f"unknown diagram {kind}; there are {sorted(DIAGRAMS)}")
    nodes, rels = _labelled(graph)
    ns, rs = nodes.orderBy("id").limit(MOST_DRAWN + 1).collect(), rels.orderBy("src", "dst", "type").limit(MOST_DRAWN + 1).collect()
    if max(len(ns), len(rs)) > MOST_DRAWN:
        raise TrellisError(f"a diagram has at most {MOST_DRAWN} nodes and links")
    return DIAGRAMS[kind](ns, rs)


def to_networkx(graph: Graph, directed: bool = True) -> Any:
    try:
        import networkx as nx
    except ImportError:
        raise TrellisError("networkx is not installed") from None
    g = nx.MultiDiGraph() if directed else nx.MultiGraph()
    for r in records(graph.nodes_frame()):
        g.add_node(r["id"], labels=r["labels"], properties=r["properties"], uri=r["uri"])
    for r in records(graph.relationships_frame()):
        g.add_edge(r["src"], r["dst"], key=r["id"], type=r["type"], properties=r["properties"], uri=r["uri"])
    return g


def from_networkx(graph: Graph, source: Any, label_attr: str = "labels", property_attr: str = "properties", rel_type_attr: str = "type", rel_property_attr: str = "properties") -> dict[Any, int]:
    """The new id of each node; other attributes become properties."""

    def rest(data: dict, label: str, props: str) -> dict:
        return {k: v for k, v in data.items() if k not in (label, props, "uri")} | (data.get(props) or {})

    nodes = list(source.nodes(data=True))
    as_list = lambda x: [x] if isinstance(x, str) else list(x or [])
    ids = graph.create_nodes([(as_list(d.get(label_attr)), rest(d, label_attr, property_attr), d.get("uri")) for _, d in nodes])
    by = {n: i for (n, _), i in zip(nodes, ids, strict=True)}
    graph.create_relationships([(by[a], by[b], d.get(rel_type_attr) or "RELATED_TO", rest(d, rel_type_attr, rel_property_attr), d.get("uri")) for a, b, d in source.edges(data=True)])
    return by
