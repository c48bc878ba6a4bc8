"""Procedures of CALL: loaders, imports, searches and catalogue calls. Each gives a frame of its columns."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.cypher import ast as A
from trellis.cypher.compiler import Compiler, Frame, column
from trellis.cypher.values import VARIANT, Val, ref
from trellis.exceptions import CypherExecutionError, NodeNotFoundError
from trellis.functions.filters import LabelFilter, from_options
from trellis.sources import files

PROCEDURES: dict[str, Callable] = {}


def procedure(name: str) -> Callable[[Callable], Callable]:
    def add(f: Callable) -> Callable:
        PROCEDURES[name.lower()] = f
        return f

    return add


def call(comp: Compiler, c: A.CallProc, args: list[Val], f: Frame) -> Frame:
    """The procedure's rows joined to each binding; no rows, no binding."""
    if c.name.lower() not in PROCEDURES:
        raise CypherExecutionError(f"unknown procedure {c.name}")
    if any(a.const is None and not (isinstance(e, A.Lit) and e.value is None) and not isinstance(e, A.Param) for a, e in zip(args, c.args, strict=True)):
        if c.name.lower() not in FROM_ROWS:
            raise CypherExecutionError(f"{c.name} takes constant arguments")
        return call_each(comp, c, args, f)
    values = [comp.params[e.name] if isinstance(e, A.Param) else a.const for a, e in zip(args, c.args, strict=True)]
    df, types, kinds = PROCEDURES[c.name.lower()](comp, *values)
    wanted = c.yields or [(n, n) for n in types]
    scope = f.scope.copy()
    names = {}
    for name, alias in wanted:
        if name not in types:
            raise CypherExecutionError(f"{c.name} yields no {name}")
        names[name] = comp.name("proc")
    df = df.select(*(ref(n).alias(names[n]) for n in names))
    out = Frame(df if f.unit else f.df.crossJoin(df), scope, keys=f.keys)
    for name, alias in wanted:
        if kinds.get(name) == "node":
            nodes, ent = comp.node_scan(A.NodePat(None, (), None))
            out.df = out.df.join(nodes, ref(names[name]) == ref(ent.id))
            scope.vars[alias] = ent
        else:
            scope.vars[alias] = column(names[name], types[name])
    return out


def call_each(comp: Compiler, c: A.CallProc, args: list[Val], f: Frame) -> Frame:
    """A loader whose arguments come from the rows: each distinct set of arguments is loaded once, by a worker, and joined back."""
    load = FROM_ROWS[c.name.lower()]
    params = [comp.params[e.name] if isinstance(e, A.Param) else None for e in c.args]
    key, name = comp.name("args"), comp.name("proc")
    # constants that are maps or null go as they are, the rest as one JSON text a row
    fixed = [p if isinstance(e, A.Param) else a.const if a.const is not None else None for a, e, p in zip(args, c.args, params, strict=True)]
    moving = [k for k, (a, e) in enumerate(zip(args, c.args, strict=True)) if a.const is None and not isinstance(e, A.Param) and not (isinstance(e, A.Lit) and e.value is None)]
    keyed = f.df.withColumn(key, F.to_json(F.array(*(F.to_json(F.struct(args[k].col.alias("x"))) for k in moving))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text in b["key"]:
                values = list(fixed)
                for k, x in zip(moving, json.loads(text), strict=True):
                    values[k] = json.loads(x).get("x")
                found = load(*values) if values[0] is not None else []
                yield pd.DataFrame({"key": [text] * len(found), "value": found})

    loaded = keyed.select(ref(key).alias("key")).distinct().mapInPandas(run, "key string, value string")
    loaded = loaded.select(F.col("key").alias(key + "_"), F.parse_json("value").alias(name))
    out = Frame(keyed.join(loaded, ref(key) == ref(key + "_")).drop(key, key + "_"), f.scope.copy(), keys=f.keys)
    for given, alias in c.yields or [("value", "value")]:
        if given != "value":
            raise CypherExecutionError(f"{c.name} yields no {given}")
        out.scope.vars[alias] = column(name, VARIANT)
    return out


def _text(source: str, **how: Any) -> str:
    return files.fetch(source, **how).decode("utf-8-sig")


# What a worker does for one set of arguments: JSON texts of the values.
FROM_ROWS: dict[str, Callable[..., list[str]]] = {
    "apoc.load.json": lambda source: files.json_texts(_text(source)),
    "apoc.load.jsonarray": lambda source: files.json_texts(_text(source), True),
    "apoc.load.jsonparams": lambda source, params=None, headers=None, options=None: files.json_texts(_text(files.with_params(source, params), headers=headers, payload=(options or {}).get("payload"), options=options)),
    "apoc.load.html": lambda source, selectors: [files.html_text(_text(source), selectors)],
    "apoc.load.xml": lambda source, path="/", options=None: files.xml_texts(_text(source, options=options), path or "/"),
    "apoc.load.xmlparams": lambda source, path, params=None, headers=None, options=None: files.xml_texts(_text(files.with_params(source, params), options=options), path or "/"),
}


def dynamic_values(df: DataFrame) -> tuple[DataFrame, dict, dict]:
    return df.select("value"), {"value": VARIANT}, {}


@procedure("apoc.load.json")
def load_json(comp: Compiler, source: str) -> tuple:
    return dynamic_values(files.json_values(comp.spark, source))


@procedure("apoc.load.jsonArray")
def load_json_array(comp: Compiler, source: str) -> tuple:
    return dynamic_values(files.json_values(comp.spark, source, True))


@procedure("apoc.load.jsonParams")
def load_json_params(comp: Compiler, source: str, params: dict | None = None, headers: dict | None = None, options: dict | None = None) -> tuple:
    return dynamic_values(files.json_values(comp.spark, files.with_params(source, params), headers=headers, payload=(options or {}).get("payload"), options=options))


@procedure("apoc.load.html")
def load_html(comp: Compiler, source: str, selectors: dict) -> tuple:
    if not isinstance(selectors, dict) or not selectors:
        raise CypherExecutionError("apoc.load.html takes a map of selectors")
    df = files.texts(comp.spark, source)
    return dynamic_values(df.select(F.parse_json(files.html_select(F.col("text"), selectors)).alias("value")))


def _xml(comp: Compiler, source: str, path: str, options: dict | None) -> tuple:
    df = files.texts(comp.spark, source, options=options) if options else files.texts(comp.spark, source)
    return dynamic_values(df.select(F.explode(files.xml_select(F.col("text"), path or "/")).alias("x")).select(F.parse_json("x").alias("value")))


@procedure("apoc.load.xml")
def load_xml(comp: Compiler, source: str, path: str = "/", options: dict | None = None) -> tuple:
    return _xml(comp, source, path, options)


@procedure("apoc.load.xmlParams")
def load_xml_params(comp: Compiler, source: str, path: str, params: dict | None = None, headers: dict | None = None, options: dict | None = None) -> tuple:
    return _xml(comp, files.with_params(source, params), path, options)


@procedure("apoc.import.json")
def import_json(comp: Compiler, source: Any, options: dict | None = None) -> tuple:
    nodes, rels = imported(comp.graph, source, options or {})
    df = comp.spark.createDataFrame([(nodes, rels)], "nodes bigint, relationships bigint")
    return df, {n: df.schema[n].dataType for n in df.columns}, {}


def imported(graph: Any, source: Any, options: dict) -> tuple[int, int]:
    """Nodes and relationships of JSON lines, an array, or {nodes, relationships}; unknown ends are an error."""
    data = files.unpacked(bytes(source), options.get("compression", "")) if isinstance(source, (bytes, bytearray)) else files.fetch(source, options=options)
    text = data.decode("utf-8-sig").strip()
    try:
        whole = json.loads(text)
        records = whole if isinstance(whole, list) else [*whole.get("nodes", []), *whole.get("relationships", whole.get("rels", []))] if "nodes" in whole else [whole]
    except ValueError:
        records = [json.loads(x) for x in text.splitlines() if x.strip()]
    o = lambda k, d: options.get(k, d)
    start_key, end_key = o("startField", "start"), o("endField", "end")
    is_rel = lambda r: str(r.get(o("typeField", "type"))).lower() in ("relationship", "rel", "edge") or (r.get(o("typeField", "type")) not in ("node",) and start_key in r and end_key in r)
    nodes, rels = [r for r in records if not is_rel(r)], [r for r in records if is_rel(r)]
    ids = graph.create_nodes([(list(dict.fromkeys(r.get(o("labelsField", "labels")) or [])), r.get(o("propertiesField", "properties")) or {}, None) for r in nodes])
    by = {str(r.get(o("idField", "id"))): k for r, k in zip(nodes, ids, strict=True)}

    def end(x: Any) -> int:
        key = str(x.get("id", x.get("identity")) if isinstance(x, dict) else x)
        if key not in by:
            raise NodeNotFoundError(f"no node {key}")
        return by[key]

    made = graph.create_relationships([(end(r[start_key]), end(r[end_key]), r.get(o("relTypeField", "label")) or "RELATED_TO", r.get(o("propertiesField", "properties")) or {}, None) for r in rels])
    return len(ids), len(made)


@procedure("db.vector.search")
def vector_search(comp: Compiler, index: str, vector: Any, k: int | None = None, options: dict | None = None) -> tuple:
    o = options or {}
    labels = o.get("labels")
    found = comp.graph.semantic_search(
        vector, k, index, LabelFilter.any(labels) if labels else None, from_options(o["properties"]) if o.get("properties") else None, rerank=bool(o.get("rerank")), reranker=o.get("reranker"), candidate_multiplier=o.get("candidate_multiplier", 4)
    )
    df = found.select(F.col("node_id").alias("node"), "score")
    return df, {n: df.schema[n].dataType for n in df.columns}, {"node": "node"}


@procedure("db.text.search")
def text_search(comp: Compiler, query: str, k: int | None = None, options: dict | None = None) -> tuple:
    found = comp.graph.text_search(query, k, (options or {}).get("labels"), None).where("entity_type = 'node'")
    df = found.select(F.col("entity_id").alias("node"), "score")
    return df, {n: df.schema[n].dataType for n in df.columns}, {"node": "node"}


@procedure("db.uri_index.create")
def uri_index(comp: Compiler, entity: str, unique: bool = False, name: str | None = None) -> tuple:
    i = comp.graph.create_index(entity, None, "uri", bool(unique))
    df = comp.spark.createDataFrame([(name or i.name,)], "name string")
    return df, {"name": df.schema["name"].dataType}, {}


@procedure("db.labels")
def db_labels(comp: Compiler) -> tuple:
    df = comp.graph.nodes_frame().select(F.explode("labels").alias("label")).distinct()
    return df, {"label": df.schema["label"].dataType}, {}


@procedure("db.relationshipTypes")
def db_types(comp: Compiler) -> tuple:
    df = comp.graph.relationships_frame().select(F.col("type").alias("relationshipType")).distinct()
    return df, {"relationshipType": df.schema["relationshipType"].dataType}, {}
