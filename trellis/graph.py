"""The graph: snapshots of node and relationship tables, queries, and a programmatic interface."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis import catalog
from trellis.catalog import Constraint, Index, State, Table
from trellis.cypher.compiler import Compiler
from trellis.cypher.parser import parse, split_statements
from trellis.cypher.values import ref
from trellis.exceptions import ConstraintError, InvalidFilterError, InvalidLabelError, InvalidPropertyError, NodeNotFoundError, RelationshipNotFoundError, TrellisError
from trellis.functions import embedding
from trellis.functions.filters import LabelFilter, PropertyFilterGroup, SortOrder, condition, order_columns
from trellis.operators import search, traversal
from trellis.tables import cut

COMPACT = 24  # tables of single writes before they are put together


class Graph:
    """A labelled property graph. Reading is lazy; a write makes the next immutable snapshot."""

    def __init__(self, spark: SparkSession, state: State | None = None, max_hops: int = 5, top_k: int = 10) -> None:
        self.spark, self.state, self.max_hops, self.top_k = spark, state or State(), max_hops, top_k
        self.saved: State | None = None
        self.ordinals: dict[str, int] = {}
        self.keys: dict[str, str] = {}
        self.rerankers: dict[str, Callable] = {}
        self.embedders: dict[str, Callable] = {}
        self.text_indexes: dict[str, search.TextIndex] = {}

    # tables
    def register_nodes(self, label: str, source: catalog.Source, key: str, props: list[str] | None = None) -> Graph:
        """A label over a table (or a function that gives it when it is first used), its columns typed properties."""
        self.ordinals.setdefault(label, len(self.ordinals) + 1)
        self.keys[label] = key
        table = catalog.node_table(label, source, key, self.ordinals[label], props)
        self.state = self.state.but(nodes=(*self.state.nodes, table))
        return self

    def register_relationships(self, kind: str, source: catalog.Source, start: tuple[str, str], end: tuple[str, str], props: list[str] | None = None) -> Graph:
        """A relationship type over a table; start and end are (label, key column); all other columns are properties unless named."""
        ends = [(label, self.ordinals[label], key) for label, key in (start, end)]
        single = (self.keys.get(start[0]) == start[1], self.keys.get(end[0]) == end[1])
        table = catalog.rel_table(kind, source, ends[0], ends[1], props, single)
        self.state = self.state.but(rels=(*self.state.rels, table))
        return self

    def register_json(self, nodes: DataFrame, rels: DataFrame, node_props: dict[str, str], rel_props: dict[str, str]) -> Graph:
        """Tables of (id, labels, properties, uri) and (id, source_node_id, target_node_id, type, properties, uri) with JSON properties.

        The named properties become typed columns, null where a text is invalid. Exact copies count once, as do
        redeliveries of a relationship; rows without an id or an end are no part of the graph.
        """

        def table(kind: str, df: DataFrame, system: list[Any], props: dict[str, str]) -> Table:
            cols = [F.try_variant_get("_json", f"$['{k}']", t).alias("p_" + k) for k, t in props.items()]
            out = df.withColumn("_json", F.try_parse_json("properties")).select(*system, *cols)
            return Table(kind, out.dropDuplicates(["id"]), {k: out.schema["p_" + k].dataType for k in props})

        good = rels.where(F.col("id").isNotNull() & F.col("source_node_id").isNotNull() & F.col("target_node_id").isNotNull())
        n = table("node", nodes.where(F.col("id").isNotNull()), [F.col("id"), F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), F.col("uri")], node_props)
        r = table("rel", good, [F.col("id"), F.col("source_node_id").alias("src"), F.col("target_node_id").alias("dst"), F.col("type"), F.col("uri")], rel_props)
        self.state = self.state.but(nodes=(*self.state.nodes, n), rels=(*self.state.rels, r))
        return self

    def global_id(self, label: str, key: int) -> int:
        return self.ordinals[label] * catalog.ORDINAL + key

    # queries
    def execute(self, query: str, params: dict[str, Any] | None = None) -> DataFrame:
        compiler = Compiler(self, params)
        return compiler.output(compiler.query(parse(query)))

    def rows(self, query: str, params: dict[str, Any] | None = None) -> list[dict[str, Any]]:
        return [{k: python_value(v) for k, v in r.asDict(recursive=True).items()} for r in self.execute(query, params).collect()]

    def execute_script(self, script: str) -> list[DataFrame]:
        return [self.execute(s) for s in split_statements(script)]

    def execute_script_file(self, path: str) -> list[DataFrame]:
        with open(path, encoding="utf-8") as f:
            return self.execute_script(f.read())

    # snapshots
    def apply(self, state: State) -> None:
        """Checks the constraints and takes the snapshot."""
        for c in state.constraints:
            self.check_constraint(c, state)
        if len([t for t in state.nodes if not t.labels]) > COMPACT:
            state = state.but(nodes=self.compacted(state.nodes))
        if len([t for t in state.rels if not t.labels]) > COMPACT:
            state = state.but(rels=self.compacted(state.rels))
        self.state = state

    def compacted(self, tables: tuple[Table, ...]) -> tuple[Table, ...]:
        loose = [t for t in tables if not t.labels]
        props = catalog.merged_props(loose)
        df = reduce(DataFrame.unionByName, (catalog.conform(t, t.df, props) for t in loose))
        few = cut(df.coalesce(max(1, min(df.rdd.getNumPartitions(), self.spark.sparkContext.defaultParallelism))))
        return (*(t for t in tables if t.labels), Table(loose[0].kind, few, props))

    def begin_transaction(self) -> None:
        if self.saved is None:
            self.saved = self.state

    def commit(self) -> None:
        """Ends the transaction; what it wrote stays."""
        self.saved = None

    def rollback(self) -> None:
        if self.saved is None:
            raise TrellisError("no transaction")
        self.state, self.saved = self.saved, None

    def __enter__(self) -> Graph:
        self.begin_transaction()
        return self

    def __exit__(self, kind: object, *_: object) -> None:
        self.rollback() if kind is not None else self.commit()

    # creation
    def create_nodes(self, records: Iterable[tuple[list[str], dict[str, Any], str | None]]) -> list[int]:
        """Many nodes of (labels, properties, uri) at once; their ids."""
        rows = []
        for k, (labels, properties, uri) in enumerate(records):
            if len({x.lower() for x in labels}) < len(labels):
                raise InvalidLabelError(f"repeated label in {labels}")
            if any(not isinstance(x, str) or not x.strip() for x in labels):
                raise InvalidLabelError(f"invalid label in {labels}")
            self.check_properties(properties)
            rows.append({"id": self.state.next_node + k, "labels": sorted(labels), "uri": uri, "properties": properties})
        if rows:
            table = catalog.records_table("node", rows, self.spark)
            self.apply(self.state.but(nodes=(*self.state.nodes, table), next_node=self.state.next_node + len(rows)))
        return [r["id"] for r in rows]

    def create_node(self, labels: list[str] | None = None, properties: dict[str, Any] | None = None, uri: str | None = None) -> int:
        return self.create_nodes([(labels or [], properties or {}, uri)])[0]

    @staticmethod
    def check_properties(properties: dict[str, Any]) -> None:
        import datetime as dt

        def good(v: object) -> bool:
            if isinstance(v, (list, tuple)):
                return all(good(x) for x in v)
            if isinstance(v, dict):
                return all(isinstance(k, str) and good(x) for k, x in v.items())
            return v is None or isinstance(v, (bool, int, float, str, dt.date, dt.datetime, dt.time))

        for k, v in properties.items():
            if not isinstance(k, str) or not good(v):
                raise InvalidPropertyError(f"invalid property {k!r}")

    def create_relationships(self, records: Iterable[tuple[int, int, str, dict[str, Any], str | None]]) -> list[int]:
        """Many relationships of (source, target, type, properties, uri); both ends must exist."""
        rows = []
        for k, (src, dst, kind, properties, uri) in enumerate(records):
            self.check_properties(properties)
            rows.append({"id": self.state.next_rel + k, "src": src, "dst": dst, "type": kind, "uri": uri, "properties": properties})
        if not rows:
            return []
        table = catalog.records_table("rel", rows, self.spark)
        ends = table.df.select(F.explode(F.array("src", "dst")).alias("end_id")).distinct()
        ids = self.nodes_frame().select("id")
        lost = ends.join(ids, ends["end_id"] == ids["id"], "left_anti").first()
        if lost is not None:
            raise NodeNotFoundError(f"no node {lost.end_id}")
        self.apply(self.state.but(rels=(*self.state.rels, table), next_rel=self.state.next_rel + len(rows)))
        return [r["id"] for r in rows]

    def create_relationship(self, source: int, target: int, kind: str, properties: dict[str, Any] | None = None, uri: str | None = None) -> int:
        return self.create_relationships([(source, target, kind, properties or {}, uri)])[0]

    def merge_node(self, labels: list[str], match: dict[str, Any], on_create: dict[str, Any] | None = None, on_match: dict[str, Any] | None = None) -> tuple[int, bool]:
        """The first node with the labels and properties, created if there is none; and whether it was."""
        found = self.match_nodes(labels, match, limit=1).select("id").first()
        if found is None:
            return self.create_node(labels, match | (on_create or {})), True
        if on_match:
            self.update_node_properties(found.id, on_match)
        return found.id, False

    # frames
    def frame(self, kind: str, labels: tuple[str, ...] = ()) -> DataFrame:
        tables = self.state.nodes if kind == "node" else self.state.rels
        df, _ = catalog.scan(list(tables), labels, "")
        if df is None:
            system = "id bigint, labels array<string>, uri string" if kind == "node" else "id bigint, src bigint, dst bigint, type string, uri string"
            return self.spark.createDataFrame([], system)
        return df

    def nodes_frame(self, *labels: str) -> DataFrame:
        """id, labels, uri and a column p_<name> for each property."""
        return self.frame("node", labels)

    def relationships_frame(self, *types: str) -> DataFrame:
        return self.frame("rel", types)

    # programmatic reading
    def match_nodes(
        self, labels: list[str] | LabelFilter | None = None, properties: dict | PropertyFilterGroup | None = None, order_by: str | list | SortOrder | None = None, ascending: bool = True, limit: int | None = None, offset: int = 0
    ) -> DataFrame:
        if isinstance(labels, LabelFilter) and labels.mode == "any":
            df = self.nodes_frame()
            low = F.transform("labels", F.lower)
            df = df.where(F.arrays_overlap(low, F.array(*(F.lit(x.lower()) for x in labels.labels))))
        else:
            df = self.nodes_frame(*(labels.labels if isinstance(labels, LabelFilter) else labels or []))
        return self.page(df, "node", properties, order_by, ascending, limit, offset)

    def match_relationships(
        self, source: int | None = None, target: int | None = None, kind: str | None = None, properties: dict | PropertyFilterGroup | None = None, order_by: str | list | SortOrder | None = None, ascending: bool = True, limit: int | None = None, offset: int = 0
    ) -> DataFrame:
        df = self.relationships_frame(*([kind] if kind else []))
        if source is not None:
            df = df.where(F.col("src") == source)
        if target is not None:
            df = df.where(F.col("dst") == target)
        return self.page(df, "rel", properties, order_by, ascending, limit, offset)

    def page(self, df: DataFrame, kind: str, properties: Any, order_by: Any, ascending: bool, limit: int | None, offset: int) -> DataFrame:
        if (limit is not None and limit < 0) or offset < 0:
            raise InvalidFilterError("limit and offset are not negative")
        props = catalog.merged_props(list(self.state.nodes if kind == "node" else self.state.rels))
        props = {k: t for k, t in props.items() if "p_" + k in df.columns}
        if properties:
            df = df.where(condition(properties, props))
        if order_by:
            df = df.orderBy(*order_columns(order_by, ascending, props))
        if offset:
            df = df.offset(offset)
        return df if limit is None else df.limit(limit)

    def get_node(self, node_id: int) -> dict[str, Any] | None:
        r = self.nodes_frame().where(F.col("id") == node_id).first()
        return None if r is None else record(r.asDict(recursive=True))

    def get_relationship(self, rel_id: int) -> dict[str, Any] | None:
        r = self.relationships_frame().where(F.col("id") == rel_id).first()
        return None if r is None else record(r.asDict(recursive=True))

    def get_neighbors(self, node_id: int, direction: str = "both", kind: str | None = None) -> DataFrame:
        """The distinct nodes next to a node."""
        self.require_node(node_id)
        rels = self.relationships_frame(*([kind] if kind else []))
        parts = []
        if direction in ("outgoing", "out", "both"):
            parts.append(rels.where(F.col("src") == node_id).select(F.col("dst").alias("near_id")))
        if direction in ("incoming", "in", "both"):
            parts.append(rels.where(F.col("dst") == node_id).select(F.col("src").alias("near_id")))
        if not parts:
            raise InvalidFilterError(f"unknown direction {direction!r}")
        near = reduce(DataFrame.unionByName, parts)
        nodes = self.nodes_frame()
        return nodes.join(near, nodes["id"] == near["near_id"], "left_semi")

    def require_node(self, node_id: int) -> None:
        if self.nodes_frame().where(F.col("id") == node_id).isEmpty():
            raise NodeNotFoundError(f"no node {node_id}")

    def get_node_count(self, label: str | None = None) -> int:
        return self.nodes_frame(*([label] if label else [])).count()

    def get_relationship_count(self, kind: str | None = None) -> int:
        return self.relationships_frame(*([kind] if kind else [])).count()

    def get_all_labels(self) -> list[str]:
        return sorted(r.x for r in self.nodes_frame().select(F.explode("labels").alias("x")).distinct().collect())

    def get_all_relationship_types(self) -> list[str]:
        return sorted(r.type for r in self.relationships_frame().select("type").distinct().collect())

    # changes
    def _patch(self, kind: str, entity_id: int, properties: dict[str, Any], clear: bool) -> None:
        from trellis.cypher.writes import patched, storable
        from trellis.cypher.values import literal

        self.check_properties(properties)
        frame = self.nodes_frame() if kind == "node" else self.relationships_frame()
        if frame.where(F.col("id") == entity_id).isEmpty():
            raise (NodeNotFoundError if kind == "node" else RelationshipNotFoundError)(f"no {kind} {entity_id}")
        patch = self.spark.range(1).select(F.lit(entity_id).cast("bigint").alias("patch_id"))
        change = {k: storable(literal(v)) for k, v in properties.items()}
        for k, v in change.items():
            v.col_name = "set_" + k  # type: ignore[attr-defined]
            patch = patch.withColumn("set_" + k, v.col)
        self.apply(patched(self.state, kind, patch, change, clear=clear))

    def update_node_properties(self, node_id: int, properties: dict[str, Any]) -> None:
        self._patch("node", node_id, properties, False)

    def replace_node_properties(self, node_id: int, properties: dict[str, Any]) -> None:
        self._patch("node", node_id, properties, True)

    def update_relationship_properties(self, rel_id: int, properties: dict[str, Any]) -> None:
        self._patch("rel", rel_id, properties, False)

    def replace_relationship_properties(self, rel_id: int, properties: dict[str, Any]) -> None:
        self._patch("rel", rel_id, properties, True)

    def _labels(self, node_id: int, new: Any) -> None:
        from trellis.cypher.writes import patched

        self.require_node(node_id)
        patch = self.spark.range(1).select(F.lit(node_id).cast("bigint").alias("patch_id"))
        self.apply(patched(self.state, "node", patch, {}, labels=new))

    def add_labels(self, node_id: int, labels: list[str]) -> None:
        self._labels(node_id, F.array_sort(F.array_union("labels", F.array(*(F.lit(x) for x in labels)))))

    def remove_labels(self, node_id: int, labels: list[str]) -> None:
        low = [x.lower() for x in labels]
        self._labels(node_id, F.filter("labels", lambda x: ~F.lower(x).isin(*low)))

    def delete_node(self, node_id: int) -> bool:
        from trellis.cypher.writes import without_nodes

        if self.nodes_frame().where(F.col("id") == node_id).isEmpty():
            return False
        self.apply(without_nodes(self.state, self.spark.range(1).select(F.lit(node_id).cast("bigint").alias("gone_id"))))
        return True

    def delete_relationship(self, rel_id: int) -> bool:
        if self.relationships_frame().where(F.col("id") == rel_id).isEmpty():
            return False
        self.apply(self.state.but(rels=tuple(t.but(t.df.where(F.col("id") != rel_id)) for t in self.state.rels)))
        return True

    # paths
    def find_shortest_path(self, source: int, target: int) -> list[int] | None:
        return traversal.find_shortest_path(self, source, target)

    def find_path(self, source: int, target: int, max_depth: int | None = None) -> list[int] | None:
        return traversal.find_path(self, source, target, max_depth)

    def find_all_paths(self, source: int, target: int, max_depth: int | None = None) -> DataFrame:
        return traversal.find_all_paths(self, source, target, max_depth)

    # full-text search: an index is a list of properties; its content is computed from the snapshot
    def create_text_index(self, entity: str, label: str | None, props: list[str] | str, weight: float = 1.0) -> None:
        entry = {"entity": entity, "label": label, "props": [props] if isinstance(props, str) else list(props), "weight": weight}
        kept = [x for x in self.state.texts.get("indexes", []) if (x["entity"], x["label"]) != (entity, label)]
        self.state = self.state.but(texts=self.state.texts | {"indexes": [*kept, entry]})

    def drop_text_index(self, entity: str, label: str | None) -> bool:
        before = self.state.texts.get("indexes", [])
        kept = [x for x in before if (x["entity"], x["label"]) != (entity, label)]
        self.state = self.state.but(texts=self.state.texts | {"indexes": kept})
        return len(kept) < len(before)

    def list_text_indexes(self) -> list[dict]:
        return list(self.state.texts.get("indexes", []))

    def text_content(self) -> DataFrame:
        """entity_type, entity_id, label_type, content: one row per node and label, or per relationship."""
        parts = []
        for x in self.list_text_indexes():
            df = self.frame(x["entity"] if x["entity"] == "node" else "rel", (x["label"],) if x["label"] else ())
            words = [ref("p_" + p).cast("string") for p in x["props"] if "p_" + p in df.columns]
            content = F.concat_ws(" ", *words) if words else F.lit("")
            label = F.explode("labels") if x["entity"] == "node" else F.col("type")
            part = df.select(F.lit(x["entity"]).alias("entity_type"), F.col("id").alias("entity_id"), label.alias("label_type"), content.alias("content"))
            if x["label"]:
                part = part.where(F.lower("label_type") == x["label"].lower())
            parts.append(part.where(F.col("content") != ""))
        if not parts:
            return self.spark.createDataFrame([], "entity_type string, entity_id bigint, label_type string, content string")
        return reduce(DataFrame.unionByName, parts)

    def text_search(self, query: str, k: int | None = None, labels: list[str] | None = None, rel_types: list[str] | None = None) -> DataFrame:
        """entity_type, entity_id, label_type, score; the lower the better. Labels alone leave nodes only, types alone relationships only."""
        docs = self.text_content()
        if labels or rel_types:
            tests = []
            for kind, names in (("node", labels), ("relationship", rel_types)):
                if names:
                    tests.append((F.col("entity_type") == kind) & F.lower("label_type").isin(*[x.lower() for x in names]))
            docs = docs.where(reduce(lambda a, b: a | b, tests))
        found = search.bm25(docs, ["entity_type", "entity_id", "label_type"], "content", query, k or self.top_k, positive_idf=False)
        return found.withColumn("score", -F.col("score"))

    def register_text_index(self, name: str, index: search.TextIndex | None = None) -> search.TextIndex:
        """A named index of other documents, for text_search_custom."""
        self.text_indexes[name] = index or search.TextIndex(self.spark)
        return self.text_indexes[name]

    def text_search_custom(self, query: str, k: int | None = None, index: str = "default") -> DataFrame:
        if index not in self.text_indexes:
            raise TrellisError(f"no text index {index}")
        return self.text_indexes[index].search(query, k or self.top_k)

    # vectors
    def embed_nodes(self, index: str, props: list[str], *labels: str) -> None:
        """Vectors of nodes from their properties' text, by the index's embedding function."""
        df = self.nodes_frame(*labels)
        words = F.concat_ws(" ", *(ref("p_" + p).cast("string") for p in props if "p_" + p in df.columns))
        self.upsert_embeddings(index, df.select(F.col("id").alias("node_id"), embedding.embed(words, self.embedder(index)).alias("vector")))

    def embedder(self, index: str) -> Callable:
        given = self.vector_index(index)["embedder"]
        f = given if callable(given) else self.embedders.get(str(given))
        if f is None:
            raise TrellisError(f"vector index {index} has no embedding function")
        return f

    def save_vector_index(self, name: str, folder: str) -> None:
        if self.vector_index(name)["df"] is not None:
            self.vector_index(name)["df"].write.mode("overwrite").parquet(f"{folder}/{name}")

    def load_vector_index(self, name: str, folder: str) -> None:
        self.vector_index(name)
        self.state = self.state.but(vectors=self.state.vectors | {name: self.state.vectors[name] | {"df": self.spark.read.parquet(f"{folder}/{name}")}})

    def create_vector_index(self, name: str, dim: int, metric: str = "cosine", default_k: int | None = None, embedder: Callable | str | None = None, if_not_exists: bool = False) -> None:
        if name in self.state.vectors:
            if if_not_exists:
                return
            raise TrellisError(f"vector index {name} exists")
        if dim < 1 or metric not in ("cosine", "l2", "ip"):
            raise TrellisError("a vector index needs a dimension and a metric of cosine, l2 or ip")
        entry = {"dim": dim, "metric": metric, "default_k": default_k, "embedder": embedder, "df": None}
        self.state = self.state.but(vectors=self.state.vectors | {name: entry})

    def drop_vector_index(self, name: str) -> None:
        self.vector_index(name)
        self.state = self.state.but(vectors={k: v for k, v in self.state.vectors.items() if k != name})

    def list_vector_indexes(self) -> list[str]:
        return sorted(self.state.vectors)

    def vector_index(self, name: str) -> dict:
        if name not in self.state.vectors:
            raise TrellisError(f"no vector index {name}")
        return self.state.vectors[name]

    def upsert_embeddings(self, name: str, entries: DataFrame | list[tuple[int, list[float]]]) -> None:
        """(node_id, vector) rows; a node's later vector replaces its earlier one."""
        entry = self.vector_index(name)
        if isinstance(entries, list):
            if any(len(v) != entry["dim"] for _, v in entries):
                raise TrellisError(f"vectors of {name} have {entry['dim']} dimensions")
            entries = self.spark.createDataFrame([(i, [float(x) for x in v]) for i, v in dict(entries).items()], "node_id bigint, vector array<double>")
        entries = entries.select(F.col("node_id").cast("bigint").alias("node_id"), F.col("vector").cast("array<double>").alias("vector"))
        old = entry["df"]
        df = entries if old is None else old.join(entries, "node_id", "left_anti").unionByName(entries)
        self.state = self.state.but(vectors=self.state.vectors | {name: entry | {"df": df, "lists": None}})

    def build_vector_index(self, name: str, lists: int = 100) -> None:
        """Sorts the vectors into inverted lists for approximate search; later changes of the vectors drop the lists."""
        entry = self.vector_index(name)
        if entry["df"] is None:
            raise TrellisError(f"vector index {name} is empty")
        index, centroids = search.inverted_lists(entry["df"], "node_id", "vector", lists)
        self.state = self.state.but(vectors=self.state.vectors | {name: entry | {"lists": (cut(index), centroids)}})

    def remove_embeddings(self, name: str, ids: list[int]) -> None:
        entry = self.vector_index(name)
        if entry["df"] is not None:
            self.state = self.state.but(vectors=self.state.vectors | {name: entry | {"df": entry["df"].where(~F.col("node_id").isin(*ids)), "lists": None}})

    def register_embedder(self, name: str, f: Callable[[list[str]], list[list[float]]]) -> None:
        self.embedders[name] = f

    def register_reranker(self, name: str, f: Callable[[list[float], list[dict]], list]) -> None:
        self.rerankers[name] = f

    def semantic_search(
        self, query: list[float] | str, k: int | None = None, index: str = "default", labels: LabelFilter | None = None, properties: Any = None, rerank: bool = False, reranker: str | None = None, candidate_multiplier: int = 4, probes: int | None = None
    ) -> DataFrame:
        """node_id and score of the k nearest existing nodes, the candidates filtered before they are scored.

        Exact, unless the index has lists (build_vector_index) and `probes` says how many of them to search.
        """
        entry = self.vector_index(index)
        k = k or entry["default_k"] or self.top_k
        if isinstance(query, str):
            query = self.embedder(index)([query])[0]
        if len(query) != entry["dim"]:
            raise TrellisError(f"vectors of {index} have {entry['dim']} dimensions")
        vectors = entry["df"]
        if vectors is None:
            return self.spark.createDataFrame([], "node_id bigint, score double")
        if probes is not None:
            if entry.get("lists") is None:
                raise TrellisError(f"vector index {index} has no lists; build_vector_index makes them")
            vectors = search.probed(*entry["lists"], query, probes)
        nodes = self.match_nodes(labels, properties).select("id")
        vectors = vectors.join(nodes, vectors["node_id"] == nodes["id"], "left_semi")
        if reranker is not None:
            top = search.nearest(vectors, "node_id", "vector", query, k * candidate_multiplier, entry["metric"])
            rows = top.join(vectors, "node_id").collect()  # at most k * candidate_multiplier
            given = self.rerankers[reranker](query, [{"id": r.node_id, "score": r.score, "vector": r.vector} for r in sorted(rows, key=lambda r: -r.score)])
            pairs = [(x["id"], float(x["score"])) if isinstance(x, dict) else (x[0], float(x[1])) for x in given]
            return self.spark.createDataFrame(sorted(pairs, key=lambda p: -p[1])[:k], "node_id bigint, score double")
        return search.nearest(vectors, "node_id", "vector", query, k, entry["metric"], rerank)

    # indexes and constraints: a catalogue; Parquet statistics and bucketing do an index's work
    def create_index(self, entity: str, label: str | None, prop: str, unique: bool = False) -> Index:
        name = "_".join(x for x in ("idx", entity, label, prop) if x).lower()
        index = Index(name, entity, label, prop, unique)
        if unique and label:
            self.check_constraint(Constraint(name, entity, label, prop, "unique"), self.state)
        if all(i.name != name for i in self.state.indexes):
            self.state = self.state.but(indexes=(*self.state.indexes, index))
        return index

    def drop_index(self, name: str, if_exists: bool = False) -> bool:
        left = tuple(i for i in self.state.indexes if i.name != name.lower())
        dropped = len(left) < len(self.state.indexes)
        if not dropped and not if_exists:
            raise TrellisError(f"no index {name}")
        self.state = self.state.but(indexes=left)
        return dropped

    def list_indexes(self) -> list[Index]:
        return list(self.state.indexes)

    def create_node_index(self, label: str, prop: str, unique: bool = False) -> Index:
        return self.create_index("node", label, prop, unique)

    def create_relationship_index(self, kind: str, prop: str, unique: bool = False) -> Index:
        return self.create_index("relationship", kind, prop, unique)

    def create_uniqueness_constraint(self, entity: str, label: str, prop: str) -> Constraint:
        return self.create_constraint(entity, label, prop, "unique")

    def create_existence_constraint(self, entity: str, label: str, prop: str) -> Constraint:
        return self.create_constraint(entity, label, prop, "exists")

    def create_type_constraint(self, entity: str, label: str, prop: str, type_: str) -> Constraint:
        return self.create_constraint(entity, label, prop, "type", type_)

    def create_constraint(self, entity: str, label: str, prop: str, kind: str, type_: str | None = None, name: str | None = None) -> Constraint:
        if kind == "type" and type_ not in ("STRING", "INTEGER", "FLOAT", "BOOLEAN", "LIST", "MAP"):
            raise ConstraintError(f"unknown type {type_}")
        c = Constraint((name or f"constraint_{entity}_{label}_{prop}_{kind}").lower(), entity, label, prop, kind, type_)
        self.check_constraint(c, self.state)
        if all(x.name != c.name for x in self.state.constraints):
            self.state = self.state.but(constraints=(*self.state.constraints, c))
        return c

    def drop_constraint(self, name: str, if_exists: bool = False) -> bool:
        left = tuple(c for c in self.state.constraints if c.name != name.lower())
        dropped = len(left) < len(self.state.constraints)
        if not dropped and not if_exists:
            raise TrellisError(f"no constraint {name}")
        self.state = self.state.but(constraints=left)
        return dropped

    def list_constraints(self) -> list[Constraint]:
        return list(self.state.constraints)

    def check_constraint(self, c: Constraint, state: State) -> None:
        tables = [t for t in (state.nodes if c.entity == "node" else state.rels) if t.may_have((c.label,))]
        if not tables:
            return
        df, props = catalog.scan(tables, (c.label,), "")
        assert df is not None
        df = df.where(F.array_contains("labels", c.label)) if c.entity == "node" else df.where(F.col("type") == c.label)
        name = "p_" + c.property
        if c.property not in props:
            if c.kind != "unique" and not df.isEmpty():
                raise ConstraintError(f"{c.name}: {c.property} is missing")
            return
        value = ref(name)
        if c.kind == "unique":
            key = F.to_json(value) if catalog.family(props[c.property]) in ("variant", "map") else value
            bad = df.where(value.isNotNull()).groupBy(key.alias("k")).count().where("count > 1")
        elif c.kind == "exists":
            bad = df.where(value.isNull())
        else:
            wanted = {"STRING": ("string",), "INTEGER": ("number",), "FLOAT": ("number",), "BOOLEAN": ("boolean",), "LIST": ("list",), "MAP": ("map",)}[str(c.type)]
            fam = catalog.family(props[c.property])
            if fam == "variant":
                shape = {"STRING": "^STRING$", "INTEGER": "^(BIGINT|INT)", "FLOAT": "^(DOUBLE|FLOAT|DECIMAL)", "BOOLEAN": "^BOOLEAN$", "LIST": "^ARRAY", "MAP": "^OBJECT"}[str(c.type)]
                bad = df.where(value.isNull() | ~F.schema_of_variant(value).rlike(shape))
            else:
                whole = props[c.property].typeName() in ("long", "bigint")
                fits = fam in wanted and (c.type != "INTEGER" or whole) and (c.type != "FLOAT" or not whole)
                bad = df.where(value.isNull()) if fits else df
        if not bad.isEmpty():
            raise ConstraintError(f"{c.name} is violated")


def python_value(v: Any) -> Any:
    """Dynamic values as Python's, at any depth."""
    if hasattr(v, "toPython"):
        return v.toPython()
    if isinstance(v, list):
        return [python_value(x) for x in v]
    return {k: python_value(x) for k, x in v.items()} if isinstance(v, dict) else v


def record(row: dict[str, Any]) -> dict[str, Any]:
    """A row of a frame as a record with its non-null properties."""
    out = {k: v for k, v in row.items() if not k.startswith("p_")}
    out["properties"] = {k[2:]: python_value(v) for k, v in row.items() if k.startswith("p_") and v is not None}
    return out
