"""Paths between two nodes by breadth-first levels of joins."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.tables import cut

if TYPE_CHECKING:
    from trellis.graph import Graph


def edges(graph: Graph, direction: str = "out") -> DataFrame:
    rels = graph.relationships_frame().select("src", "dst")
    back = rels.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return rels if direction == "out" else back if direction == "in" else rels.unionByName(back)


def find_shortest_path(graph: Graph, source: int, target: int, max_depth: int | None = None) -> list[int] | None:
    """Ids along a shortest outgoing path, or None; of several the one with the smallest ids. Ends with the frontier."""
    graph.require_node(source)
    graph.require_node(target)
    if source == target:
        return [source]
    spark = graph.spark
    links = edges(graph).distinct()
    front = spark.range(1).select(F.lit(source).cast("bigint").alias("at"), F.array(F.lit(source).cast("bigint")).alias("path"))
    seen = front.select(F.col("at").alias("old"))
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = front.join(links, front["at"] == links["src"]).select(F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"))
        step = step.groupBy("at").agg(F.min("path").alias("path"))
        front = cut(step.join(seen, step["at"] == seen["old"], "left_anti"))
        hit = front.where(F.col("at") == target).first()
        if hit is not None:
            return list(hit.path)
        if front.isEmpty():
            return None
        seen = cut(seen.unionByName(front.select(F.col("at").alias("old"))))
    return None


def find_path(graph: Graph, source: int, target: int, max_depth: int | None = None) -> list[int] | None:
    """Some simple path, of at most max_depth steps if given: a shortest one."""
    return find_shortest_path(graph, source, target, max_depth)


def find_all_paths(graph: Graph, source: int, target: int, max_depth: int | None = None) -> DataFrame:
    """A column `path` of all simple paths, of at most max_depth steps if given, that stop at the target. Ends with the frontier."""
    graph.require_node(source)
    graph.require_node(target)
    links = edges(graph)
    now = graph.spark.range(1).select(F.array(F.lit(source).cast("bigint")).alias("path"))
    if source == target:
        return now
    found = []
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = now.join(links, F.element_at("path", -1) == links["src"]).where(~F.array_contains("path", F.col("dst")))
        now = cut(step.select(F.concat("path", F.array("dst")).alias("path")))
        found.append(now.where(F.element_at("path", -1) == target))
        now = now.where(F.element_at("path", -1) != target)
        if now.isEmpty():
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def reachable(graph: Graph, source: int, max_depth: int, direction: str = "out") -> DataFrame:
    """node_id and depth (its least number of steps) of every node within reach."""
    graph.require_node(source)
    links = edges(graph, direction).distinct()
    front = graph.spark.range(1).select(F.lit(source).cast("bigint").alias("node_id"), F.lit(0).alias("depth"))
    seen = front
    for depth in range(1, max_depth + 1):
        step = front.join(links, front["node_id"] == links["src"]).select(F.col("dst").alias("node_id")).distinct()
        front = cut(step.join(seen, "node_id", "left_anti").select("node_id", F.lit(depth).alias("depth")))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen
