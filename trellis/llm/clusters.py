"""Clusters of mutually similar vectors by hierarchical density clustering, with size and most typical members.

Exact copies are one weighted vertex, named by a 64-bit hash of index and vector. The cells of the k-means tree, each
of which also holds the vectors within a margin (LINKS cells a vector on average, as the links need only join what the check below settles), give the mutual-reachability graph of the vertices' neighbours, each cell only the
edges of its own minimum spanning forest (no other edge can be in the whole one). Borůvka's first rounds go on inside the cells, for
components of vertices that are in no other cell, whose least edge there is the least of all. The further rounds over
DataFrames make the minimum spanning forest of all cells: every component takes its least edge, components hook on to each other,
pointers are doubled, edges contracted; what at most AT_ONCE edges are left of is finished in one task by the same rounds. The
forest's components go in buckets of bounded size through the condensed hierarchy and the stability-based selection, which give
each vertex its cluster and persistence. A component is never cut, whatever its size: it goes whole through one task, in flat arrays.

The definition's exact check over all vectors follows. Clusters begin with the mean of their most persistent
members; those that don't have MIN_SIZE vectors near enough go, those of too similar means are joined (Borůvka's rounds
over the means), means are taken anew from all members, and each vector stays in its cluster, or comes into one, if it is near enough to
that mean and nearer than to any other. The vectors that no mean took go through further passes over trees of their own,
until a pass finds no further cluster.

Defined results: unusable and outdated vectors are no members (see vectors.py); an index with fewer vectors
than MIN_SIZE has no cluster; a vector equally near two means goes to the first in order of its numbers.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm import vectors as V
from trellis.tables import discard, written

NEIGHBOURS = 10
CORE = 5
LINKS = 1.5  # cells a vector, on average
MIN_SIZE = 8
CLOSEST = 0.15  # distances below this count alike, so that a few copies do not outweigh a cluster
LEAST_TO_MEAN = 0.65
LOOSE_LINK = (MIN_SIZE * LEAST_TO_MEAN**2 - 1) / (MIN_SIZE - 1)  # the least similarity of a link: that of MIN_SIZE equally spread members at LEAST_TO_MEAN
LEAST_OF_MEANS = 0.4
EXEMPLARS = 5
TYPICAL = 32  # most persistent members that a cluster's first mean is taken from
AT_ONCE = 1 << 17  # edges
BUCKET = 1 << 16  # vertices
MOST = 1 << 18  # vertices of a component, for _parts()
MEANS_PER_PASS = 20_000
HEAVY, SALTS = 1000, 32  # a vertex of a thousandth of all rows is joined over salts
VERTEX, EDGE, BORDER = 0, 1, 2  # kinds of graph rows
GRAPH = "index_name string, kind int, a bigint, b bigint, w double, comp bigint, other bigint, ids array<bigint>"
LABEL = "index_name string, v bigint, cluster bigint, persistence double, place int, weight bigint, ids array<bigint>"


def spanning_forest(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Edges of the minimum spanning forest, by Borůvka's rounds; ties by position."""
    order = np.lexsort((np.arange(len(w)), w))
    a, b = a[order], b[order]
    comp = np.arange(n)
    chosen = np.zeros(len(a), bool)
    live = np.arange(len(a))
    while True:
        ca, cb = comp[a[live]], comp[b[live]]
        cross = ca != cb
        live, ca, cb = live[cross], ca[cross], cb[cross]
        if not len(live):
            return order[chosen]
        least = np.full(n, len(a))
        np.minimum.at(least, ca, live)
        np.minimum.at(least, cb, live)
        heads = np.flatnonzero(least < len(a))
        picks = least[heads]
        chosen[picks] = True
        hook = np.arange(n)
        hook[heads] = comp[a[picks]] + comp[b[picks]] - heads
        mutual = hook[hook[heads]] == heads
        hook[heads[mutual]] = np.minimum(heads[mutual], hook[heads[mutual]])
        while True:
            up = hook[hook]
            if (up == hook).all():
                break
            hook = up
        comp = hook[comp]


def contracted(n: int, a: np.ndarray, b: np.ndarray, closed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Borůvka's rounds over edges in ascending order for the components without a closed vertex: which edges are taken, and each vertex's component.

    A component with a closed vertex takes no edge of its own, so it has one closed vertex and is named by it.
    """
    comp, chosen, live = np.arange(n), np.zeros(len(a), bool), np.arange(len(a))
    while True:
        ca, cb = comp[a[live]], comp[b[live]]
        cross = ca != cb
        live, ca, cb = live[cross], ca[cross], cb[cross]
        least = np.full(n, len(a))
        np.minimum.at(least, ca, live)
        np.minimum.at(least, cb, live)
        heads = np.flatnonzero((least < len(a)) & ~closed)
        if not len(heads):
            return chosen, comp
        picks = least[heads]
        chosen[picks] = True
        hook = np.arange(n)
        hook[heads] = comp[a[picks]] + comp[b[picks]] - heads
        mutual = hook[hook[heads]] == heads
        hook[heads[mutual]] = np.minimum(heads[mutual], hook[heads[mutual]])
        while True:
            up = hook[hook]
            if (up == hook).all():
                break
            hook = up
        comp = hook[comp]


def condensed(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, min_size: int, widest: float, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Selected cluster (or -1) and persistence of each vertex, from forest edges in ascending order of w; a vertex counts as `weight` copies."""
    root = array("q", range(n))
    members: dict[int, list[int]] = {}
    copies = np.ones(n, np.int64) if weight is None else weight
    size = array("q", copies.tolist())
    cluster = array("q", [-1]) * n  # of a component's root
    joined, reached = array("q", [-1]) * n, array("d", [0.0]) * n  # the cluster and level at which a vertex comes in
    # per cluster: sum of the members' death levels, members, children, parent, stability
    deaths, count, stability, parent = array("d"), array("q"), array("d"), array("q")
    children: dict[int, tuple[int, int]] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def born(held: int, level: float) -> int:
        deaths.append(held * level)
        count.append(held)
        stability.append(0.0)
        parent.append(-1)
        return len(count) - 1

    for x in np.flatnonzero(copies >= min_size).tolist():  # copies enough to be a cluster
        cluster[x] = joined[x] = born(size[x], 1.0 / CLOSEST)
        reached[x] = 1.0 / CLOSEST
    for at in range(0, len(a), 1 << 16):
        part = slice(at, at + (1 << 16))
        for i, j, d in zip(a[part].tolist(), b[part].tolist(), w[part].tolist(), strict=True):
            p, q = find(i), find(j)
            if size[p] < size[q]:
                p, q = q, p
            level = 1.0 / max(d, CLOSEST)
            cp, cq = cluster[p], cluster[q]
            if cp >= 0 and cq >= 0:
                for c in (cp, cq):
                    stability[c] = deaths[c] - count[c] * level
                cluster[p] = parent[cp] = parent[cq] = born(count[cp] + count[cq], level)
                children[cluster[p]] = (cp, cq)
            else:
                own = members.pop(q, None) or [q]
                if cp >= 0:
                    deaths[cp] += size[q] * level
                    count[cp] += size[q]
                else:
                    own += members.pop(p, None) or [p]
                    if size[p] + size[q] >= min_size:
                        cp = cluster[p] = born(size[p] + size[q], level)
                if cp >= 0:
                    for x in own:
                        joined[x], reached[x] = cp, level
                else:
                    members[p] = own
            root[q] = p
            size[p] += size[q]
    best, keep = array("d", stability), [True] * len(count)
    for c in range(len(count)):  # children come before their parents
        if parent[c] < 0:
            stability[c] = best[c] = deaths[c] - count[c] / widest
        if c in children:
            below = sum(best[x] for x in children[c])
            if below > stability[c]:
                best[c], keep[c] = below, False
    chosen = np.full(len(count) + 1, -1)  # the last one is for vertices without a cluster
    for c in range(len(count) - 1, -1, -1):
        above = chosen[parent[c]] if parent[c] >= 0 else -1
        chosen[c] = above if above >= 0 else c if keep[c] else -1
    return chosen[np.array(joined, np.int64)], np.array(reached, np.float64)


def mutual_graph(x: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS, core: int = CORE, least_link: float = LOOSE_LINK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (a, b, distance) of the mutual-reachability graph of each row's neighbours; a row counts as `weight` copies."""
    n = len(x)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    near, sims = V.search(x, x, np.arange(n), min(k, n - 1), recall=0.9)
    far = 1 - np.clip(sims, -1, 1)
    within = weight[:, None] - 1 + np.cumsum(np.where(near >= 0, weight[near], 1), axis=1)  # companions up to each neighbour
    at = np.minimum((within < core).sum(axis=1), far.shape[1] - 1)
    reach = np.where(weight > core, 0, far[np.arange(n), at])
    a, b = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    w = np.maximum(np.maximum(reach[a], reach[np.maximum(b, 0)]), far.ravel())
    good = (b >= 0) & (w <= 1 - least_link)
    return a[good], b[good], w[good]


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """index_name, v, vec, places, weight, ids (the least ones): the copies in a batch as one row."""
    for b in batches:
        names, ids, v, vec, places = b.columns
        group = V.copies(names, vec)
        order = np.lexsort((ids.to_numpy(), group))
        starts = np.flatnonzero(np.r_[True, np.diff(group[order]) > 0]) if len(order) else np.zeros(0, np.int64)
        weight = np.diff(np.r_[starts, len(order)])
        first = pa.array(order[starts])
        few = np.minimum(weight, EXEMPLARS)
        at = np.repeat(starts - (np.cumsum(few) - few), few) + np.arange(few.sum())
        least = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(few)].astype(np.int32)), ids.take(pa.array(order[at])))
        half = pa.array([np.frombuffer(x, np.float32).astype(np.float16).tobytes() for x in vec.take(first).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([names.take(first), v.take(first), half, places.take(first), pa.array(weight), least], ["index_name", "v", "vec", "places", "weight", "ids"])


def _graph(t: pa.Table) -> pa.Table:
    """A cell's vertices (w: the number of copies) where it is their home, and its spanning forest: edges of the whole forest, and border edges between components."""
    v = t.column("v").to_numpy()
    name, first, group = np.unique(v, return_index=True, return_inverse=True)
    weight = np.bincount(group, t.column("weight").to_numpy()).astype(np.int64)
    ids: list[list[int]] = [[] for _ in name]
    for g, own in zip(group.tolist(), t.column("ids").to_pylist(), strict=True):
        ids[g] = sorted(ids[g] + own)[:EXEMPLARS]
    half = b"".join(t.column("vec").take(pa.array(first)).to_pylist())
    x = V.unit_rows(np.frombuffer(half, np.float16).astype(np.float32).reshape(len(first), -1)) if len(first) else np.zeros((0, 1), np.float32)
    a, b, w = mutual_graph(x, weight)
    a, b = np.minimum(a, b), np.maximum(a, b)  # names are in ascending order
    order = np.lexsort((b, a, w))  # the order of all edges, which all cells and rounds agree on
    a, b, w = a[order], b[order], w[order]
    kept = np.sort(spanning_forest(len(name), a, b, w))
    a, b, w = a[kept], b[kept], w[kept]
    taken, comp = contracted(len(name), a, b, ~t.column("alone").to_numpy()[first])
    comp = name[comp] if len(name) else comp
    home, inner, border = np.flatnonzero(t.column("is_home").to_numpy()[first]), np.flatnonzero(taken), np.flatnonzero(~taken)
    size = [len(home), len(inner), len(border)]
    n = sum(size)
    kind = np.repeat([VERTEX, EDGE, BORDER], size)
    index = t.column("index_name")[0].as_py() if t.num_rows else None
    none = np.zeros(len(home), np.int64)
    return pa.Table.from_arrays(
        [
            pa.array([index] * n, pa.string()),
            pa.array(kind, pa.int32()),
            pa.array(np.concatenate([name[home], name[a[inner]], name[a[border]]])),
            pa.array(np.concatenate([none, name[b[inner]], name[b[border]]]), mask=kind == VERTEX),
            pa.array(np.concatenate([weight[home].astype(float), w[inner], w[border]])),
            pa.array(np.concatenate([comp[home], comp[a[inner]], comp[a[border]]])),
            pa.array(np.concatenate([none, comp[b[inner]], comp[b[border]]]), mask=kind != BORDER),
            pa.array([ids[r] for r in home.tolist()] + [None] * (n - len(home)), pa.list_(pa.int64())),
        ],
        names=[f.split()[0] for f in GRAPH.split(", ")],
    )


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last rounds over few contracted edges: forest edges (a, b, w, own), then roots (a, b) with no w."""
    held = list(batches)
    t = pa.Table.from_batches(held) if held else None
    if t is None or not t.num_rows:
        return
    ca, cb, a, b, w, own = (t.column(c).to_numpy() for c in ("ca", "cb", "a", "b", "w", "own"))
    order = np.lexsort((b, a, w))  # ties as in the rounds before
    names, ends = np.unique(np.concatenate([ca, cb]), return_inverse=True)
    p, q = ends[: len(ca)][order], ends[len(ca) :][order]
    taken, comp = contracted(len(names), p, q, np.zeros(len(names), bool))
    kept = order[taken]
    n, m = len(kept), len(names)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([a[kept], names])),
            pa.array(np.concatenate([b[kept], names[comp]])),
            pa.array(np.concatenate([w[kept], np.zeros(m)]), mask=np.arange(n + m) >= n),
            pa.array(np.concatenate([own[kept], names])),
        ],
        ["a", "b", "w", "own"],
    )


def forest(edges: DataFrame, at_once: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Borůvka's rounds over edges (a < b, w) between components (ca, cb): the edges taken (a, b, w, own: a component they began in), and each component's last one (v, comp).

    Equal distances are ordered by the edges' ends, so all components agree on one order and no cycle arises.
    """
    at_once = at_once or AT_ONCE
    pairs = edges.groupBy(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).agg(F.min(F.struct("w", "a", "b")).alias("e"))
    live = written(pairs.select("ca", "cb", "e.a", "e.b", "e.w", F.col("ca").alias("own")))
    taken: list[DataFrame] = []
    comps: DataFrame | None = None
    while live.count() > at_once:
        before = live
        sides = [live.select(F.col(c).alias("c"), F.struct("w", "a", "b", F.col(o).alias("p"), "own").alias("e")) for c, o in (("ca", "cb"), ("cb", "ca"))]
        picks = written(sides[0].unionByName(sides[1]).groupBy("c").agg(F.min("e").alias("e")).select("c", "e.*"))
        taken.append(picks.select("a", "b", "w", "own").distinct())
        up = picks.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        # two components that chose the same edge: the lesser one is the root
        roots = written(picks.select("c", "p").join(up, "p").select("c", F.when(F.col("pp") == F.col("c"), F.least("c", "p")).otherwise(F.col("p")).alias("p")))
        while True:
            above = roots.select(F.col("c").alias("p"), F.col("p").alias("pp"))
            jumped = written(roots.join(above, "p").select("c", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
            roots = jumped.select("c", "p")
            if jumped.where("moved").isEmpty():
                break
        comps = _renamed(comps, roots)
        for end in ("ca", "cb"):
            live = live.join(roots.select(F.col("c").alias(end), F.col("p").alias("_" + end)), end).drop(end).withColumnRenamed("_" + end, end)
        pairs = live.where(F.col("ca") != F.col("cb")).groupBy(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb"))
        live = written(pairs.agg(F.min(F.struct("w", "a", "b", "own")).alias("e")).select("ca", "cb", "e.a", "e.b", "e.w", "e.own"))
        discard(before)
    last = written(live.repartition(1).mapInArrow(_finish, "a bigint, b bigint, w double, own bigint"))  # bound: at_once edges
    taken.append(last.where("w IS NOT NULL"))
    comps = _renamed(comps, last.where("w IS NULL").select(F.col("a").alias("c"), F.col("b").alias("p")))
    return reduce(DataFrame.unionByName, taken), comps


def _renamed(comps: DataFrame | None, roots: DataFrame) -> DataFrame:
    """Components of the vertices after a further round."""
    if comps is None:
        return roots.select(F.col("c").alias("v"), F.col("p").alias("comp"))
    return written(comps.join(roots.select(F.col("c").alias("comp"), "p"), "comp", "left").select("v", F.coalesce("p", "comp").alias("comp")))


def _condense(t: pa.Table) -> pa.Table:
    """Cluster and persistence of the vertices of some whole components, and their place among their cluster's most persistent members."""
    is_edge = t.column("kind").to_numpy() != VERTEX
    vertices = t.select(["index_name", "a", "w", "ids"]).filter(pa.array(~is_edge)).sort_by("a")
    v, weight = vertices.column("a").to_numpy(), vertices.column("w").to_numpy().astype(np.int64)
    e = t.select(["a", "b", "w"]).filter(pa.array(is_edge))
    a, b, w = (e.column(c).to_numpy() for c in ("a", "b", "w"))
    order = np.lexsort((b, a, w))
    label, persistence = condensed(len(v), np.searchsorted(v, a[order]), np.searchsorted(v, b[order]), w[order], MIN_SIZE, 1 - LOOSE_LINK, weight)
    own = np.flatnonzero(label >= 0)
    own = own[np.lexsort((v[own], -persistence[own], label[own]))]
    starts = np.flatnonzero(np.r_[True, np.diff(label[own]) > 0]) if len(own) else np.zeros(0, np.int64)
    size = np.diff(np.r_[starts, len(own)])
    place = np.arange(len(own)) - np.repeat(starts, size)
    cluster = np.repeat(np.minimum.reduceat(v[own], starts), size) if len(own) else np.zeros(0, np.int64)
    at = pa.array(own)
    return pa.Table.from_arrays(
        [vertices.column("index_name").take(at), pa.array(v[own]), pa.array(cluster), pa.array(persistence[own]), pa.array(place, pa.int32()), pa.array(weight[own]), vertices.column("ids").take(at)],
        names=[f.split()[0] for f in LABEL.split(", ")],
    )


def _parts(rows: DataFrame, most: int) -> DataFrame:
    """Graph rows with components of at most `most` vertices: too large ones lose a fifth of their edges, the longest, at a time.

    No query cuts components any more, as labels would depend on the input's size.
    """
    turn = 0
    while True:
        turn += 1
        large = rows.where(F.col("kind") == VERTEX).groupBy("comp").count().where(F.col("count") > most).select("comp")
        if large.isEmpty():
            return rows
        large = written(large)
        cut = rows.join(large, "comp", "left_semi")
        edges = cut.where(F.col("kind") != VERTEX)
        bound = edges.groupBy("comp").agg(F.percentile_approx("w", 0.8).alias("bound"))
        spread = F.pmod(F.xxhash64("a", "b", F.lit(turn)), F.lit(10)) < 8  # of equal distances
        kept = edges.join(bound, "comp").where((F.col("w") < F.col("bound")) | ((F.col("w") == F.col("bound")) & spread)).drop("bound")
        _, comps = forest(kept.withColumns({"ca": F.col("a"), "cb": F.col("b")}))
        left = cut.where(F.col("kind") == VERTEX).unionByName(kept).drop("comp").join(comps.withColumnRenamed("v", "a"), "a", "left").withColumn("comp", F.coalesce("comp", "a"))
        rows = written(rows.join(large, "comp", "left_anti").unionByName(left))


def hierarchy(placed: DataFrame) -> DataFrame:
    """The label of every clustered vertex: index_name, v, cluster, persistence, place among its cluster's members, weight and least ids of its copies."""
    once = placed.select("index_name", "node_id", vertex(), "vec", "places").mapInArrow(_collapsed, "index_name string, v bigint, vec binary, places array<bigint>, weight bigint, ids array<bigint>")
    cells = once.select("index_name", "v", "vec", "weight", "ids", (F.size("places") == 1).alias("alone"), F.explode("places").alias("place"))
    cells = cells.select("index_name", F.shiftright("place", 1).alias("cell"), "v", "vec", ((F.col("place") % 2) == 1).alias("is_home"), "alone", "weight", "ids")
    graph = written(cells.groupBy("index_name", "cell").applyInArrow(_graph, GRAPH))
    taken, comps = forest(graph.where(F.col("kind") == BORDER).select("a", "b", "w", F.col("comp").alias("ca"), F.col("other").alias("cb")))
    none = lambda kind: F.lit(None).cast(kind)
    further = taken.select(none("string").alias("index_name"), F.lit(EDGE).alias("kind"), "a", "b", "w", F.col("own").alias("comp"), none("array<bigint>").alias("ids"))
    rows = graph.where(F.col("kind") != BORDER).drop("other").unionByName(further)
    last = comps.select(F.col("v").alias("comp"), F.col("comp").alias("last"))
    rows = rows.join(last, "comp", "left").withColumn("comp", F.coalesce("last", "comp")).drop("last")
    buckets = 1 + graph.where(F.col("kind") == VERTEX).count() // BUCKET
    labels = written(rows.groupBy(F.pmod(F.xxhash64("comp"), F.lit(buckets)).alias("bucket")).applyInArrow(_condense, LABEL))
    discard(graph, taken, comps)
    return labels


def vertex() -> Column:
    return F.xxhash64("index_name", "vec").alias("v")


def join_pieces(totals: np.ndarray, least: float = LEAST_OF_MEANS) -> np.ndarray:
    """The joined cluster of each piece: Borůvka's rounds, each piece or group of pieces hooking on to the one of nearest mean."""
    group = np.arange(len(totals))
    while True:
        names, group = np.unique(group, return_inverse=True)
        sums = np.zeros((len(names), totals.shape[1]))
        np.add.at(sums, group, totals)
        means = V.unit_rows(sums)
        best, score = np.zeros(len(names), np.int64), np.full(len(names), -2.0)
        for k in range(0, len(names), 2048):
            s = means[k : k + 2048] @ means.T
            s[np.arange(len(s)), np.arange(k, k + len(s))] = -2
            best[k : k + len(s)], score[k : k + len(s)] = s.argmax(axis=1), s.max(axis=1)
        hook = np.where(score >= least, best, np.arange(len(names)))
        if (hook == np.arange(len(names))).all():
            return group
        mutual = hook[hook] == np.arange(len(names))
        hook = np.where(mutual, np.minimum(hook, np.arange(len(names))), hook)
        while (hook[hook] != hook).any():
            hook = hook[hook]
        group = hook[group]


Means = dict[str, tuple[np.ndarray, np.ndarray]]  # per index: cluster numbers, unit means


def _assign(vectors: DataFrame, means: Means, taken: bool = True) -> DataFrame:
    """index_name, node_id, cluster, sim, vec of the vectors near enough to their nearest mean, or of the others; means come in passes of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = b.column(2)
            cluster, sim = np.full(b.num_rows, -1), np.full(b.num_rows, -2.0)
            for i, rows in V.by_name(b.column(0), means):
                x = V.matrix(vec.take(pa.array(rows)))
                number, mean = means[i]
                for k in range(0, len(number), MEANS_PER_PASS):
                    s = x @ mean[k : k + MEANS_PER_PASS].T
                    top = s.argmax(axis=1)
                    value = s[np.arange(len(s)), top]
                    better = value > sim[rows]
                    sim[rows[better]], cluster[rows[better]] = value[better], number[k + top[better]]
            near = pa.array(np.flatnonzero((sim >= LEAST_TO_MEAN) == taken))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(near), b.column(1).take(near), pa.array(cluster).take(near), pa.array(sim).take(near), vec.take(near)], ["index_name", "node_id", "cluster", "sim", "vec"]
            )

    return vectors.select("index_name", "node_id", "vec").mapInArrow(run, "index_name string, node_id bigint, cluster bigint, sim double, vec binary")


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums per cluster over a whole task, before the shuffle."""
    sums: dict[tuple[str, int], list] = {}
    for b in batches:
        names, cluster, ids = np.array(b.column(0).to_pylist(), object), b.column(2).to_numpy(), b.column(1).to_numpy()
        for i, c in sorted(set(zip(names.tolist(), cluster.tolist(), strict=True))):
            own = np.flatnonzero((names == i) & (cluster == c))
            total = V.matrix(b.column(4).take(pa.array(own))).astype(np.float64).sum(axis=0)
            s = sums.setdefault((i, c), [0, total * 0, None])
            s[0], s[1] = s[0] + len(own), s[1] + total
            s[2] = min(int(ids[own].min()), s[2] if s[2] is not None else 1 << 62)
    keys = list(sums)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([i for i, _ in keys], pa.string()),
            pa.array([c for _, c in keys], pa.int64()),
            pa.array([sums[x][0] for x in keys], pa.int64()),
            pa.array([sums[x][1].tolist() for x in keys], pa.list_(pa.float64())),
            pa.array([sums[x][2] for x in keys], pa.int64()),
        ],
        ["index_name", "cluster", "size", "total", "least_id"],
    )


def _restated(assigned: DataFrame) -> dict[tuple[str, int], tuple[int, np.ndarray, int]]:
    """Size, vector sum and least id of each cluster."""
    partial = assigned.mapInArrow(_partial, "index_name string, cluster bigint, size bigint, total array<double>, least_id bigint")
    each = partial.select("index_name", "cluster", "size", "least_id", F.posexplode("total").alias("at", "x"))
    dims = each.groupBy("index_name", "cluster", "at").agg(F.sum("x").alias("x"), F.sum("size").alias("size"), F.min("least_id").alias("least_id"))
    rows = dims.groupBy("index_name", "cluster").agg(F.max("size").alias("size"), F.min("least_id").alias("least_id"), F.array_sort(F.collect_list(F.struct("at", "x"))).alias("total"))
    return {(r.index_name, r.cluster): (r.size, np.array([v.x for v in r.total]), r.least_id) for r in rows.toLocalIterator()}


def _means(stated: dict[tuple[str, int], tuple[int, np.ndarray, int]]) -> Means:
    out: Means = {}
    for i in {i for i, _ in stated}:
        own = sorted(c for j, c in stated if j == i and stated[i, c][0] >= MIN_SIZE)
        if own:
            out[i] = (np.array(own), V.unit_rows(np.array([stated[i, c][1] for c in own])))
    return out


Stated = dict[tuple[str, int], tuple[int, np.ndarray, int]]
Typical = dict[tuple[str, int], list[tuple[float, int]]]


def _begun(vectors: DataFrame, labels: DataFrame) -> tuple[Stated, Typical]:
    """Size, sum and least id of the most persistent members of each cluster, and the most typical ids by persistence: one row a cluster, never one a vector."""
    few = labels.where(F.col("place") < TYPICAL).select("v", "cluster")
    members = vectors.select("index_name", "node_id", "vec", vertex()).join(few, "v").select("index_name", "node_id", "cluster", F.lit(1.0).alias("sim"), "vec")
    ids = labels.where(F.col("place") < EXEMPLARS).select("index_name", "cluster", F.explode("ids").alias("id"), "persistence")
    best = ids.groupBy("index_name", "cluster").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("persistence")).alias("p"), "id"))), 1, EXEMPLARS).alias("best"))
    return _restated(members), {(r.index_name, r.cluster): [(-x.p, x.id) for x in r.best] for r in best.toLocalIterator()}


def _directions(stated: Stated) -> Means:
    return {i: (np.array([c for j, c in sorted(stated) if j == i]), V.unit_rows(np.array([stated[x][1] for x in sorted(stated) if x[0] == i]))) for i in {i for i, _ in stated}}


def _settled(vectors: DataFrame, begun: Stated, typical: Typical) -> tuple[Means, Stated, Typical, dict[int, int]]:
    """Means, statement and typical members of the clusters that hold by the exact check over all vectors; and in which cluster each begun one is."""
    held = {x: s for x, s in _restated(_assign(vectors, _directions(begun))).items() if s[0] >= MIN_SIZE}
    means: Means = {}
    members: Typical = {}
    joined: dict[int, int] = {}
    for i in sorted({i for i, _ in held}):
        own = sorted(c for j, c in held if j == i)
        totals = np.array([held[i, c][1] for c in own])
        group = join_pieces(totals)
        sums = np.zeros((group.max() + 1, totals.shape[1]))
        np.add.at(sums, group, totals)
        head = [own[int(np.flatnonzero(group == g)[0])] for g in range(len(sums))]
        means[i] = (np.array(head), V.unit_rows(sums))
        for c, g in zip(own, group.tolist(), strict=True):
            joined[c] = head[g]
            members.setdefault((i, head[g]), []).extend(typical.get((i, c), []))
    for _ in range(2):
        means = _means(_restated(_assign(vectors, means)))
    kept = {x: s for x, s in _restated(_assign(vectors, means)).items() if s[0] >= MIN_SIZE}
    means = {i: (number[ok], mean[ok]) for i, (number, mean) in means.items() if (ok := np.array([(i, c) in kept for c in number.tolist()], bool)).any()}
    return means, kept, members, joined


def clustered(entries: DataFrame, indexes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (index_name, node_id, cluster_key, similarity, labelled: whether by the hierarchy's own label) and clusters (index_name, cluster_key, size, exemplars)."""
    trees = V.fit_trees(entries, indexes, NEIGHBOURS, LINKS)
    vectors = written(V.current_routed(V.packed(entries, indexes), trees))
    labels = hierarchy(vectors)
    means, kept, typical, joined = _settled(vectors, *_begun(vectors, labels))
    turn = 0
    while kept:  # a cluster may have been cut by a border of cells, or hidden in a greater one that didn't hold
        turn += 1
        left = written(_assign(vectors, means, taken=False).select("index_name", "node_id", F.lit(None).cast("timestamp").alias("updated_at"), "vec"))
        further = hierarchy(V.routed(left, V.fit_packed(left, NEIGHBOURS, 7 + turn, LINKS)))
        begun, members = _begun(left, further)
        holds = {x: begun[x] for x, s in _restated(_assign(left, _directions(begun))).items() if s[0] >= MIN_SIZE}
        discard(left)
        if not holds:
            break
        again = _settled(vectors, kept | holds, typical | members)
        if len(again[1]) <= len(kept):
            break
        labels = labels.unionByName(further)
        means, kept, typical = again[:3]
        joined = {c: again[3].get(g, g) for c, g in joined.items()} | again[3]
    spark = entries.sparkSession
    keys = spark.createDataFrame(
        [(i, c, s[2], s[0], [n for _, n in sorted(dict.fromkeys(typical.get((i, c), [])), key=lambda t: (-t[0], t[1]))[:EXEMPLARS]]) for (i, c), s in sorted(kept.items())],
        "index_name string, number bigint, cluster_key bigint, size bigint, exemplars array<bigint>",
    )
    names = spark.createDataFrame(sorted(joined.items()), "cluster bigint, number bigint")
    fit = _assign(vectors, means).select("index_name", "node_id", F.col("cluster").alias("number"), F.col("sim").alias("similarity"), vertex())
    # the labels' own clusters, by vertex; the few vertices of very many copies over salts
    labels = labels.select("v", "cluster", "weight")
    least = F.lit(1 + (labels.agg(F.sum("weight")).first()[0] or 0) // HEAVY)
    heavy = F.broadcast(labels.where(F.col("weight") >= least).select("v", F.lit(True).alias("heavy")).distinct())  # bound: HEAVY rows a pass
    own = labels.join(names, "cluster").groupBy("v").agg(F.collect_set("number").alias("labels")).join(heavy, "v", "left")
    own = own.select("v", "labels", F.explode(F.when(F.col("heavy"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    fit = fit.join(heavy, "v", "left").withColumn("salt", F.when(F.col("heavy"), F.pmod("node_id", F.lit(SALTS)).cast("int")).otherwise(0))
    members = fit.join(own, ["v", "salt"], "left").select("index_name", "node_id", "number", "similarity", F.coalesce(F.array_contains("labels", F.col("number")), F.lit(False)).alias("labelled"))
    return members.join(keys.select("index_name", "number", "cluster_key"), ["index_name", "number"]).drop("number"), keys.drop("number")
