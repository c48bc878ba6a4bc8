"""Nearest vectors and clusters on small sets against brute force."""

from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest

from trellis.llm import clusters as C
from trellis.llm import vectors as V

RNG = np.random.default_rng(5)
SCHEMA = "index_name string, node_id bigint, vector array<float>, updated_at timestamp"


def at(day):
    return datetime(2024, 1, day)


def blobs(n, k, dim=16, spread=0.25):
    centres = np.linalg.qr(RNG.normal(size=(dim, dim)))[0][:k]
    return V.unit_rows(centres[RNG.integers(0, k, n)] + spread * RNG.normal(size=(n, dim)) / np.sqrt(dim) * 2)


def test_search_reaches_its_recall():
    x = blobs(4000, 6)
    best, score = V.search(x, x, np.arange(len(x)), 10)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(best, top)]) / 10 >= 0.93
    assert (best != np.arange(len(x))[:, None]).all() and (np.diff(score, axis=1) <= 1e-6).all()
    few, _ = V.search(x[:3], x[:3], np.arange(3), 10)
    assert (np.sort(few, axis=1)[:, -2:] >= 0).all() and (few >= 0).sum() == 6
    assert (V.search(x[:0], x[:2], np.full(2, -1), 3)[0] == -1).all()


def test_copies_are_neighbours_of_each_other():
    x = np.concatenate([np.repeat(blobs(1, 1), 300, axis=0), blobs(500, 3)])
    best, score = V.search(x, x, np.arange(len(x)), 10)
    assert (best[:300] < 300).all() and np.allclose(score[:300], 1, atol=1e-5) and (best != np.arange(len(x))[:, None]).all()
    s = x @ x.T
    np.fill_diagonal(s, -2)
    assert np.abs(np.sort(score[300:], axis=1) - np.sort(-np.partition(-s[300:], 9, axis=1)[:, :10], axis=1)).mean() < 0.01
    tree = V.Tree(x, len(x), 10, cell=200, block=100)
    places = tree.places(x)
    assert all(sum(v % 2 for v in p) == 1 for p in places) and len({tuple(p) for p in places[:300]}) == 1 and tree.size() > 1


def test_routing_over_several_cells():
    x = blobs(3000, 5)
    tree = V.Tree(x[::3], len(x), 10, cell=400)
    home, visits = tree.route(x)
    assert len(tree.centroids) > 4 and visits[np.arange(len(x)), home].all()
    s = x @ x.T
    np.fill_diagonal(s, -2)
    near = np.argpartition(-s, 10, axis=1)[:, :10]
    assert np.take_along_axis(visits, home[near], axis=1).mean() > 0.9


@pytest.fixture(scope="module")
def tables(spark):
    x = blobs(300, 4, 8)
    rows = [("a", k, [float(v) for v in x[k]], at(2)) for k in range(300)]
    rows += [("a", 0, [-float(v) for v in x[0]], at(1)), ("a", 1, [float(v) for v in x[1]], at(2))]  # an older version, an exact copy
    rows += [("a", 2, None, at(3)), ("a", 3, [0.0] * 8, at(3)), ("a", 4, [float("nan")] + [1.0] * 7, at(3)), ("a", 5, [1.0] * 7, at(3)), ("a", 6, [1.0, None] + [1.0] * 6, at(3))]
    rows += [("b", 1, [1.0, 0.0], at(1)), ("b", 2, [1e30, 1e-30], at(1)), ("c", 1, [1.0, 0.0], at(1)), (None, 1, [1.0, 0.0], at(1)), ("b", None, [1.0, 0.0], at(1))]
    entries = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS dim", "'x' AS vec")
    indexes = spark.createDataFrame([("a", 8, "k"), ("b", 2, "k"), (None, 2, "k")], "name string, dim int, backend string")
    return x, entries, indexes


def test_nearest_of_current_usable_vectors(tables):
    x, entries, indexes = tables
    got = {}
    for r in V.nearest(entries, indexes, 5).collect():
        got.setdefault((r.index_name, r.node_id), {})[r.neighbour] = r.similarity
    usable = [0, 1, *range(7, 300)]
    assert {n for i, n in got if i == "a"} == set(usable) and {n for i, n in got if i == "b"} == {1, 2} and not any(i == "c" for i, _ in got)
    y = x[usable].astype(np.float64)
    s = y @ y.T
    np.fill_diagonal(s, -2)
    want = np.argsort(-s, axis=1)[:, :5]
    hits = sum(len(set(got["a", usable[k]]) & {usable[j] for j in want[k]}) for k in range(len(usable)))
    assert hits / (5 * len(usable)) >= 0.95
    stated = {r.index_name: r for r in V.recall(entries, indexes, 5, 1).collect()}
    assert set(stated) == {"a", "b"} and stated["a"].n_queries == len(usable) and abs(stated["a"].recall - hits / (5 * len(usable))) < 0.01 and stated["b"].recall == 1
    assert V.recall(entries.limit(0), indexes).count() == 0
    pairs = [tuple(r) for r in V.similar_pairs(V.nearest(entries, indexes, 5), 0.9).collect()]
    assert len(pairs) == len(set(pairs)) and all(a < b for _, a, b in pairs) and ("b", 1, 2) in pairs
    assert V.nearest(entries.limit(0), indexes).count() == 0 and V.nearest(entries, indexes.limit(0)).count() == 0


def test_spanning_forest_weight():
    n = 60
    a, b = RNG.integers(0, n, 400), RNG.integers(0, n, 400)
    w = RNG.integers(1, 20, 400).astype(float)
    root = list(range(n))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    total, edges = 0.0, 0
    for k in np.argsort(w, kind="stable"):
        p, q = find(a[k]), find(b[k])
        if p != q:
            root[p] = q
            total, edges = total + w[k], edges + 1
    chosen = C.spanning_forest(n, a, b, w)
    assert len(chosen) == edges and w[chosen].sum() == total


def density(x, weight=None):
    """Cluster and persistence of each row, in memory."""
    weight = np.ones(len(x), np.int64) if weight is None else weight
    a, b, w = C.mutual_graph(x, weight)
    f = C.spanning_forest(len(x), a, b, w)
    f = f[np.argsort(w[f], kind="stable")]
    return C.condensed(len(x), a[f], b[f], w[f], C.MIN_SIZE, 1 - C.LOOSE_LINK, weight)


def test_density_clusters_and_joined_means():
    x = np.concatenate([blobs(200, 1, 16, 0.2), V.unit_rows(RNG.normal(size=(20, 16)))])
    label, persistence = density(x)
    assert (label[:200] >= 0).mean() > 0.9 and (persistence[label >= 0] > 0).all()
    assert (density(x[:5])[0] == -1).all()
    group = C.join_pieces(np.array([[10.0, 0, 0], [0, 5.0, 0], [9.0, 3.0, 0], [0, 0, 1.0]]))
    assert group[0] == group[2] and len(set(group.tolist())) == 3


def test_distributed_forest_is_the_minimum_one(spark):
    n = 300
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, n, 900), rng.integers(0, n, 900)
    a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
    w = rng.integers(1, 6, len(a)).astype(float)  # many ties
    edges = spark.createDataFrame([(int(p), int(q), float(d)) for p, q, d in zip(a, b, w)], "a bigint, b bigint, w double").selectExpr("*", "a AS ca", "b AS cb")
    want = w[C.spanning_forest(n, a, b, w)].sum()
    for at_once in (1, 40, 10_000):
        tree, comps = C.forest(edges, at_once)
        rows = [tuple(r)[:3] for r in tree.collect()]
        comp = {r.v: r.comp for r in comps.collect()}
        assert sum(r[2] for r in rows) == want and len(rows) == len(set(rows)) == len(comp) - len(set(comp.values())) and set(comp) == set(a.tolist()) | set(b.tolist())
        assert all(comp[p] == comp[q] for p, q in zip(a.tolist(), b.tolist()))
    order = np.lexsort((b, a, w))
    for closed in (np.zeros(n, bool), np.arange(n) % 3 == 0, np.ones(n, bool)):  # rounds inside cells: whatever they take is in the forest, and they leave one closed vertex a component
        taken, comp = C.contracted(n, a[order], b[order], closed)
        assert len({x for x in comp[closed].tolist()}) == closed.sum() and (comp[closed] == np.flatnonzero(closed)).all()
        rest = [(int(p), int(q), float(d)) for p, q, d, p2, q2 in zip(a, b, w, comp[a], comp[b]) if p2 != q2]
        left = spark.createDataFrame([(p, q, d, int(comp[p]), int(comp[q])) for p, q, d in rest] or [], "a bigint, b bigint, w double, ca bigint, cb bigint")
        assert w[order][taken].sum() + sum(r.w for r in C.forest(left, 20)[0].collect()) == want
    tree, comps = C.forest(edges)
    vertex = comps.selectExpr("CAST(NULL AS STRING) AS index_name", "0 AS kind", "v AS a", "CAST(NULL AS BIGINT) AS b", "1D AS w", "comp", "CAST(NULL AS ARRAY<BIGINT>) AS ids")
    edge = tree.join(comps.withColumnRenamed("v", "a"), "a").selectExpr("CAST(NULL AS STRING) AS index_name", "1 AS kind", "a", "b", "w", "comp", "CAST(NULL AS ARRAY<BIGINT>) AS ids")
    parts = C._parts(vertex.unionByName(edge), 50).collect()
    sizes = {}
    for r in parts:
        if r.kind == 0:
            sizes[r.comp] = sizes.get(r.comp, 0) + 1
    assert max(sizes.values()) <= 50 and sum(r.kind == 1 for r in parts) == sum(sizes.values()) - len(sizes) and sum(sizes.values()) == comps.count()
    none, nothing = C.forest(edges.limit(0))
    assert none.count() == nothing.count() == 0


def test_clusters(spark, tables):
    _, entries, indexes = tables
    members, keys = C.clustered(entries, indexes)
    rows = members.collect()
    by = {}
    for r in rows:
        by.setdefault(r.cluster_key, []).append(r.node_id)
        assert r.index_name == "a" and r.similarity >= C.LEAST_TO_MEAN
    assert np.mean([r.labelled for r in rows]) > 0.9
    assert len(by) == 4 and all(min(v) == k and len(v) >= C.MIN_SIZE for k, v in by.items()) and len(rows) == len({r.node_id for r in rows})
    stated = {r.cluster_key: r for r in keys.collect()}
    assert {k: r.size for k, r in stated.items()} == {k: len(v) for k, v in by.items()} and all(r.exemplars for r in stated.values())
    empty, none = C.clustered(entries.limit(0), indexes)
    assert empty.count() == none.count() == 0


def test_packing_keeps_row_order():
    column = pa.array([[3.0, 4.0], None, [1.0], [float("inf"), 1.0], [0.0, 0.0], [0.0, 2.0]], pa.list_(pa.float32()))
    out = V._unit(column, np.full(6, 2))
    assert [None if v is None else np.frombuffer(v, np.float32).tolist() for v in out] == [[pytest.approx(0.6), pytest.approx(0.8)], None, None, None, None, [0.0, 1.0]]
    assert V._unit(column.slice(5), np.full(1, 2))[0] == out[5]


@pytest.mark.parametrize("bounds", [{}, {"AT_ONCE": 200, "MOST": 700, "BUCKET": 500}])
def test_small_clusters_of_an_oversized_cell_stay_whole(spark, monkeypatch, bounds):
    monkeypatch.setattr(V, "CELL", 6000)
    monkeypatch.setattr(V, "BLOCK", 1000)
    for name, value in bounds.items():
        monkeypatch.setattr(C, name, value)
    rng = np.random.default_rng(3)
    axes = np.eye(24)
    copies = np.repeat(axes[:1], 3000, axis=0)
    region = axes[1] + 0.3 * rng.normal(size=(3000, 24)) / np.sqrt(24)
    small = [c + 0.3 * rng.normal(size=(8, 24)) / np.sqrt(24) for k in range(2, 8) for c in [0.35 * axes[k % 2] + 0.94 * axes[k]]]
    x = V.unit_rows(np.concatenate([copies, region, *small]))
    rows = [("a", k, v.tolist(), at(1)) for k, v in enumerate(x)]
    entries = spark.createDataFrame(rows, SCHEMA)
    members, keys = C.clustered(entries, spark.createDataFrame([("a", 24)], "name string, dim int"))
    by = {}
    for r in members.collect():
        by.setdefault(r.cluster_key, set()).add(r.node_id)
    assert by == {0: set(range(3000)), 3000: set(range(3000, 6000))} | {k: set(range(k, k + 8)) for k in range(6000, 6048, 8)}
    assert {r.cluster_key: (r.size, len(r.exemplars)) for r in keys.collect()} == {k: (len(v), 5) for k, v in by.items()}


def test_divided_cells_hold_similar_vectors():
    x = np.concatenate([np.repeat(blobs(1, 1), 2000, axis=0), blobs(2000, 2, spread=0.05), blobs(1000, 6)])
    tree = V.Tree(x, len(x), 10, cell=4000, block=600)
    held = np.bincount([n for p in tree.leaves(np.unique(x, axis=0))[1] for n in p], minlength=tree.size())
    assert tree.parts and len(held) == tree.size() and held.max() <= 600 and held.sum() >= 3001


def test_no_group_is_unbounded_and_copies_keep_exact_neighbours(spark, monkeypatch):
    block, k = 150, 5
    monkeypatch.setattr(V, "CELL", 20 * block)
    monkeypatch.setattr(V, "BLOCK", block)
    rng = np.random.default_rng(11)
    turn = rng.normal(size=(4, 24))
    dense = V.unit_rows(np.eye(24)[0] + 0.3 * rng.normal(size=(20 * block, 4)) @ turn / np.sqrt(24))  # one cell of 20 blocks
    x = np.concatenate([dense, np.repeat(dense[:1], 10 * block, axis=0)])  # and a third of all rows the same vector
    entries = spark.createDataFrame([("a", n, v.tolist(), at(1)) for n, v in enumerate(x)], SCHEMA)
    indexes = spark.createDataFrame([("a", 24)], "name string, dim int")
    trees = V.fit_trees(entries, indexes, k)
    groups = V.by_cell(V.current_routed(V.packed(entries, indexes), trees), k).groupBy("cell").count().collect()
    assert max(r["count"] for r in groups) <= 1.5 * block and len(groups) > 30
    got = {}
    for r in V.nearest(entries, indexes, k).collect():
        got.setdefault(r.node_id, []).append((r["rank"], r.neighbour, r.similarity))
    copies = [0, *range(20 * block, 30 * block)]
    for n in copies:
        assert [m for _, m, _ in sorted(got[n])] == [m for m in copies[: k + 1] if m != n][:k]
    s = dense @ dense.T
    np.fill_diagonal(s, -2)
    hits = [len({m for _, m, _ in got[n]} & set(np.argsort(-s[n])[:k].tolist())) / k for n in range(1, 20 * block) if 0 not in np.argsort(-s[n])[: k + 1]]
    assert len(got) == len(x) and all(len(v) == k for v in got.values()) and np.mean(hits) >= 0.9


def test_cells_of_a_large_index_are_not_divided_for_their_visitors():
    x = blobs(6000, 3, 32, 1.0)
    total, cell = 200 * len(x), 8000
    tree = V.Tree(x, total, 10, cell=cell, block=2 * cell)
    visits = tree.route(x)[1].sum(axis=1).mean()
    assert visits > 4 and tree.size() <= 3 * total / cell and np.mean([len(p) for p in tree.places(x)]) <= 1.05 * visits


def test_labels_do_not_depend_on_a_size_of_components(spark, monkeypatch):
    x = np.concatenate([blobs(400, 1, 16, 0.2), blobs(300, 1, 16, 0.4), V.unit_rows(RNG.normal(size=(20, 16)))])
    rows = [("a", n, v.tobytes(), [1]) for n, v in enumerate(x)]
    placed = spark.createDataFrame(rows, "index_name string, node_id bigint, vec binary, places array<bigint>")
    labels = lambda: {r.ids[0]: (r.cluster, round(r.persistence, 9), r.place) for r in C.hierarchy(placed).collect()}
    whole = labels()
    assert len(whole) > 600
    monkeypatch.setattr(C, "MOST", 50)
    assert labels() == whole


def test_links_of_a_large_index_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(V, "CELL", 100)
    monkeypatch.setattr(V, "BLOCK", 200)
    x = blobs(2500, 3, 32, 0.4)
    entries = spark.createDataFrame([("a", n, v.tolist(), at(1)) for n, v in enumerate(x)], SCHEMA)
    indexes = spark.createDataFrame([("a", 32)], "name string, dim int")
    seen = {}
    monkeypatch.setattr(C, "hierarchy", lambda placed, of=C.hierarchy: seen.setdefault("n", placed.selectExpr("sum(size(places)) AS n").first().n) and of(placed))
    members, _ = C.clustered(entries, indexes)
    assert V.fit_trees(entries, indexes, 10)["a"].visits > 4 and seen["n"] <= 2 * len(x)
    by = {}
    for r in members.collect():
        by.setdefault(r.cluster_key, set()).add(r.node_id)
    assert len(by) == 3 and sum(map(len, by.values())) > 0.9 * len(x)


def test_visits_in_several_passes_give_the_same_neighbours(spark, monkeypatch):
    monkeypatch.setattr(V, "CELL", 100)
    monkeypatch.setattr(V, "BLOCK", 200)
    monkeypatch.setattr(V, "CALIBRATION", 1000)
    x = np.concatenate([blobs(800, 3, 16, 1.0), np.repeat(blobs(1, 1), 400, axis=0)])
    entries = spark.createDataFrame([("a", n, v.tolist(), at(1)) for n, v in enumerate(x)], SCHEMA)
    indexes = spark.createDataFrame([("a", 16)], "name string, dim int")
    monkeypatch.setattr(V, "VISITS_AT_ONCE", 100.0)
    trees = V.fit_trees(entries, indexes, 5)
    assert V.turns(trees) == 1 and trees["a"].visits > 1.5
    rows = lambda: {(r.node_id, r["rank"]): (r.neighbour, round(r.similarity, 5)) for r in V.nearest(entries, indexes, 5).collect()}
    whole = rows()
    monkeypatch.setattr(V, "VISITS_AT_ONCE", (trees["a"].visits - 1) / 3)
    assert V.turns(V.fit_trees(entries, indexes, 5)) == 3
    parts = rows()
    assert set(parts) == set(whole) and len(whole) == 5 * len(x)
    assert np.mean([parts[key] == whole[key] for key in whole]) > 0.99
    assert all(parts[n, 1] == whole[n, 1] for n in range(800, 1200))


def test_copies_weigh_in_density():
    x = np.eye(8, dtype=np.float32)
    x[3] = V.unit_rows(x[2:3] + 0.3 * x[3:4])[0]
    label, persistence = density(x, weight=np.array([9, 7, 4, 4, 1, 1, 1, 1]))
    assert label[0] >= 0 and label[2] == label[3] >= 0 and label[0] != label[2] and (label[[1, 4, 5, 6, 7]] < 0).all() and (persistence[[0, 2, 3]] > 0).all()
    assert density(x[:1], weight=np.array([8]))[0][0] == 0 and density(x[:1], weight=np.array([7]))[0][0] == -1


def test_loose_cluster_within_the_definition(spark):
    x = 0.59 * np.eye(12)[:1] + 0.8 * np.eye(12)[1:9]  # pairwise 0.35, to the mean 0.66
    entries = spark.createDataFrame([("a", k, v.tolist(), at(1)) for k, v in enumerate(x)], SCHEMA)
    members, _ = C.clustered(entries, spark.createDataFrame([("a", 12)], "name string, dim int"))
    assert sorted((r.node_id, r.cluster_key) for r in members.collect()) == [(k, 0) for k in range(8)]
