"""The k most similar vectors for every vector, by a hierarchical k-means tree searched best bin first.

The upper levels of the tree (cells) are fitted per index on a bounded sample (SAMPLE vectors an index, up to
SAMPLE_MOST as the number of cells asks), in which copies count once; a cell of more than BLOCK distinct members is replaced by
smaller ones (a single cell gets a tree of its own, and so on), so that similar vectors stay together and no task gets an unbounded group. Every cell fits
its own lowest level (leaves) on all its vectors. A vector is a member of its nearest cell and a query there and in
every other cell within a margin of it; the margin is calibrated on the sample so that its true neighbours' cells
are visited (in parts of a divided cell, at most MOST_VISITS cells a vector on average), and so that they hold enough members.
The more cells an index has, the more of them a query visits: visits beyond the home cell come in as many passes as keep
them to VISITS_AT_ONCE a vector, each over all members, and the best neighbours so far are carried from pass to pass. Inside a cell a query takes the
leaves from its priority queue, nearest centroid first, and goes on to further leaves until the number of
visits that gave the wished recall on the cell's calibration queries, which are searched exactly. Every vector
is indexed and every vector is a query; only fitting and calibration use samples.

Exact copies are one member while a cell is searched. Of more than k + 1 copies in a batch only those of the least
ids go to the cell; the others (the crowd) have the same neighbours as any copy of a greater id, wait beside it in
salted groups of ids, and take over that one answer.

Defined results: a vector is current if its key has no later version, copies count once, equal times with
other vectors keep one of them by order of the bytes; null, wrongly sized, non-finite and zero vectors are
unusable, as are those of an unknown index; a vector with fewer than k companions has them all; a vector is
never its own neighbour; ties in similarity go to the smaller id; extra columns stay out.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis.tables import discard, written

SAMPLE = 6000
SAMPLE_PER_CELL = 40
SAMPLE_MOST = 131_072
CELL = 16_384
BLOCK = 2 * CELL
MOST_VISITS = 4.0  # of a part's vectors, on average, before its margin is narrowed
VISITS_AT_ONCE = 0.75  # a vector on average beyond its home cell, and
VISITORS_AT_ONCE = 4 * BLOCK  # queries of a cell, in one pass
ENOUGH = 4  # times k + 1 members in the cells a query visits
SALTS = 32
QUERIES = 8192  # of a brute-force comparison at once
LEAF = 192
RECALL = 0.97
CALIBRATION = 256
VECTOR = "index_name string, node_id bigint, updated_at timestamp, vec binary"


def _floats(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, row bounds and null elements of a list column."""
    bounds = column.offsets.to_numpy().astype(np.int64)
    values = column.values.slice(bounds[0], bounds[-1] - bounds[0])
    gaps = values.is_null().to_numpy(zero_copy_only=False) if values.null_count else np.zeros(len(values), bool)
    return np.where(gaps, np.nan, values.to_numpy(zero_copy_only=False).astype(np.float64)), bounds - bounds[0], gaps


def _unit(column: pa.Array, dims: np.ndarray) -> list[bytes | None]:
    """Each usable vector scaled to length 1 as float32 bytes, None for the others."""
    values, bounds, _ = _floats(column)
    size = np.diff(bounds)
    good = np.asarray(column.is_valid()) & (size == dims) & (size > 0)
    out: list[bytes | None] = [None] * len(size)
    for dim in np.unique(size[good]).tolist():
        rows = np.flatnonzero(good & (size == dim))
        x = values[bounds[rows][:, None] + np.arange(dim)]
        top = np.abs(x).max(axis=1)
        fine = np.isfinite(x).all(axis=1) & (top > 0)
        rows, x = rows[fine], x[fine] / top[fine][:, None]  # scaled first, so that squares neither overflow nor vanish
        x = (x / np.sqrt((x * x).sum(axis=1))[:, None]).astype(np.float32)
        for r, v in zip(rows.tolist(), x, strict=True):
            out[r] = v.tobytes()
    return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        dims = b.column(4).fill_null(-1).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(_unit(b.column(3), dims), pa.binary())], ["index_name", "node_id", "updated_at", "vec"])


def packed(entries: DataFrame, indexes: DataFrame) -> DataFrame:
    """All versions with their unit vectors, null where unusable."""
    dims = indexes.where(F.col("name").isNotNull()).groupBy(F.col("name").alias("index_name")).agg(F.max("dim").alias("dim"))
    wide = entries.select("index_name", "node_id", "updated_at", "vector").where(F.col("node_id").isNotNull()).join(dims, "index_name", "left")
    return wide.select("index_name", "node_id", "updated_at", "vector", "dim").mapInArrow(_pack, VECTOR)


def current(versions: DataFrame) -> DataFrame:
    """The usable current vector of each key."""
    latest = Window.partitionBy("index_name", "node_id").orderBy(F.col("updated_at").desc_nulls_last(), F.col("vec"))
    return versions.withColumn("_n", F.row_number().over(latest)).where((F.col("_n") == 1) & F.col("vec").isNotNull()).drop("_n", "updated_at")


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The packed vectors (of one length) as rows."""
    x = b"".join(column.to_pylist())
    return np.frombuffer(x, np.float32).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.float32)


def unit_rows(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)), 1e-30)[:, None]).astype(np.float32)


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int = 7) -> np.ndarray:
    """Spherical k-means: unit centroids."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        order = np.argsort(own, kind="stable")
        held = np.bincount(own, minlength=k)
        starts = np.r_[0, np.cumsum(held)[:-1]]
        full = held > 0
        c[full] = unit_rows(np.add.reduceat(x[order], starts[full], axis=0))
        if not full.all():
            c[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return c


class Tree:
    """Upper levels of one index: unit centroids of the cells, the margin within which a query visits further cells, and the trees of divided cells (parts)."""

    def __init__(self, sample: np.ndarray, total: float, k: int, cell: int = CELL, block: int = BLOCK, seed: int = 7, per_cell: int = 8, divide: bool = True) -> None:
        distinct = np.unique(np.ascontiguousarray(sample).view(f"V{sample.shape[1] * 4}").ravel(), return_index=True)[1]
        sample, total = sample[np.sort(distinct)], total * len(distinct) / len(sample)
        cells = max(1, min(round(total / cell), len(sample) // per_cell))
        self.centroids = kmeans(sample, cells, 12, seed) if cells > 1 else sample[:1]
        if divide and cells > 1:
            self._refine(sample, total / len(sample), cell, block, seed)
        self.margin = np.float32(0)
        self.least = ENOUGH * (k + 1)
        self.held = np.bincount((sample @ self.centroids.T).argmax(axis=1), minlength=len(self.centroids)) * (total / len(sample))  # members of each cell, as estimated
        if len(self.centroids) > 1:
            home = (sample @ self.centroids.T).argmax(axis=1)
            q = sample[:: max(1, len(sample) // 1024)]
            gaps = []
            for part in np.array_split(q, max(1, len(q) * len(sample) // (1 << 24))):
                near = np.argpartition(-(part @ sample.T), min(k + 1, len(sample) - 1), axis=1)[:, : k + 1]
                to_cells = part @ self.centroids.T
                gaps.append(to_cells.max(axis=1)[:, None] - np.take_along_axis(to_cells, home[near], axis=1))
            self.margin = np.float32(np.quantile(np.concatenate(gaps), RECALL))
        self.parts: dict[int, Tree] = {}
        self.visits, self.most = 1.0, 0.0  # cells a row, and of a cell's rows, the visitors from other cells
        if divide:
            self._divide(sample, total / len(sample), k, block, seed, self.held if cells > 1 else None)
            some = sample[:: max(1, len(sample) // 8192)]
            own, found = self.leaves(some)
            visitors = np.bincount(np.concatenate([np.array(f) for f in found]), minlength=self.size()) - np.bincount(own, minlength=self.size())
            self.visits, self.most = 1 + visitors.sum() / len(some), float(visitors.max()) * total / len(some)

    def _refine(self, sample: np.ndarray, share: float, cell: int, block: int, seed: int) -> None:
        """Replaces cells of more than a block's members by smaller ones."""
        for _ in range(8):
            home = (sample @ self.centroids.T).argmax(axis=1)
            held = np.bincount(home, minlength=len(self.centroids))
            large = np.flatnonzero((held * share > block) & (held > 1))
            if not len(large):
                return
            smaller = [kmeans(sample[home == c], max(2, round(held[c] * share / cell)), 12, seed) for c in large.tolist()]
            self.centroids = np.concatenate([np.delete(self.centroids, large, axis=0), *smaller])

    def _narrow(self, x: np.ndarray, most: float = MOST_VISITS) -> None:
        """Narrows the margin to so many cells a row on average."""
        if self.route(x)[1].sum() > most * len(x):
            sims = x @ self.centroids.T
            gaps = (sims.max(axis=1)[:, None] - sims).ravel()
            nth = int(most * len(x)) - 1
            self.margin = np.float32(np.partition(gaps, nth)[nth])

    def _divide(self, sample: np.ndarray, share: float, k: int, block: int, seed: int, held: np.ndarray | None = None) -> None:
        """Gives each cell that more than a block's vectors visit (or, where held is given, of more members) a tree of its own; share is the number of vectors a sampled one stands for."""
        visits = self.route(sample)[1]
        for c in np.flatnonzero((visits.sum(axis=0) * share if held is None else held) > block).tolist():
            inside = sample[visits[:, c]]
            cell = block // 2
            for _ in range(3):  # smaller cells where many are visited
                part = Tree(inside, len(inside) * share, k, max(1, cell), block, seed, per_cell=2, divide=False)
                part._narrow(inside)
                held = part.route(inside)[1].sum(axis=0)
                if held.max() * share <= block:
                    break
                cell = int(min(cell / 2, cell * block / (held.max() * share)))
            if held.max() == len(inside):  # the margin would undo the split
                part.margin = np.float32(0)
                held = part.route(inside)[1].sum(axis=0)
            if held.max() < len(inside):
                part._divide(inside, share, k, block, seed)
                self.parts[c] = part

    def size(self) -> int:
        """Cells, those of the parts in place of the divided ones."""
        return len(self.centroids) + sum(p.size() - 1 for p in self.parts.values())

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Home cell of each row, and which cells it visits: those within the margin, and further ones as long as nearer ones hold too few members."""
        sims = x @ self.centroids.T
        best = sims.max(axis=1)
        visits = sims >= (best - self.margin)[:, None]
        if self.held.min() < self.least:
            order = np.argsort(-sims, axis=1, kind="stable")
            nearer = np.cumsum(self.held[order], axis=1) - self.held[order]
            visits |= np.take_along_axis(nearer < self.least, np.argsort(order, axis=1), axis=1)
        return sims.argmax(axis=1), visits

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """Numbers of the home cell and of all the cells that each row visits, in which divided cells are their parts'."""
        home, visits = self.route(x)
        own = np.zeros(len(x), np.int64)
        out: list[list[int]] = [[] for _ in range(len(x))]
        start = 0
        for c in range(len(self.centroids)):
            rows = np.flatnonzero(visits[:, c])
            part = self.parts.get(c)
            inner_home, inner = part.leaves(x[rows]) if part else (np.zeros(len(rows), np.int64), [[0]] * len(rows))
            at_home = home[rows] == c
            own[rows[at_home]] = start + inner_home[at_home]
            for r, found in zip(rows.tolist(), inner, strict=True):
                out[r] += [start + n for n in found]
            start += part.size() if part else 1
        return own, out

    def places(self, x: np.ndarray) -> list[list[int]]:
        """Where each row goes, as 2 * cell + is_home."""
        own, cells = self.leaves(x)
        return [[2 * c + (c == h) for c in found] for h, found in zip(own.tolist(), cells, strict=True)]


def _drawn(df: DataFrame, totals: dict[str, int]) -> DataFrame:
    """A sample of each index by a hash of the key."""
    share = F.lit(0.0)
    for i, n in totals.items():
        share = F.when(F.col("index_name") == i, min(1.0, min(SAMPLE_MOST, max(SAMPLE, SAMPLE_PER_CELL * n // CELL)) / n)).otherwise(share)
    return df.where(F.pmod(F.xxhash64("index_name", "node_id"), F.lit(1 << 20)) < share * (1 << 20))


def _totals(df: DataFrame) -> dict[str, int]:
    return {r.index_name: r.n for r in df.groupBy("index_name").agg(F.count("*").alias("n")).collect() if r.index_name is not None}  # one row an index


def _planted(drawn: DataFrame, totals: dict[str, int], k: int, seed: int = 7, most: float | None = None) -> dict[str, Tree]:
    rows: dict[str, list[bytes]] = {}
    for r in drawn.where(F.col("vec").isNotNull()).select("index_name", "vec").toArrow().to_batches():  # bound: the sample
        for i, v in zip(r.column(0).to_pylist(), r.column(1).to_pylist(), strict=True):
            rows.setdefault(i, []).append(v)
    trees = {}
    for i, v in sorted(rows.items()):
        sample = np.frombuffer(b"".join(sorted(v)), np.float32).reshape(len(v), -1)
        trees[i] = Tree(sample, totals[i], k, CELL, BLOCK, seed)
        if most:
            trees[i]._narrow(sample, most)
    return trees


def fit_trees(entries: DataFrame, indexes: DataFrame, k: int, most: float | None = None) -> dict[str, Tree]:
    """One tree an index, fitted on a sample drawn by a hash of the key; most: visits a vector on average."""
    totals = _totals(entries)
    return _planted(packed(_drawn(entries, totals), indexes), totals, k, most=most)


def fit_packed(vectors: DataFrame, k: int, seed: int, most: float | None = None) -> dict[str, Tree]:
    """Trees of packed vectors."""
    totals = _totals(vectors)
    return _planted(_drawn(vectors, totals), totals, k, seed, most)


def by_name(names: pa.Array, wanted: object) -> Iterator[tuple[str, np.ndarray]]:
    """The rows of each wanted name."""
    coded = names.dictionary_encode()
    codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    for c, i in enumerate(coded.dictionary.to_pylist()):
        if i in wanted:
            yield i, np.flatnonzero(codes == c)


def turns(trees: dict[str, Tree]) -> int:
    """The number of passes that keep the visits of one within bounds."""
    return max([1, *(int(np.ceil(max((t.visits - 1) / VISITS_AT_ONCE, t.most / VISITORS_AT_ONCE))) for t in trees.values())])


def routed(versions: DataFrame, trees: dict[str, Tree], schema: str = VECTOR, turn: int = 0, of: int = 1) -> DataFrame:
    """Adds the places of every usable vector, of those besides the home only the turn's; an index whose sample was empty has one cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = b.column(3)
            places: list[list[int]] = [[1]] * b.num_rows
            valid = np.asarray(vec.is_valid())
            for i, rows in by_name(b.column(0), trees):
                rows = rows[valid[rows]]
                if len(rows):
                    ids = b.column(1).take(pa.array(rows)).fill_null(0).to_pylist()
                    for r, n, v in zip(rows.tolist(), ids, trees[i].places(matrix(vec.take(pa.array(rows)))), strict=True):
                        places[r] = v if of == 1 else [p for p in v if p % 2 or (n + (p >> 1)) % of == turn]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(places, pa.list_(pa.int64()))], [*b.schema.names, "places"])

    return versions.mapInArrow(run, schema + ", places array<bigint>")


def search(members: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, leaf: int = LEAF, recall: float = RECALL) -> tuple[np.ndarray, np.ndarray]:
    """Positions and similarities of the k best members of each query, best first (-1 where there are fewer).

    own: the query's own position among the members, or -1. Exact copies among the members are searched as one.
    """
    if len(members) < 2 or not len(queries):
        return search_distinct(members, queries, own, k, leaf, recall)
    rows = np.ascontiguousarray(members).view(f"V{members.shape[1] * 4}").ravel()
    _, first, group = np.unique(rows, return_index=True, return_inverse=True)
    if len(first) == len(members):
        return search_distinct(members, queries, own, k, leaf, recall)
    found, sims = search_distinct(members[first], queries, np.full(len(queries), -1), k + 1, leaf, recall)
    by_group = np.argsort(group, kind="stable")
    size = np.bincount(group)
    starts = np.r_[0, np.cumsum(size)[:-1]]
    held = found >= 0
    q, r = np.nonzero(held)
    g = found[held]
    take = np.minimum(size[g], k + 1)  # of a group of copies the first ones will do
    q, s = np.repeat(q, take), np.repeat(sims[held], take)
    nth = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
    m = by_group[np.repeat(starts[g], take) + nth]
    keep = m != own[q]
    q, m, s = q[keep], m[keep], s[keep]
    rank = np.lexsort((m, -s, q))
    q, m, s = q[rank], m[rank], s[rank]
    heads = np.r_[0, np.flatnonzero(q[1:] != q[:-1]) + 1] if len(q) else np.zeros(0, np.int64)
    nth = np.arange(len(q)) - np.repeat(heads, np.diff(np.r_[heads, len(q)]))
    ok = nth < k
    best, score = np.full((len(queries), k), -1, np.int64), np.full((len(queries), k), -2, np.float32)
    best[q[ok], nth[ok]], score[q[ok], nth[ok]] = m[ok], s[ok]
    return best, score


def search_distinct(members: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, leaf: int = LEAF, recall: float = RECALL, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """search() without regard to copies: best bin first."""
    n, nq = len(members), len(queries)
    best = np.full((nq, k), -1, np.int64)
    score = np.full((nq, k), -2, np.float32)
    if not n or not nq:
        return best, score
    rng = np.random.default_rng(seed)
    leaves = max(1, round(n / leaf))
    fit = members[rng.choice(n, min(n, 24 * leaves), replace=False)]
    c = kmeans(fit, leaves, 5)
    leaves = len(c)
    home = (members @ c.T).argmax(axis=1)
    order = np.argsort(home, kind="stable")
    starts = np.r_[0, np.cumsum(np.bincount(home, minlength=leaves))]
    trial = rng.choice(nq, min(nq, CALIBRATION), replace=False)
    sims = queries[trial] @ members.T
    mine = own[trial] >= 0
    sims[np.flatnonzero(mine), own[trial][mine]] = -2
    near = np.argpartition(-sims, min(k, n - 1), axis=1)[:, :k]
    queue = np.argsort(-(queries[trial] @ c.T), axis=1, kind="stable").astype(np.int32)  # each query's leaves by priority
    place = np.empty_like(queue)
    np.put_along_axis(place, queue, np.arange(leaves, dtype=np.int32)[None, :].repeat(len(trial), 0), axis=1)
    visits = int(np.quantile(np.take_along_axis(place, home[near], axis=1), recall, method="higher")) + 1
    for at in range(0, nq, BLOCK):  # bounds the queues
        part = slice(at, at + BLOCK)
        _visit(members, queries[part], own[part], c, order, starts, visits, best[part], score[part])
    return best, score


def _visit(members: np.ndarray, queries: np.ndarray, own: np.ndarray, c: np.ndarray, order: np.ndarray, starts: np.ndarray, visits: int, best: np.ndarray, score: np.ndarray) -> None:
    """Fills in the best members and scores of the queries from so many of their nearest leaves (members `order` from `starts` on, centroids c)."""
    k, leaves = best.shape[1], len(c)
    queue = np.argsort(-(queries @ c.T), axis=1, kind="stable").astype(np.int32)
    for turn in range(visits):
        at = queue[:, turn]
        by = np.argsort(at, kind="stable")
        edges = np.r_[0, np.cumsum(np.bincount(at, minlength=leaves))]
        found = []
        for j in range(leaves):
            q, m = by[edges[j] : edges[j + 1]], order[starts[j] : starts[j + 1]]
            if not len(q) or not len(m):
                continue
            s = queries[q] @ members[m].T
            if turn == 0 and len(m) > 4 * k:  # nothing to compare with yet: the leaf's own k best
                top = np.argpartition(-s, k, axis=1)[:, : k + 1]
                found.append((q.repeat(k + 1), m[top].ravel(), np.take_along_axis(s, top, axis=1).ravel()))
                continue
            a, b = np.nonzero(s > score[q, k - 1][:, None])
            found.append((q[a], m[b], s[a, b]))
        if found:
            q, m, s = (np.concatenate(x) for x in zip(*found, strict=True))
            keep = m != own[q]
            q, m, s = q[keep], m[keep], s[keep]
            touched = np.unique(q)
            q = np.concatenate([q, touched.repeat(k)])
            m, s = np.concatenate([m, best[touched].ravel()]), np.concatenate([s, score[touched].ravel()])
            rank = np.lexsort((m, -s, q))
            q, m, s = q[rank], m[rank], s[rank]
            first = np.r_[0, np.flatnonzero(q[1:] != q[:-1]) + 1]
            nth = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
            ok = nth < k
            best[q[ok], nth[ok]], score[q[ok], nth[ok]] = m[ok], s[ok]


def copies(names: pa.Array, vec: pa.Array) -> np.ndarray:
    """The number of each row's distinct (index, vector) in a batch."""
    i, v = names.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False), vec.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return np.unique(i.astype(np.int64) << 32 | v, return_inverse=True)[1]


def _crowds(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Takes all but the k + 1 least ids of very many copies out of a batch: they become rows of one vector with a list of ids, in cells below 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, ids, vec, places = b.columns
            group = copies(names, vec)
            many = np.bincount(group, minlength=1) > k + 1
            crowd = many[group]
            yield pa.RecordBatch.from_arrays([names, ids, vec, places, pa.array(crowd), pa.nulls(len(ids), pa.list_(pa.int64()))], CROWDED).filter(pa.array(_kept(ids.to_numpy(), group, crowd, k)))
            for g in np.flatnonzero(many).tolist():
                rows = np.flatnonzero(group == g)
                others = np.sort(ids.to_numpy()[rows])[k + 1 :].tolist()
                one = slice(int(rows[0]), int(rows[0]) + 1)
                cell = [-2 * (1 + others[0] % SALTS)]
                yield pa.RecordBatch.from_arrays(
                    [names[one], pa.nulls(1, pa.int64()), vec[one], pa.array([cell], pa.list_(pa.int64())), pa.array([True]), pa.array([others], pa.list_(pa.int64()))], CROWDED
                )

    return run


CROWDED = ["index_name", "node_id", "vec", "places", "crowd", "waiting"]


def _kept(ids: np.ndarray, group: np.ndarray, crowd: np.ndarray, k: int) -> np.ndarray:
    keep = ~crowd
    for g in np.unique(group[crowd]).tolist():
        rows = np.flatnonzero(group == g)
        keep[rows[np.argsort(ids[rows], kind="stable")[: k + 1]]] = True
    return keep


def crowded(vectors: DataFrame, k: int) -> DataFrame:
    """Copies that wait taken out of the vectors, see _crowds()."""
    return vectors.select("index_name", "node_id", "vec", "places").mapInArrow(_crowds(k), "index_name string, node_id bigint, vec binary, places array<bigint>, crowd boolean, waiting array<bigint>")


def by_cell(vectors: DataFrame, k: int) -> DataFrame:
    """One row per vector and place: the cell, whether it is a member there, and crowds in cells below 0."""
    return _exploded(crowded(vectors, k))


def _exploded(thin: DataFrame) -> DataFrame:
    placed = thin.select("index_name", "node_id", "vec", "crowd", "waiting", F.explode("places").alias("place"))
    return placed.select("index_name", F.shiftright("place", 1).alias("cell"), "node_id", "vec", ((F.col("place") % 2) == 1).alias("is_home"), "crowd", "waiting")


FOUND = "index_name string, node_id bigint, crowd binary, salt bigint, neighbours array<bigint>, sims array<float>, waiting array<bigint>"


def _neighbours(k: int, first: bool = True) -> Callable[[pa.Table], pa.Table]:
    """The search of a cell; the members and crowds ask in the first pass only."""
    names = [f.split()[0] for f in FOUND.split(", ")]

    def run(t: pa.Table) -> pa.Table:
        n, cell = t.num_rows, t.column("cell")[0].as_py() if t.num_rows else 0
        index = t.column("index_name")[0].as_py() if n else None
        if cell < 0:  # ids that wait for the answer to their vector
            none = pa.array([[]] * n, pa.list_(pa.int64()))
            return pa.Table.from_arrays([t.column("index_name"), t.column("node_id"), t.column("vec"), pa.array([-1 - cell] * n, pa.int64()), none, none.cast(pa.list_(pa.float32())), t.column("waiting")], names=names)
        t = t.sort_by("node_id")
        x, ids = matrix(t.column("vec")), t.column("node_id").to_numpy()
        home = t.column("is_home").to_numpy()
        member = np.flatnonzero(home)
        own = np.full(n, -1)
        own[member] = np.arange(len(member))
        asked = np.flatnonzero(home & t.column("crowd").to_numpy()) if first else np.zeros(0, np.int64)
        asked = asked[np.unique(copies(t.column("index_name").combine_chunks(), t.column("vec").combine_chunks())[asked], return_index=True)[1]]
        crowds = t.column("vec").take(pa.array(asked)).to_pylist()
        of, names_of = x[member], ids[member]
        if not first:
            x, ids, own, n = x[~home], ids[~home], own[~home], n - len(member)
        best, score = search(of, np.concatenate([x, x[asked]]), np.concatenate([own, np.full(len(asked), -1)]), k)
        row = np.concatenate([np.arange(n), np.repeat(np.arange(n, n + len(asked)), SALTS)])  # a crowd's answer goes to each of its salts
        best, score = best[row], score[row]
        held = best >= 0
        counts = np.r_[0, np.cumsum(held.sum(axis=1))].astype(np.int32)
        near = pa.ListArray.from_arrays(pa.array(counts), pa.array(names_of[best[held]] if len(member) else np.zeros(0, np.int64)))
        sims = pa.ListArray.from_arrays(pa.array(counts), pa.array(score[held]))
        extra = len(row) - n
        node = pa.array(np.concatenate([ids, np.zeros(extra, np.int64)]), mask=np.arange(len(row)) >= n)
        vec = pa.array([None] * n + [v for v in crowds for _ in range(SALTS)], pa.binary())
        salt = pa.array(np.concatenate([np.zeros(n, np.int64), np.tile(np.arange(SALTS), len(asked))]))
        return pa.Table.from_arrays([pa.array([index] * len(row), pa.string()), node, vec, salt, near, sims, pa.array([[]] * len(row), pa.list_(pa.int64()))], names=names)

    return run


def nearest(entries: DataFrame, indexes: DataFrame, k: int = 10) -> DataFrame:
    """index_name, node_id, neighbour, similarity, rank: the k most similar current, usable vectors of the same index."""
    trees = fit_trees(entries, indexes, k)
    of = turns(trees)
    if of == 1:
        merged = _merged(_found(by_cell(current_routed(packed(entries, indexes), trees), k), k), k)
    else:
        merged = _in_turns(current(packed(entries, indexes)), trees, k, of)
    nodes = F.when(F.col("node_id").isNotNull(), F.array("node_id")).otherwise(F.col("waiting"))
    rows = merged.select("index_name", F.explode(nodes).alias("node_id"), "near").select("index_name", "node_id", F.posexplode("near").alias("pos", "x"))
    return rows.select("index_name", "node_id", F.col("x.n").alias("neighbour"), (-F.col("x.s").cast("double")).alias("similarity"), (F.col("pos") + 1).alias("rank"))


def _found(cells: DataFrame, k: int, first: bool = True) -> DataFrame:
    pairs = F.transform(F.arrays_zip("neighbours", "sims"), lambda x: F.struct((-x.sims).alias("s"), x.neighbours.alias("n")))
    found = cells.groupBy("index_name", "cell").applyInArrow(_neighbours(k, first), FOUND)
    return found.select("index_name", "node_id", "crowd", "salt", pairs.alias("near"), "waiting")


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; those of several cells have k pairs from each. One aggregation for all, so that no cell is searched twice."""
    near, waiting = F.flatten(F.collect_list("near")), F.flatten(F.collect_list("waiting"))
    return found.groupBy("index_name", "node_id", "crowd", "salt").agg(F.slice(F.array_sort(near), 1, k).alias("near"), waiting.alias("waiting"))


def _in_turns(vectors: DataFrame, trees: dict[str, Tree], k: int, of: int) -> DataFrame:
    """The k best of each query from passes that hold a part of the visits each; what a pass wrote goes after the next."""
    none = F.array().cast("array<bigint>")
    thin = crowded(vectors.withColumn("places", none), k)
    thin = written(thin.select("index_name", "node_id", "crowd", "vec", "waiting", F.col("places").alias("fixed")))
    merged: DataFrame | None = None
    for turn in range(of):
        placed = routed(thin, trees, "index_name string, node_id bigint, crowd boolean, vec binary, waiting array<bigint>, fixed array<bigint>", turn, of)
        places = F.when(F.col("node_id").isNotNull(), F.col("places")).otherwise(F.col("fixed") if turn == 0 else none)
        found = _found(_exploded(placed.withColumn("places", places)), k, turn == 0)
        so_far = written(_merged(found if merged is None else found.unionByName(merged), k))
        if merged is not None:
            discard(merged)
        merged = so_far
    discard(thin)
    assert merged is not None
    return merged


def current_routed(versions: DataFrame, trees: dict[str, Tree]) -> DataFrame:
    """Routing comes before the one shuffle by key, so vectors pass through Python once."""
    latest = Window.partitionBy("index_name", "node_id").orderBy(F.col("updated_at").desc_nulls_last(), F.col("vec"))
    return routed(versions, trees).withColumn("_n", F.row_number().over(latest)).where((F.col("_n") == 1) & F.col("vec").isNotNull()).drop("_n", "updated_at")


def exact_nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """index_name, node_id, sims: the k greatest similarities of each query vector to all vectors of its index but itself, by brute force.

    For a stated set of queries: they go to the workers in blocks of QUERIES, each block against all vectors, of which every batch leaves k a query.
    """
    parts = []
    block: dict[str, list[tuple[int, bytes]]] = {}
    rows = queries.select("index_name", "node_id", "vec").toLocalIterator()
    while True:
        block = {}
        for r in itertools.islice(rows, QUERIES):
            block.setdefault(r.index_name, []).append((r.node_id, bytes(r.vec)))
        if not block:
            break
        held = {i: (np.array([n for n, _ in v]), np.frombuffer(b"".join(x for _, x in v), np.float32).reshape(len(v), -1)) for i, v in block.items()}

        def run(batches: Iterator[pa.RecordBatch], held: dict = held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i, at in by_name(b.column(0), held):
                    ids, q = held[i]
                    s = q @ matrix(b.column(2).take(pa.array(at))).T
                    s[ids[:, None] == b.column(1).to_numpy()[at][None, :]] = -2
                    top = -np.sort(-s, axis=1)[:, :k]
                    flat = pa.array(top.ravel().astype(np.float64))
                    offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * top.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(ids), pa.string()), pa.array(ids), pa.ListArray.from_arrays(offsets, flat)], ["index_name", "node_id", "sims"])

        found = vectors.select("index_name", "node_id", "vec").mapInArrow(run, "index_name string, node_id bigint, sims array<double>")
        best = F.slice(F.sort_array(F.flatten(F.collect_list("sims")), False), 1, k)
        parts.append(found.groupBy("index_name", "node_id").agg(F.filter(best, lambda x: x > -2).alias("sims")))
    if not parts:
        return vectors.sparkSession.createDataFrame([], "index_name string, node_id bigint, sims array<double>")
    return reduce(DataFrame.unionByName, parts)


def recall(entries: DataFrame, indexes: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """index_name, n_queries, recall of nearest() by brute force, for the vectors whose id is divisible by `every` against all; equal similarities count alike."""
    vectors = written(current(packed(entries, indexes)))
    exact = exact_nearest(vectors, vectors.where(F.col("node_id") % every == 0), k)
    got = nearest(entries, indexes, k).where(F.col("node_id") % every == 0).groupBy("index_name", "node_id").agg(F.collect_list("similarity").alias("got"))
    both = exact.join(got, ["index_name", "node_id"], "left")
    hits = F.size(F.filter("got", lambda x: x >= F.element_at("sims", -1) - 1e-5))
    counted = both.where(F.size("sims") > 0).select("index_name", F.greatest(F.coalesce(hits, F.lit(0)), F.lit(0)).alias("hits"), F.size("sims").alias("n"))
    return counted.groupBy("index_name").agg(F.count("*").alias("n_queries"), (F.sum(F.least("hits", "n")) / F.sum("n")).alias("recall"))


def similar_pairs(neighbours: DataFrame, least: float = 0.95) -> DataFrame:
    """index_name, node_a < node_b of pairs at least so similar of which one is among the other's neighbours."""
    close = neighbours.where(F.col("similarity") >= least)
    return close.select("index_name", F.least("node_id", "neighbour").alias("node_a"), F.greatest("node_id", "neighbour").alias("node_b")).distinct()
