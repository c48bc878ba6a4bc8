"""Test items leaking into corpus documents.

The items form a BM25 inverted index with block maxima. Every passage of a document is a query: passages are
the runs of words that all occur in some item, in overlapping windows. An item's threshold is the least
BM25 score that any of its windows of MIN_WORDS words can give, so every passage holding one scores at least
that; impacts are stored divided by it, and block-max WAND retrieves all items of score 1 or more, visiting
only postings whose block maxima can reach it. Retrieved pairs are verified word by word.

Defined results: items of fewer than MIN_WORDS words are never found; null, empty and blank documents hold
none; repeated documents are each reported; words don't run on from one mail part into another; a document
row comes once per item however often it occurs. The items go to the workers in blocks of bounded size.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.mail import readable

MIN_WORDS = 12
WINDOW = 48
BLOCK = 16
K1, B = 1.2, 0.75
ITEMS_PER_PASS = 20_000
WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Index:
    """Postings by term: items in ascending order, impacts over the item's threshold, maxima per block and per term."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        texts = [(i, w) for i, t in items if len(w := words(t or "")) >= MIN_WORDS]
        self.items = [i for i, _ in texts]
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(x for _, t in texts for x in t))}
        lists = [[self.vocabulary[w] for w in t] for _, t in texts]
        df = Counter(x for t in lists for x in set(t))
        mean = sum(map(len, lists)) / max(1, len(lists))
        postings: dict[int, list[tuple[int, float]]] = {}
        self.grams: list[set[tuple[int, ...]]] = []
        for k, t in enumerate(lists):
            norm = K1 * (1 - B + B * len(t) / mean)
            weight = {x: log(1 + (len(lists) - df[x] + 0.5) / (df[x] + 0.5)) * n * (K1 + 1) / (n + norm) for x, n in Counter(t).items()}
            windows = [tuple(t[i : i + MIN_WORDS]) for i in range(len(t) - MIN_WORDS + 1)]
            threshold = min(sum(weight[x] for x in set(w)) for w in windows)
            for x, v in weight.items():
                postings.setdefault(x, []).append((k, v / threshold))
            self.grams.append(set(windows))
        self.docs = {x: [k for k, _ in p] for x, p in postings.items()}
        self.impacts = {x: [v for _, v in p] for x, p in postings.items()}
        self.block_max = {x: [max(v[i : i + BLOCK]) for i in range(0, len(v), BLOCK)] for x, v in self.impacts.items()}
        self.term_max = {x: max(v) for x, v in self.block_max.items()}

    def retrieve(self, terms: set[int], threshold: float = 1 - 1e-9) -> list[int]:
        """Block-max WAND: all items whose score reaches the threshold."""
        cursors = [[self.docs[x][0], 0, x] for x in terms]
        found = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += self.term_max[c[2]]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                return found
            doc = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == doc:
                pivot += 1
            ahead = cursors[: pivot + 1]
            block = 0.0  # of the blocks that may hold doc
            for c in ahead:
                docs, k = self.docs[c[2]], c[1]
                end = k // BLOCK
                while (end + 1) * BLOCK < len(docs) and docs[(end + 1) * BLOCK] <= doc:
                    end += 1
                block += self.block_max[c[2]][end]
            if block >= threshold and cursors[0][0] == doc:
                if sum(self.impacts[c[2]][c[1]] for c in ahead) >= threshold:
                    found.append(doc)
            target = doc + 1 if cursors[0][0] == doc or block < threshold else doc
            if block < threshold:  # nothing before the next block boundary or cursor can reach it
                edge = min((d[e] for c in ahead if (e := (self._block(c, doc) + 1) * BLOCK) < len(d := self.docs[c[2]])), default=None)
                rest = cursors[pivot + 1][0] if pivot + 1 < len(cursors) else None
                edges = [x for x in (edge, rest) if x is not None]
                target = max(doc + 1, min(edges)) if edges else 1 << 60
            keep = []
            for c in ahead:
                docs, k = self.docs[c[2]], c[1]
                while k < len(docs) and docs[k] < target:
                    k += 1
                if k < len(docs):
                    c[0], c[1] = docs[k], k
                    keep.append(c)
            cursors = keep + cursors[pivot + 1 :]
        return found

    def _block(self, c: list[int], doc: int) -> int:
        docs, b = self.docs[c[2]], c[1] // BLOCK
        while (b + 1) * BLOCK < len(docs) and docs[(b + 1) * BLOCK] <= doc:
            b += 1
        return b

    def passages(self, text: str) -> Iterator[list[int]]:
        """Windows over the runs of at least MIN_WORDS words that occur in some item."""
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words(text)], np.int64)
        edges = np.flatnonzero(np.diff(np.r_[False, ids >= 0, False]))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= MIN_WORDS:
                run = ids[a:b].tolist()
                for k in range(0, max(1, len(run) - MIN_WORDS + 1), WINDOW - MIN_WORDS + 1):
                    yield run[k : k + WINDOW]

    def leaked(self, text: str) -> set[int]:
        """Items of which the text holds MIN_WORDS consecutive words."""
        found: set[int] = set()
        for p in self.passages(text):
            grams = None
            for k in self.retrieve(set(p)):
                if k not in found:
                    grams = grams or {tuple(p[i : i + MIN_WORDS]) for i in range(len(p) - MIN_WORDS + 1)}
                    if not grams.isdisjoint(self.grams[k]):
                        found.add(k)
        return {self.items[k] for k in found}


def _against(documents: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    index = Index(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, found = [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if text:
                    own = set().union(*(index.leaked(t) for t in readable(text)))
                    docs += [doc_id] * len(own)
                    found += own
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.int64())], ["doc_id", "item_id"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, item_id bigint")


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id of every document that holds MIN_WORDS consecutive words of an item."""
    rows = sorted({(r.item_id, r.text) for r in items.select("item_id", "text").toLocalIterator() if r.item_id is not None and r.text})
    passes = [rows[k : k + ITEMS_PER_PASS] for k in range(0, len(rows), ITEMS_PER_PASS)] or [[]]
    return reduce(DataFrame.unionByName, (_against(documents, p) for p in passes)).distinct()


def leak_summary(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Per item with a leak: the number of documents that hold it."""
    return leaks(documents, items).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"))
