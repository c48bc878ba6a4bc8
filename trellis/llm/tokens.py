"""Encoding of a corpus with a public byte-level BPE tokenizer.

The pieces of each text are cut in the JVM; in a worker every distinct piece of a batch is encoded once. The
merges use a pair occurrence index: each pair's rank maps to all its positions in the batch, ranks are applied
in ascending order to all their positions at once, and the lists of the pairs that arise are updated. A pair
can only arise after both its tokens, so its rank is above the one being applied and one ascending pass is exact.

Defined results: empty and null texts have no ids (an empty list); strings of special tokens are ordinary
text; repeated rows each keep theirs; extra columns stay out.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("TRELLIS_TOKENIZERS", "/opt/tokenizers")
# The public tokenizer's splitting pattern and its alphabet of visible bytes, with Unicode's white space spelled out for Java.
SPACE = "\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
PATTERN = f"'s|'t|'re|'ve|'m|'ll|'d| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{SPACE}\\p{{L}}\\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
VISIBLE = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
NONE = np.int32(2**31 - 1)
BATCH_PIECES = 8 << 20


class Merges:
    """The tokenizer's tables as arrays: id of each byte, sorted pair keys with rank and resulting id."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        hidden = [b for b in range(256) if b not in set(VISIBLE)]
        letter = {b: chr(b) for b in VISIBLE} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.byte_ids = np.array([vocab[letter[b]] for b in range(256)], np.int32)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.arange(len(pairs), dtype=np.int32)[order]
        self.results = np.array([vocab[a + b] for a, b in pairs], np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


def _by_rank(ranks: np.ndarray, positions: np.ndarray, index: dict[int, list[np.ndarray]], heap: list[int]) -> None:
    """Adds positions to the lists of their ranks."""
    good = ranks != NONE
    ranks, positions = ranks[good], positions[good]
    if not len(ranks):
        return
    order = np.argsort(ranks, kind="stable")
    ranks, positions = ranks[order], positions[order]
    starts = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]])
    ends = [*starts[1:].tolist(), len(ranks)]
    for r, a, b in zip(ranks[starts].tolist(), starts.tolist(), ends, strict=True):
        if r in index:
            index[r].append(positions[a:b])
        else:
            index[r] = [positions[a:b]]
            heapq.heappush(heap, r)


def encode_pieces(data: np.ndarray, offsets: np.ndarray, m: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids and their offsets for the pieces data[offsets[i]:offsets[i+1]] (non-empty)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    symbol = m.byte_ids[data]
    nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    nxt[offsets[1:] - 1] = -1
    prv[offsets[:-1]] = -1
    alive = np.ones(n, bool)
    rank = np.full(n, NONE)
    inner = np.flatnonzero(nxt >= 0).astype(np.int32)
    rank[inner] = m.rank(symbol[inner], symbol[inner + 1])
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []
    _by_rank(rank[inner], inner, index, heap)
    while heap:
        r = heapq.heappop(heap)
        lists = index.pop(r)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        at = at[rank[at] == r]
        if not len(at):
            continue
        if len(at) > 1:
            follows = np.flatnonzero(nxt[at[:-1]] == at[1:]) + 1  # overlapping occurrences of a pair of equal tokens
            if len(follows):
                chained = np.zeros(len(at), np.int64)
                chained[follows] = 1
                k = np.arange(len(at))
                first = np.maximum.accumulate(np.where(chained == 0, k, 0))
                at = at[(k - first) % 2 == 0]
        gone = nxt[at]
        after = nxt[gone]
        symbol[at] = m.results[r]
        alive[gone] = False
        rank[gone] = NONE
        nxt[at] = after
        has = after >= 0
        prv[after[has]] = at[has]
        rank[at] = NONE
        right = at[has]
        new = m.rank(symbol[right], symbol[after[has]])
        rank[right] = new
        before = prv[at]
        left = before[before >= 0]
        if len(left):
            new_left = m.rank(symbol[left], symbol[nxt[left]])
            rank[left] = new_left
            new, right = np.concatenate([new, new_left]), np.concatenate([right, left])
        if len(right):
            _by_rank(new, right, index, heap)
    counts = np.add.reduceat(alive.astype(np.int64), offsets[:-1])
    return symbol[alive], np.r_[0, np.cumsum(counts)]


def _batch(doc_id: pa.Array, pieces: pa.ListArray, m: Merges) -> pa.RecordBatch:
    bounds = pieces.offsets.to_numpy().astype(np.int64)
    words = pieces.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    bounds = bounds - bounds[0]
    code = words.indices.to_numpy()
    own = words.dictionary.cast(pa.large_string())
    if own.offset:
        own = pa.concat_arrays([own])
    offsets = np.frombuffer(own.buffers()[1], np.int64, len(own) + 1)
    data = np.frombuffer(own.buffers()[2], np.uint8)[: offsets[-1]] if len(own) else np.zeros(0, np.uint8)
    ids, starts = encode_pieces(data, offsets, m)
    size = np.diff(starts)[code] if len(code) else np.zeros(0, np.int64)
    ends = np.r_[0, np.cumsum(size)]
    at = np.repeat(starts[code] - ends[:-1], size) + np.arange(ends[-1]) if len(code) else np.zeros(0, np.int64)
    out = pa.ListArray.from_arrays(pa.array(ends[bounds], pa.int32()), pa.array(ids[at], pa.int32()))
    return pa.RecordBatch.from_arrays([doc_id, out], ["doc_id", "ids"])


def encode(documents: DataFrame, path: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """doc_id, ids of every document's whole text."""
    m = Merges(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, counts = 0, pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
            while k < b.num_rows:  # texts of at most so many pieces at a time, or one long text
                total = np.cumsum(counts[k:])
                n = max(1, int(np.searchsorted(total, BATCH_PIECES, side="right")))
                part = b.slice(k, n)
                yield _batch(part.column(0), part.column(1), m)
                k += n

    pieces = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(PATTERN), F.lit(0))
    return documents.select("doc_id", pieces.alias("pieces")).mapInArrow(run, "doc_id bigint, ids array<int>")
