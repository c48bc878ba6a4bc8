"""Nested JSON texts turned into flat child tables linked to owner and parent.

A block of texts is one Arrow buffer. Its structural characters outside strings are found by array
arithmetic; running sums give each container's depth; per depth, the parent of every container is the last
opening one level up (a sorted search), array positions are differences of running comma counts, and paths
are propagated downwards by `take`. No value is visited row by row. Which texts are strict JSON is found in the same
way: within each container, ordered by depth and place, every token must be allowed after the one before it.

Defined results: null, empty and invalid texts give no rows, nor do those with half a surrogate pair as an escape
(no UTF-8 text can hold it) or more than MOST_LEVELS levels, as JSON readers bound their depth; a scalar on top gives none; exact copies of an owner give each row once; an object
inside a top-level array has parent ''; extra columns stay out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 8 << 20
OBJECTS = "owner_table string, owner_id bigint, path string, parent_path string, depth int, position int"
FIELDS = "owner_table string, owner_id bigint, path string, parent_path string, key string, position int, kind string, value string"
MOST_LEVELS = 1000
NUMBER = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
# Kinds of tokens within a container, and for each what may come before it in an object and in an array.
OPEN, CLOSE, COMMA, COLON, KEY, VALUE = range(6)
BEFORE_IN_OBJECT = {CLOSE: (OPEN, VALUE), COMMA: (VALUE,), COLON: (KEY,), KEY: (OPEN, COMMA), VALUE: (COLON,)}
BEFORE_IN_ARRAY = {CLOSE: (OPEN, VALUE), COMMA: (VALUE,), VALUE: (OPEN, COMMA)}


def _slices(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The texts buf[start:end] as one Arrow string array."""
    n = np.maximum(end - start, 0)
    offsets = np.zeros(len(n) + 1, np.int32)
    np.cumsum(n, out=offsets[1:])
    at = np.repeat(start - offsets[:-1], n) + np.arange(offsets[-1])
    return pa.StringArray.from_buffers(len(n), pa.py_buffer(offsets.tobytes()), pa.py_buffer(buf[at].tobytes()))


def _keys(raw: pa.Array) -> pa.Array:
    if pc.any(pc.match_substring(raw, "\\")).as_py():
        return pa.array([json.loads(f'"{x}"') if "\\" in x else x for x in raw.to_pylist()], pa.string())
    return raw


def _join(*parts: object) -> pa.Array:
    return pc.binary_join_element_wise(*parts, "")


class Shape:
    """The containers of a block of valid JSON texts: row, level, parent, position, path, enclosing object's path."""

    def __init__(self, texts: pa.Array) -> None:
        texts = pa.concat_arrays([texts]) if texts.offset else texts
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1)
        self.buf = buf = np.frombuffer(texts.buffers()[2], np.uint8)[: offsets[-1]] if texts.buffers()[2] else np.zeros(0, np.uint8)
        at = np.arange(len(buf), dtype=np.int32)
        plain = np.maximum.accumulate(np.where(buf != 92, at, -1)) if len(buf) else at
        quote = buf == 34
        if len(buf):
            quote[1:] &= ((at[:-1] - plain[:-1]) & 1) == 0
        self.quotes = np.flatnonzero(quote)
        inside = (np.cumsum(quote) & 1).astype(bool)
        table = np.zeros(256, np.int8)
        table[[123, 91]], table[[125, 93]], table[[44, 58]] = 1, -1, 2
        kind = table[buf]
        self.at = np.flatnonzero((kind != 0) & ~inside)
        self.char = buf[self.at]
        step = np.where(kind[self.at] == 2, 0, kind[self.at]).astype(np.int32)
        depth = np.cumsum(step)
        opens = np.flatnonzero(step == 1)
        self.open_at = o = self.at[opens]
        self.level = depth[opens]
        self.is_object = self.char[opens] == 123
        self.row = np.searchsorted(offsets, o, side="right") - 1
        n = len(o)
        self.parent, self.position = np.full(n, -1), np.full(n, -1)
        before = np.where(opens > 0, self.char[opens - 1], 0)
        self.named = (before == 58) & (self.level > 1)
        comma = self.char == 44
        paths: list[pa.Array] = []
        self.path_of = np.zeros(n, np.int64)
        self.commas, self.depth, self.offsets = [], depth, offsets
        of_level = [np.flatnonzero(self.level == level) for level in range(1, int(self.level.max(initial=0)) + 1)]
        done = 0
        for level, own in enumerate(of_level, 1):
            self.commas.append(self.at[comma & (depth == level)])
            if level == 1:
                path = pa.array([""] * len(own), pa.string())
            else:
                up = of_level[level - 2]
                parent = up[np.searchsorted(o[up], o[own]) - 1]
                self.parent[own] = parent
                c = self.commas[level - 2]
                self.position[own] = np.where(self.named[own], -1, np.searchsorted(c, o[own]) - np.searchsorted(c, o[parent]))
                path = self._extend(paths[-1].take(pa.array(self.path_of[parent] - done)), self._names(self.at[opens[own] - 1], self.named[own]), self.position[own])
                done += len(up)
            self.path_of[own] = done + np.arange(len(own))
            paths.append(path)
        self.paths = pa.concat_arrays(paths) if paths else pa.array([], pa.string())
        self.owner_object = np.full(n, -1)  # the nearest enclosing object
        for own in of_level[1:]:
            p = self.parent[own]
            self.owner_object[own] = np.where(self.is_object[p], p, self.owner_object[p])

    def _names(self, colons: np.ndarray, named: np.ndarray) -> pa.Array:
        """The key before each colon; empty where there is none."""
        k = np.searchsorted(self.quotes, colons) - 1
        start = np.where(named, self.quotes[np.maximum(k - 1, 0)] + 1 if len(self.quotes) else 0, 0)
        end = np.where(named, self.quotes[np.maximum(k, 0)] if len(self.quotes) else 0, 0)
        return _keys(_slices(self.buf, start, end))

    @staticmethod
    def _extend(up: pa.Array, names: pa.Array, position: np.ndarray) -> pa.Array:
        dot = pc.if_else(pc.equal(up, ""), "", ".")
        index = _join("[", pa.array(position).cast(pa.string()), "]")
        return pc.if_else(pa.array(position >= 0), _join(up, index), _join(up, dot, names))

    def path(self, which: np.ndarray) -> pa.Array:
        """Paths of containers; the empty text for -1."""
        return self.paths.take(pa.array(self.path_of[np.maximum(which, 0)], mask=which < 0)).fill_null("") if len(self.paths) else pa.array([""] * len(which), pa.string())

    def objects(self) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray, np.ndarray]:
        own = np.flatnonzero(self.is_object & (self.level > 1))
        return self.row[own], self.path(own), self.path(self.owner_object[own]), self.level[own] - 1, self.position[own]

    def fields(self) -> tuple[np.ndarray, pa.Array, pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]:
        """Scalars inside containers: row, path, nearest object's path, key or position, kind, text (strings decoded, others as written)."""
        # a scalar stands after an opening bracket of an array, a comma of an array or a colon, and goes up to the next structural character
        nxt = np.append(self.at[1:], len(self.buf))
        after = np.append(self.char[1:], 0)
        inside = np.full(len(self.at), -1)  # innermost container after each structural character
        for level in np.unique(self.depth[self.depth > 0]):
            up = np.flatnonzero(self.level == level)
            here = np.flatnonzero(self.depth == level)
            inside[here] = up[np.searchsorted(self.open_at[up], self.at[here], side="right") - 1]
        in_object = self.is_object[np.maximum(inside, 0)] if len(self.open_at) else np.zeros(len(self.at), bool)
        starts = (self.char == 58) | (((self.char == 91) | (self.char == 44)) & ~in_object & (inside >= 0))
        own = np.flatnonzero(starts & (after != 123) & (after != 91))
        text = pc.ascii_trim_whitespace(_slices(self.buf, self.at[own] + 1, nxt[own]))
        some = pc.not_equal(text, "").to_numpy(zero_copy_only=False)  # an empty array has no scalar
        own, text = own[some], text.filter(pa.array(some))
        holder, named = inside[own], self.char[own] == 58
        position = np.full(len(own), -1)
        depth = self.depth[own]
        for level in np.unique(depth):
            here = np.flatnonzero((depth == level) & ~named)
            c = self.commas[level - 1]
            position[here] = np.searchsorted(c, self.at[own[here]], side="right") - np.searchsorted(c, self.open_at[holder[here]])
        names = self._names(self.at[own], named)
        path = self._extend(self.path(holder), names, position)
        objects = np.where(self.is_object[holder], holder, self.owner_object[holder]) if len(own) else holder
        quoted = pc.starts_with(text, '"')
        kind = pc.if_else(quoted, "string", pc.if_else(pc.is_in(text, pa.array(["true", "false"])), "boolean", pc.if_else(pc.equal(text, "null"), "null", "number")))
        value = pc.if_else(quoted, _keys(pc.utf8_slice_codeunits(text, 1, -1)), text)
        key = pc.if_else(pa.array(named), names, pa.scalar(None, pa.string()))
        row = self.row[holder] if len(own) else holder
        return row, path, self.path(objects), key, pa.array(position, pa.int32(), mask=position < 0), kind, value


def _escapes(buf: np.ndarray, active: np.ndarray) -> np.ndarray:
    """Positions of the active backslashes that begin no valid escape, half surrogate pairs included."""
    padded = np.append(buf, np.zeros(6, np.uint8))
    kind = padded[active + 1]
    hexed = np.full(256, -1, np.int32)
    for digits, base in ((b"0123456789", 0), (b"abcdef", 10), (b"ABCDEF", 10)):
        hexed[list(digits)] = np.arange(base, base + len(digits))
    digits = hexed[padded[active[:, None] + np.arange(2, 6)]]
    code = np.where((kind == 117) & (digits >= 0).all(axis=1), digits @ np.array([4096, 256, 16, 1]), -1)
    bad = ~np.isin(kind, np.frombuffer(b'"\\/bfnrtu', np.uint8)) | ((kind == 117) & (code < 0))
    high, low = (code >= 0xD800) & (code < 0xDC00), (code >= 0xDC00) & (code < 0xE000)
    joined = np.zeros(len(active), bool)  # with the next escape
    joined[:-1] = high[:-1] & low[1:] & (active[1:] == active[:-1] + 6)
    bad |= high & ~joined
    bad |= low & ~np.append(False, joined[:-1])
    return active[bad]


def strict(texts: pa.Array, most_levels: int = MOST_LEVELS) -> np.ndarray:
    """Which texts of a string array are strict JSON, by array arithmetic over the whole buffer; null ones are not."""
    texts = pa.concat_arrays([texts]) if texts.offset else texts
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32, n + 1).astype(np.int64) if n else np.zeros(1, np.int64)
    good = np.asarray(texts.is_valid()) & (np.diff(offsets) > 0)
    if not good.any():
        return good
    buf = np.frombuffer(texts.buffers()[2], np.uint8)[: offsets[-1]]
    at = np.arange(len(buf))
    row = np.repeat(np.arange(n), np.diff(offsets))
    first = offsets[row]
    slash = buf == 92
    run = at - np.maximum(np.maximum.accumulate(np.where(slash, -1, at)), first - 1)  # length of the run of backslashes that ends here
    quote = buf == 34
    quote[1:] &= ~((run[:-1] & 1).astype(bool) & (row[1:] == row[:-1]))
    count = np.cumsum(quote)
    before = np.append(0, count)[offsets[:-1]]  # quotes before each row
    inside = (((count - before[row]) & 1) == 1) & ~quote
    good &= ((np.append(0, count)[offsets[1:]] - before) & 1) == 0
    wrong = inside & (buf < 32)
    wrong[slash & ~inside] = True
    good[row[wrong]] = False
    active = np.flatnonzero(slash & inside & ((run & 1) == 1))
    if len(active):
        good[row[_escapes(buf, active)]] = False
    # tokens: structural characters, opening quotes, and runs of other characters outside strings
    table = np.zeros(256, np.int8)
    table[[123, 91]], table[[125, 93]], table[44], table[58], table[[32, 9, 10, 13]] = 1, 2, 3, 4, 5
    kind = table[buf]
    outside = ~inside & ~quote
    starts = quote & (((count - before[row]) & 1) == 1)
    plain = outside & (kind == 0)
    head = plain.copy()
    head[1:] &= ~(plain[:-1] & (row[1:] == row[:-1]))
    tail = plain.copy()
    tail[:-1] &= ~(plain[1:] & (row[1:] == row[:-1]))
    words = _slices(buf, np.flatnonzero(head), np.flatnonzero(tail) + 1)
    unlike = ~pc.match_substring_regex(words.cast(pa.binary()), f"^(?:true|false|null|{NUMBER})$").to_numpy(zero_copy_only=False)
    good[row[np.flatnonzero(head)[unlike]]] = False
    token = starts | head | (outside & (kind > 0) & (kind < 5))
    where = np.flatnonzero(token & good[row])
    of, what, own = row[where], np.where(starts[where] | head[where], 0, kind[where]), buf[where]
    step = (what == 1).astype(np.int64) - (what == 2)
    depth = np.cumsum(step)
    depth -= (depth - step)[np.searchsorted(of, of)]  # from 0 in every row
    level = depth + (what == 2)  # a closing bracket belongs to its own container
    good[of[(level < 0) | ((what == 2) & (level < 1)) | (level > most_levels)]] = False
    ends = np.searchsorted(of, np.arange(n), side="right") - 1
    some = np.isin(np.arange(n), of)
    good &= some
    good[some] &= depth[ends[some]] == 0
    keep = good[of]
    where, of, what, own, level = where[keep], of[keep], what[keep], own[keep], level[keep]
    # An opening bracket is a value of the container around it and the first token of its own.
    opens = np.flatnonzero(what == 1)
    text = starts[where]
    place = np.concatenate([np.arange(len(where)) * 2, opens * 2 - 1])
    levels = np.concatenate([level, level[opens] - 1])
    kinds = np.concatenate([np.select([what == 1, what == 2, what == 3, what == 4], [OPEN, CLOSE, COMMA, COLON], VALUE), np.full(len(opens), VALUE)])
    rows, chars, texty = np.concatenate([of, of[opens]]), np.concatenate([own, own[opens]]), np.concatenate([text, np.zeros(len(opens), bool)])
    order = np.lexsort((place, levels))
    levels, kinds, rows, chars, texty = levels[order], kinds[order], rows[order], chars[order], texty[order]
    top = levels == 0
    good &= np.bincount(rows[top], minlength=n) == 1
    good[rows[top & (kinds != VALUE)]] = False
    kinds, rows, chars, texty = kinds[~top], rows[~top], chars[~top], texty[~top]
    if not len(kinds):
        return good
    last = np.maximum.accumulate(np.where(kinds == OPEN, np.arange(len(kinds)), 0))
    in_object = chars[last] == 123
    prev = np.append(CLOSE, kinds[:-1])
    kinds = np.where(in_object & texty & ((prev == OPEN) | (prev == COMMA)), KEY, kinds)
    prev = np.append(CLOSE, kinds[:-1])
    allowed = np.zeros((2, 6, 6), bool)
    for at_object, rules in ((1, BEFORE_IN_OBJECT), (0, BEFORE_IN_ARRAY)):
        for k, fine in rules.items():
            allowed[at_object, k, list(fine)] = True
    allowed[:, OPEN, CLOSE] = True
    fits = allowed[in_object.astype(int), kinds, prev]
    fits &= ~((kinds == CLOSE) & ((chars == 125) != in_object))
    good[rows[~fits]] = False
    return good


def _strings(x: pa.Array) -> pa.Array:
    return x.cast(pa.string()) if x.type != pa.string() else x


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    for b in batches:
        n = max(1, min(b.num_rows, BLOCK_BYTES * b.num_rows // max(1, b.column(2).nbytes)))
        for k in range(0, b.num_rows, n):
            part = b.slice(k, n)
            texts = _strings(part.column(2))
            good = pa.array(strict(texts))
            yield part.filter(good), texts.filter(good)


def _objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, texts in _blocks(batches):
        row, path, parent, depth, position = Shape(texts).objects()
        at = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(at), b.column(1).take(at), path, parent, pa.array(depth, pa.int32()), pa.array(position, pa.int32(), mask=position < 0)],
            ["owner_table", "owner_id", "path", "parent_path", "depth", "position"],
        )


def _fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, texts in _blocks(batches):
        row, *columns = Shape(texts).fields()
        at = pa.array(row)
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *columns], ["owner_table", "owner_id", "path", "parent_path", "key", "position", "kind", "value"])


def owners(table: DataFrame, name: str, key: str = "id", column: str = "properties") -> DataFrame:
    return table.select(F.lit(name).alias("owner_table"), F.col(key).alias("owner_id"), F.col(column).alias("properties")).where(F.col("owner_id").isNotNull())


def child_objects(owned: DataFrame) -> DataFrame:
    """One row per nested object of (owner_table, owner_id, properties): its path, its parent's, depth and array position."""
    # Only a text with a second opening brace can hold a nested object, so most rows never leave the JVM.
    return owned.where(F.col("properties").rlike(r"\{.*\{") | F.col("properties").rlike(r"(?s)[\[{].*\{")).mapInArrow(_objects, OBJECTS).distinct()


def scalar_fields(owned: DataFrame) -> DataFrame:
    """One row per scalar in any object or array: the flat child tables in long form, joined to child_objects by owner and parent_path."""
    return owned.where(F.col("properties").rlike(r"[\[{]")).mapInArrow(_fields, FIELDS).distinct()
