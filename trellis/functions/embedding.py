"""Embedding functions: any callable from texts to vectors, a registry, and an offline one by hashing words."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.exceptions import TrellisError

Embedder = Callable[[list[str]], list[list[float]]]
REGISTRY: dict[str, Callable[..., Embedder]] = {}


def register(name: str, make: Callable[..., Embedder]) -> None:
    REGISTRY[name] = make


def make(name: str, **config: object) -> Embedder:
    if name not in REGISTRY:
        raise TrellisError(f"unknown embedding function {name}; there are {sorted(REGISTRY)}")
    return REGISTRY[name](**config)


class HashingEmbedder:
    """Words and their neighbours hashed with a sign into a vector of length 1; a text without words is the zero vector."""

    def __init__(self, dim: int = 64) -> None:
        if dim < 1:
            raise TrellisError("a vector has a positive dimension")
        self.dim = dim

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [self.one(t or "") for t in texts]

    def one(self, text: str) -> list[float]:
        words = re.findall(r"[^\W_]+", text.lower())
        out = [0.0] * self.dim
        for w in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]:
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
            out[h % self.dim] += 1.0 if h >> 63 else -1.0
        norm = math.sqrt(sum(x * x for x in out))
        return [x / norm for x in out] if norm else out


register("hashing", HashingEmbedder)


def embed(text: Column, f: Embedder) -> Column:
    """Vectors of a text column, a batch at a time in the workers; null for null."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))  # type: ignore[call-overload]
    def run(texts: pd.Series) -> pd.Series:
        given = texts.notna()
        out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
        vectors = f(texts[given].tolist()) if given.any() else []
        for k, v in zip(texts.index[given], vectors, strict=True):
            out[k] = [float(x) for x in v]
        return out

    return run(text)
