"""Full-text search by BM25 and exact nearest-vector search, as plain DataFrame expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trellis.tables import written

K1, B = 1.2, 0.75
RRF = 60
CHANGES = 16  # of a text index before its documents are written anew


def _accents() -> tuple[str, str]:
    """Latin letters with marks and their plain letters, by Unicode decomposition."""
    pairs = [(chr(c), p[0]) for c in range(0xC0, 0x250) if len(p := [x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)]) == 1 and p[0] != chr(c)]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTS = _accents()


def normal(text: Column) -> Column:
    """Lower case, without accents; only texts that have some are rewritten."""
    return F.lower(F.when(F.regexp_like(text, F.lit("[\u00c0-\u024f]")), F.translate(text, *ACCENTS)).otherwise(text))


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits, without accents."""
    return F.filter(F.split(normal(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def plain_words(text: str) -> list[str]:
    import re

    flat = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    return re.findall(r"[^\W_]+", flat)


class TextQuery:
    """Words (all required), OR between groups, -word or NOT word, "phrases" and prefix*."""

    def __init__(self, query: str) -> None:
        import re

        self.groups: list[list[tuple[str, str]]] = [[]]
        self.banned: list[tuple[str, str]] = []
        ban = False
        for phrase, word in re.findall(r'"([^"]*)"|(\S+)', query):
            if word == "OR":
                self.groups.append([])
                continue
            if word in ("AND", "NOT"):
                ban = word == "NOT"
                continue
            if word.startswith("-") and len(word) > 1:
                ban, word = True, word[1:]
            if phrase:
                terms = [("phrase", " ".join(plain_words(phrase)))]
            elif word.endswith("*"):
                terms = [("prefix", "".join(plain_words(word)))]
            else:
                terms = [("word", w) for w in plain_words(word)]
            (self.banned if ban else self.groups[-1]).extend(t for t in terms if t[1])
            ban = False
        self.groups = [g for g in self.groups if g]

    def terms(self) -> list[tuple[str, str]]:
        return list(dict.fromkeys(t for g in self.groups for t in g))


def frequency(text: Column, term: tuple[str, str]) -> Column:
    """Occurrences in a normal text: of a word, of words with a prefix, or of a run of words."""
    kind, words = term
    body = r"[^\p{L}\p{N}]+".join(words.split(" "))
    return F.regexp_count(text, F.lit(rf"(?<![\p{{L}}\p{{N}}]){body}" + ("" if kind == "prefix" else r"(?![\p{L}\p{N}])")))


def length(text: Column) -> Column:
    """The number of words of a normal text."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+"))


def bm25(docs: DataFrame, key: list[str], text: str, query: str, k: int | None = None, positive_idf: bool = True, stop: frozenset[str] = frozenset()) -> DataFrame:
    """The key columns and score of the documents that satisfy the query, best (greatest) first.

    One pass gives every document's term frequencies and length; one aggregate row of document frequencies and
    the mean length is joined to it; no postings are shuffled. Null and empty texts match nothing. positive_idf
    takes log(1 + x); otherwise log(x), at least 1e-6.
    """
    q = TextQuery(query)
    q.groups = [g for g in ([t for t in g if t[0] != "word" or t[1] not in stop] for g in q.groups) if g]
    terms = q.terms()
    words = docs.select(*key, normal(F.coalesce(text, F.lit(""))).alias("_w"))
    tf = words.select(*key, length(F.col("_w")).alias("_dl"), *(frequency(F.col("_w"), t).cast("double").alias(f"_tf{i}") for i, t in enumerate(terms)), *(frequency(F.col("_w"), t).cast("double").alias(f"_no{i}") for i, t in enumerate(q.banned)))
    stats = tf.agg(F.count("*").alias("_n"), F.avg("_dl").alias("_mean"), *(F.sum((F.col(f"_tf{i}") > 0).cast("bigint")).alias(f"_df{i}") for i in range(len(terms))))
    held = reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (F.col(f"_tf{terms.index(t)}") > 0 for t in g)) for g in q.groups), F.lit(False))
    for i in range(len(q.banned)):
        held = held & (F.col(f"_no{i}") == 0)

    def part(i: int) -> Column:
        n, df, f = F.col("_n"), F.col(f"_df{i}"), F.col(f"_tf{i}")
        ratio = (n - df + 0.5) / (df + 0.5)
        idf = F.ln(1 + ratio) if positive_idf else F.greatest(F.ln(ratio), F.lit(1e-6))
        return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_dl") / F.col("_mean")))

    score = reduce(lambda a, b: a + b, (part(i) for i in range(len(terms))), F.lit(0.0))
    out = tf.where(held).crossJoin(F.broadcast(stats)).select(*key, score.alias("score"))  # stats: one row
    out = out.orderBy(F.col("score").desc(), *key)
    return out if k is None else out.limit(k)


class TextIndex:
    """A text index of its own documents (doc_id, text) beside the graph's; the greater the score, the better.

    Common English words of a query are left out. Adding a document again replaces it, removing it is an anti-join.
    """

    def __init__(self, spark: SparkSession, stop: frozenset[str] | None = None) -> None:
        from pyspark.ml.feature import StopWordsRemover

        self.spark = spark
        self.stop = frozenset(StopWordsRemover.loadDefaultStopWords("english")) if stop is None else stop
        self.docs = spark.createDataFrame([], "doc_id bigint, text string")
        self.changes = 0

    def add(self, docs: DataFrame | list[tuple[int, str]]) -> None:
        new = self.spark.createDataFrame(docs, "doc_id bigint, text string") if isinstance(docs, list) else docs.select("doc_id", "text")
        self.docs = self.docs.join(new, "doc_id", "left_anti").unionByName(new)
        self.changes += 1
        if self.changes % CHANGES == 0:  # so that plans don't grow with the number of changes
            self.docs = written(self.docs)

    def remove(self, ids: list[int]) -> None:
        self.docs = self.docs.where(~F.col("doc_id").isin(*ids))

    def search(self, query: str, k: int = 10) -> DataFrame:
        return bm25(self.docs, ["doc_id"], "text", query, k, stop=self.stop)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarity(a: Column, b: Column, metric: str = "cosine", rerank: bool = False) -> Column:
    """cosine (0 for a zero vector), ip, or l2: the negative distance, squared when re-ranking."""
    if metric == "ip":
        return dot(a, b)
    if metric == "l2":
        squares = F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
        return -squares if rerank else -F.sqrt(squares)
    if metric != "cosine":
        raise ValueError(f"unknown metric {metric}")
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def nearest(vectors: DataFrame, key: str, vector: str, query: list[float], k: int, metric: str = "cosine", rerank: bool = False) -> DataFrame:
    """The k best rows for one query vector, by a scan and a top-k that keeps k rows a task; ties go to the smaller key."""
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = vectors.where(F.size(vector) == len(query)).select(key, similarity(F.col(vector), q, metric, rerank).alias("score"))
    return scored.orderBy(F.col("score").desc(), key).limit(k)


def reciprocal_ranks(frames: list[DataFrame], key: str, k: int, constant: int = RRF, weights: list[float] | None = None, depth: int = 1000) -> DataFrame:
    """Fusion of ranked frames of (key, score), of which the `depth` best rows count: sum of weight / (constant + rank)."""
    parts = []
    for f, w in zip(frames, weights or [1.0] * len(frames), strict=True):
        f = f.orderBy(F.col("score").desc(), key).limit(depth)  # so one task ranks a bounded list
        rank = F.row_number().over(Window.orderBy(F.col("score").desc(), key))  # frames are top-k lists
        parts.append(f.select(key, (F.lit(w) / (constant + rank)).alias("part")))
    fused = reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.sum("part").alias("score"))
    return fused.orderBy(F.col("score").desc(), key).limit(k)


def inverted_lists(vectors: DataFrame, key: str, vector: str, lists: int, seed: int = 7) -> tuple[DataFrame, list[list[float]]]:
    """An inverted-file index: every vector with the number of its nearest centroid, and the centroids, fitted by k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    df = vectors.select(key, vector, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    model = KMeans(k=lists, seed=seed, featuresCol="_v", predictionCol="list").fit(df)
    return model.transform(df).drop("_v"), [list(map(float, c)) for c in model.clusterCenters()]


def probe(index: DataFrame, centroids: list[list[float]], key: str, vector: str, query: list[float], k: int, probes: int = 10, metric: str = "cosine") -> DataFrame:
    """Searches the lists of the nearest centroids only."""
    return nearest(probed(index, centroids, query, probes), key, vector, query, k, metric)


def probed(index: DataFrame, centroids: list[list[float]], query: list[float], probes: int) -> DataFrame:
    """The vectors of the lists whose centroids are nearest to the query."""
    far = [sum((a - b) ** 2 for a, b in zip(c, query, strict=True)) for c in centroids]
    near = sorted(range(len(far)), key=far.__getitem__)[:probes]
    return index.where(F.col("list").isin(*near))
