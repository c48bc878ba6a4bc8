"""Queries of the text and vector problems (1, 3, 7, 8, 9) and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm import clusters, language, leaks, tokens, vectors
from trellis.tables import read, spread

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(read(spark, d, "documents").select("doc_id", "text", "lang"))


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    return vectors.nearest(read(spark, d, "vector_entries"), read(spark, d, "vector_indexes"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return vectors.similar_pairs(_neighbours(spark, d))


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours(spark, d).withColumn("similarity", F.round("similarity", 6))


def p1_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall at 10 by brute force for every vector whose id is divisible by 100."""
    return vectors.recall(read(spark, d, "vector_entries"), read(spark, d, "vector_indexes")).withColumn("recall", F.round("recall", 4))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    members, _ = clusters.clustered(read(spark, d, "vector_entries"), read(spark, d, "vector_indexes"))
    return members.select("index_name", "node_id", "cluster_key")


def p3_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Each cluster's size and its most persistent members."""
    return clusters.clustered(read(spark, d, "vector_entries"), read(spark, d, "vector_indexes"))[1]


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(_documents(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(_documents(spark, d), read(spark, d, "eval_items"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leak_summary(_documents(spark, d), read(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    return language.mislabelled(language.document_languages(language.segments(docs, language.fit_on(docs))))


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    return language.segments(docs, language.fit_on(docs)).select("doc_id", "segment", "lang", F.round("confidence", 4).alias("confidence"), "n_words")


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_neighbours": p1_neighbours,
    "p1_recall": p1_recall,
    "p3_found": p3_found,
    "p3_clusters": p3_clusters,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p8_items": p8_items,
    "p9_found": p9_found,
    "p9_segments": p9_segments,
}
# All pairs, exactly: for the small tables on which the SQL is run.
SQL: dict[str, str] = {
    "p1_found": """
WITH latest AS (SELECT index_name, node_id, max(updated_at) AS at FROM vector_entries GROUP BY ALL),
v AS (
  SELECT DISTINCT e.index_name AS i, e.node_id AS n, CAST(e.vector AS DOUBLE[]) AS x FROM vector_entries e
  JOIN latest l ON l.index_name = e.index_name AND l.node_id = e.node_id AND l.at = e.updated_at JOIN vector_indexes d ON d.name = e.index_name
  WHERE len(e.vector) = d.dim AND len(list_filter(e.vector, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(e.vector, lambda y: y <> 0)) > 0),
s AS (SELECT a.i, a.n AS a, b.n AS b, list_cosine_similarity(a.x, b.x) AS c FROM v a JOIN v b ON a.i = b.i AND a.n <> b.n),
r AS (SELECT *, row_number() OVER (PARTITION BY i, a ORDER BY c DESC, b) AS k FROM s QUALIFY k <= 10)
SELECT DISTINCT i AS index_name, least(a, b) AS node_a, greatest(a, b) AS node_b FROM r WHERE c >= 0.95""",
}
