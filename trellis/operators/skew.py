"""Per-key results and joins where a few keys hold most rows.

Heavy keys are found by a frequent-items sketch of at most 1/support keys that misses no key above that
share. The sketch depends on the order in which its parts are merged, so it is collected once and all branches
use the same fixed rows. Rows of heavy keys are spread by the hash of the counted value (so distinct counts
add up) or joined by a broadcast of the other side's few rows; all other rows take the ordinary shuffle; the
two results are disjoint by key and are put together by union.

Defined results: a null key is a key of its own in skew_aggregate and matches nothing in skew_join; an empty
table gives an empty result; ties and repeated rows count as they stand.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUPPORT = 0.002


def heavy_keys(df: DataFrame, keys: list[str], support: float = SUPPORT) -> DataFrame:
    """At most 1/support key rows, among them every key that holds more than that share of the rows."""
    sketch = df.select(F.struct(*keys).alias("k")).stat.freqItems(["k"], support)
    found = sketch.select(F.explode("k_freqItems").alias("k")).select("k.*")
    return df.sparkSession.createDataFrame(found.collect(), found.schema)  # bound: 1/support rows


def _same(left: DataFrame, right: DataFrame, keys: list[str], suffix: str) -> Column:
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k + suffix]) for k in keys))


def split(df: DataFrame, keys: list[str], support: float = SUPPORT) -> DataFrame:
    """Adds _heavy: whether the row's key is in the sketch. The sketch's few rows are broadcast."""
    heavy = heavy_keys(df, keys, support).select(*(F.col(k).alias(k + "__h") for k in keys), F.lit(True).alias("_heavy"))
    tagged = df.join(F.broadcast(heavy), _same(df, heavy, keys, "__h"), "left")  # bound: 1/support rows
    return tagged.drop(*(k + "__h" for k in keys)).withColumn("_heavy", F.coalesce("_heavy", F.lit(False)))


def skew_aggregate(df: DataFrame, keys: list[str], distinct: dict[str, str], low: dict[str, str] | None = None, high: dict[str, str] | None = None, rows: str | None = None, support: float = SUPPORT) -> DataFrame:
    """Per key: exact distinct counts ({result: column}), least and greatest values, and optionally the number of rows.

    Heavy keys are aggregated per key and value first, so a key's rows spread over all tasks by the hash of the value, then per key.
    The other keys take one ordinary shuffle by key, within which everything is counted.
    """
    low, high = low or {}, high or {}
    columns = list(dict.fromkeys([*keys, *distinct.values(), *low.values(), *high.values()]))
    tagged = split(df.select(*columns), keys, support)
    figures = [F.countDistinct(c).alias(n) for n, c in distinct.items()] + [F.min(c).alias(n) for n, c in low.items()] + [F.max(c).alias(n) for n, c in high.items()]
    figures += [F.count("*").alias(rows)] if rows else []
    heavy, others = tagged.where("_heavy").drop("_heavy"), tagged.where(~F.col("_heavy")).drop("_heavy")
    return heavy.groupBy(*keys).agg(*figures).unionByName(others.repartition(*keys).groupBy(*keys).agg(*figures))


def skew_counts(df: DataFrame, keys: list[str], unit: str, count: str = "n", support: float = SUPPORT) -> DataFrame:
    """Exact number of distinct units per key, heavy keys over salts, the others by the ordinary shuffle."""
    return skew_aggregate(df.select(*keys, unit), keys, {count: unit}, support=support)


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", support: float = SUPPORT) -> DataFrame:
    """Joins left (many rows a key, skewed) with right (at most one row a key): heavy keys by broadcast, the others by shuffle.

    The broadcast side holds at most 1/support rows, as right has one row a key. Columns must not clash but for the key.
    """
    heavy = heavy_keys(left.where(F.col(key).isNotNull()), [key], support)
    few = right.join(F.broadcast(heavy), key, "left_semi")
    many = left.join(F.broadcast(heavy.withColumn("_heavy", F.lit(True))), key, "left")
    on_heavy = many.where("_heavy").drop("_heavy").join(F.broadcast(few), key, how)
    rest = many.where(F.col("_heavy").isNull()).drop("_heavy").join(right, key, how)
    return on_heavy.unionByName(rest)
