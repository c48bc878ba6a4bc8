"""Event streams: windows with watermarks, sessions and de-duplication. The same functions take batch frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _late(df: DataFrame, at: str, lateness: str) -> DataFrame:
    """With a zone-aware time and, on a stream, the bound beyond which late rows are dropped."""
    df = df.withColumn(at, F.col(at).cast("timestamp"))
    return df.withWatermark(at, lateness) if df.isStreaming else df


def tumbling(df: DataFrame, at: str, size: str, keys: list[str], value: str, slide: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """Per window (sliding where slide is given) and key: rows and sum."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    out = _late(df, at, lateness).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def sessions(df: DataFrame, at: str, gap: str, keys: list[str], lateness: str = "1 hour") -> DataFrame:
    """Per key: runs of rows less than a gap apart."""
    out = _late(df, at, lateness).groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def first_of(df: DataFrame, at: str, keys: list[str], lateness: str = "1 hour") -> DataFrame:
    """Each key once; on a stream, within the watermark."""
    df = _late(df, at, lateness)
    return df.dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)
