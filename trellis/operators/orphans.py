"""References to records that do not exist, missing, deleted or arriving later.

The ledger keeps signed counts per key, built from change deltas: +1 / -1 for a reference that appears or
goes, +1 / -1 for a record that appears or is deleted. Deltas combine before the shuffle, so a key's state is
a bounded row however many references it has, and a later batch is added by summing. Keys with a positive count of references
and no existence are the current orphans; the existence deltas keep their times, so that the count can be taken up to
each reference's own time.

Defined results: null references are none; repeated deliveries of an existence delta count once (first time);
a reference with a null time is compared with no existence and has a null period, so it is an orphan; empty
tables give an empty report, or all references as orphans where only the referred table is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.operators.skew import skew_join


def existence_deltas(records: DataFrame, key: str, at: str, deletions: DataFrame | None = None, deleted_key: str = "", deleted_at: str = "") -> DataFrame:
    """key, delta, at: +1 for each record, -1 for each deletion."""
    born = records.select(F.col(key).alias("key"), F.lit(1).alias("delta"), F.col(at).alias("at"))
    if deletions is None:
        return born
    return born.unionByName(deletions.select(F.col(deleted_key).alias("key"), F.lit(-1).alias("delta"), F.col(deleted_at).alias("at")))


def changes(deltas: DataFrame) -> DataFrame:
    """The existence side of the ledger: each key's signed deltas, of which repeated ones of a sign count once, at their first time.

    A key exists as long as their sum up to a time is positive; a deletion before the record arrives makes it -1, so that it stays an orphan.
    """
    return deltas.where(F.col("key").isNotNull() & F.col("at").isNotNull()).groupBy("key", "delta").agg(F.min("at").alias("at"))


def histories(deltas: DataFrame) -> DataFrame:
    """One row a key: its signed deltas, of which those of a sign count once, at their first time. Takes a ledger or the deltas as they are."""
    signs = [F.struct(F.min(F.when(test, F.col("at"))).alias("at"), F.lit(sign).alias("delta")) for test, sign in ((F.col("delta") > 0, 1), (F.col("delta") < 0, -1))]
    rows = deltas.where(F.col("key").isNotNull()).groupBy("key").agg(F.array(*signs).alias("history"))
    return rows.select("key", F.filter("history", lambda d: d["at"].isNotNull()).alias("history"))


def existence(history: str = "history", until: str | None = None) -> Column:
    """Signed count of a key's existence, up to the time in the column `until`."""
    held = F.col(history) if until is None else F.filter(history, lambda d: d["at"] <= F.col(until))
    return F.coalesce(F.aggregate(held, F.lit(0), lambda n, d: n + d["delta"]), F.lit(0))


def reference_deltas(table: DataFrame, ref_table: str, ref_key: dict[str, str], field: str, at: str, sign: int = 1) -> DataFrame:
    """Deltas of one referring column; ref_key gives the columns that name the referring record (number and, if any, text)."""
    text = F.col(ref_key["text"]).cast("string") if "text" in ref_key else F.lit(None).cast("string")
    return table.select(
        F.lit(ref_table).alias("ref_table"),
        text.alias("ref_text"),
        F.col(ref_key["number"]).alias("ref_number"),
        F.lit(field).alias("ref_field"),
        F.col(field).alias("key"),
        F.col(at).alias("at"),
        F.lit(sign).alias("delta"),
    ).where(F.col("key").isNotNull())


def counted(references: DataFrame, ledger: DataFrame) -> DataFrame:
    """References with the signed existence count of their key at their own time; skewed keys are joined by broadcast."""
    joined = skew_join(references, histories(ledger), "key")
    return joined.withColumn("existence", existence(until="at")).drop("history")


def orphan_references(references: DataFrame, ledger: DataFrame) -> DataFrame:
    """Records with a positive count of references to a key of no existence at the record's time: ref_table, ref_key, ref_field, period, refs."""
    lost = counted(references, ledger).where(F.col("existence") <= 0)
    key = F.when(F.col("ref_text").isNotNull(), F.concat_ws(":", "ref_text", F.col("ref_number").cast("string"))).otherwise(F.col("ref_number").cast("string"))
    rows = lost.select("ref_table", key.alias("ref_key"), "ref_field", F.date_format("at", "yyyy-MM").alias("period"), "delta")
    return rows.groupBy("ref_table", "ref_key", "ref_field", "period").agg(F.sum("delta").alias("refs")).where(F.col("refs") > 0)


def reference_counts(references: DataFrame) -> DataFrame:
    """The reference side of the ledger: signed counts per (ref_table, ref_field, key)."""
    return references.groupBy("ref_table", "ref_field", "key").agg(F.sum("delta").alias("refs"))


def advance(refs: DataFrame, ledger: DataFrame, references: DataFrame, deltas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the ledger after a further batch of reference and existence deltas, in whatever order batches come."""
    summed = refs.unionByName(reference_counts(references)).groupBy("ref_table", "ref_field", "key").agg(F.sum("refs").alias("refs"))
    return summed, changes(ledger.unionByName(deltas.select("key", "delta", "at")))


def current_orphans(refs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Keys of positive reference count and no existence now. One row a field and key, so nothing is skewed any more."""
    now = histories(ledger).select("key", existence().alias("existence"))
    joined = refs.where(F.col("refs") > 0).join(now, "key", "left")
    return joined.where(F.coalesce("existence", F.lit(0)) <= 0).select("ref_table", "ref_field", "key", "refs")
