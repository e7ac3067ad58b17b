"""An idempotent ledger: item_key, target, external_id, meeting_id, created_at, keyed by (item_key, target)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upserted(ledger: DataFrame, batch: DataFrame) -> DataFrame:
    """One row a key: the latest external_id and created_at, the earliest meeting_id (ties: smaller external_id)."""
    both = ledger.unionByName(batch)
    key = ["item_key", "target"]
    newest = F.max(F.struct("created_at", "external_id"))
    oldest = F.min(F.struct("created_at", "meeting_id"))
    return both.groupBy(*key).agg(newest.alias("new"), oldest.alias("old")).select(*key, F.col("new.external_id").alias("external_id"), F.col("old.meeting_id").alias("meeting_id"), F.col("new.created_at").alias("created_at"))


def to_create(items: DataFrame, ledger: DataFrame) -> DataFrame:
    """Items (item_key, target, ...) that the ledger does not hold."""
    return items.join(ledger.select("item_key", "target"), ["item_key", "target"], "left_anti")


def reused(items: DataFrame, ledger: DataFrame) -> DataFrame:
    """Items with the ledger's external_id, null where there is none."""
    return items.join(ledger.select("item_key", "target", "external_id"), ["item_key", "target"], "left")


def stats(ledger: DataFrame) -> DataFrame:
    """target, n; the row of all targets has a null target."""
    return ledger.rollup("target").agg(F.count("*").alias("n"))


def latest(ledger: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item_key", "target").orderBy(F.desc("created_at"), "external_id"))
    return ledger.withColumn("k", rank).filter("k = 1").drop("k")
