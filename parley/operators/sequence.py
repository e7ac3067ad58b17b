"""Places of rows within their group, without gathering a group in one task."""

from __future__ import annotations

from parley.sources import shared
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, group: list[str], order: list, name: str = "place") -> DataFrame:
    """rows with their place (from 1) in their group by order. Rows are dealt by ranges of group and order, so a large group is
    many tasks; each task numbers its own rows, and a group's rows in the ranges before are added from a table of one row
    for each range and group. The result is written."""
    at = [*group, *order]
    placed = shared.written(rows.repartitionByRange(*at).sortWithinPartitions(*at).withColumn("_row", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_row", 33)
    counts = placed.groupBy(*group, part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)], "_part", "_first", before.alias("_before"))
    same = [F.col(g).eqNullSafe(F.col(f"_g{k}")) for k, g in enumerate(group)]
    joined = placed.withColumn("_at", part).join(counts, [*same, F.col("_at") == F.col("_part")])
    return shared.written(joined.select(*rows.columns, (F.col("_before") + F.col("_row") - F.col("_first") + 1).alias(name)), "numbered")
