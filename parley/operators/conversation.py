"""Conversation analytics per meeting: speakers, balance, efficiency. segments: meeting_id, speaker, seq, seconds, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def speaker_stats(segments: DataFrame) -> DataFrame:
    """meeting_id, speaker, duration, ratio, n_chars, turns, place (longest first, then first to speak). Seconds are added up in
    the order of seq and speakers in that of their first turn: a share halfway between two digits depends on the order."""
    turns = Window.partitionBy("meeting_id", "speaker").orderBy("seq", "seconds").rowsBetween(Window.unboundedPreceding, 0)
    own = segments.select("meeting_id", "speaker", "seq", F.length("text").alias("chars"), F.sum("seconds").over(turns).alias("so_far"), F.row_number().over(turns).alias("nth"))
    own = own.groupBy("meeting_id", "speaker").agg(F.max_by("so_far", "nth").alias("total"), F.sum("chars").alias("n_chars"), F.count("*").alias("turns"), F.min("seq").alias("first_seq"))
    meeting = Window.partitionBy("meeting_id")
    heard = meeting.orderBy("first_seq", "speaker").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = own.withColumn("whole", F.sum("total").over(heard)).withColumn("duration", F.round("total", 1))
    ratio = F.when(F.col("whole") > 0, F.round(F.col("total") / F.col("whole"), 3)).otherwise(0.0)
    place = F.row_number().over(meeting.orderBy(F.desc("duration"), "first_seq", "speaker"))
    return own.select("meeting_id", "speaker", "duration", ratio.alias("ratio"), "n_chars", "turns", place.alias("place"))


def balance(stats: DataFrame) -> DataFrame:
    """meeting_id, gini, balance: 10 for equal shares; one speaker gives 5. Sorted ranks give the sum of all differences without pairs."""
    rank = F.row_number().over(Window.partitionBy("meeting_id").orderBy("ratio", "speaker"))
    sums = stats.withColumn("i", rank).groupBy("meeting_id").agg(F.count("*").alias("n"), F.sum("ratio").alias("s"), F.sum(F.col("i") * F.col("ratio")).alias("ix"))
    gini = F.when(F.col("s") > 0, (2 * F.col("ix") / F.col("s") - F.col("n") - 1) / F.col("n")).otherwise(0.0)
    return sums.select("meeting_id", "n", F.round(gini, 6).alias("gini"), F.when(F.col("n") == 1, 5.0).otherwise(F.round((1 - gini) * 10, 6)).alias("balance"))


def efficiency(stats: DataFrame, durations: DataFrame, judged: float = 5.0) -> DataFrame:
    """meeting_id, utilization, efficiency: 0.4 judged + 0.3 balance + 0.3 utilization, within 0 and 10. durations: meeting_id, seconds."""
    used = stats.groupBy("meeting_id").agg(F.sum("duration").alias("used"))
    both = durations.join(used, "meeting_id", "left").join(balance(stats), "meeting_id", "left")
    utilization = F.when(F.col("seconds") > 0, F.least(F.coalesce("used", F.lit(0.0)) / F.col("seconds"), F.lit(1.0)) * 10).otherwise(5.0)
    score = F.when(F.col("n").isNull(), F.lit(judged)).otherwise(F.round(F.least(F.greatest(0.4 * F.lit(judged) + 0.3 * F.col("balance") + 0.3 * F.col("utilization"), F.lit(0.0)), F.lit(10.0)), 1))
    return both.withColumn("utilization", F.round(utilization, 6)).select("meeting_id", "utilization", score.alias("efficiency"))
