"""Replay of tool-calling runs: where and why each stops.

A run decides step after step: a final answer ends it, as does a failure of the model; a call with the name and arguments of an
earlier call is a repeat and ends it unexecuted; unknown tools and failed calls are errors, `errors` of them in a row end it,
a call that works starts their count anew; after `steps` steps it ends in any case. Each rule's first place follows from
sums that can be merged in parts (the least step, the second step of a signature, the starts that all of some errors in a row
share), so a long run is never one row or one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Reasons in the order in which they are looked for at one step.
REASONS = ("llm_error", "final_answer", "repeat_detected", "tool_errors", "max_steps", "open")


def stops(trace: DataFrame, steps: int = 5, errors: int = 3) -> DataFrame:
    """run_id, reason, step (the last one looked at), executed (calls that were made) for traces (run_id, step, kind, signature,
    ok). step counts from 1 without gaps; kind is llm_error, final, unknown or call; signature is null where there is no
    call. A run that says no more before any rule applies is open."""
    own = trace.filter(F.col("step") <= steps)
    call, bad = F.col("kind") == "call", F.coalesce((F.col("kind") == "unknown") | ((F.col("kind") == "call") & ~F.col("ok")), F.lit(False))
    at = lambda k: F.lit(REASONS.index(k)).alias("why")
    direct = own.filter("kind in ('llm_error', 'final')").select("run_id", "step", F.when(F.col("kind") == "final", REASONS.index("final_answer")).otherwise(REASONS.index("llm_error")).alias("why"))
    first = own.filter(call).groupBy("run_id", "signature").agg(F.min("step").alias("first"))
    again = own.filter(call).join(first.withColumnRenamed("run_id", "r").withColumnRenamed("signature", "s"), F.col("run_id").eqNullSafe(F.col("r")) & F.col("signature").eqNullSafe(F.col("s"))).filter("step > first").select("run_id", "step", at("repeat_detected"))
    starts = own.filter(bad).select("run_id", F.explode(F.sequence(F.col("step") - (errors - 1), F.col("step"))).alias("start"))
    row = starts.groupBy("run_id", "start").count().filter(F.col("count") == errors).select("run_id", (F.col("start") + errors - 1).alias("step"), at("tool_errors"))
    last = own.groupBy("run_id").agg(F.max("step").alias("step")).select("run_id", "step", F.when(F.col("step") >= steps, REASONS.index("max_steps")).otherwise(REASONS.index("open")).alias("why"))
    found = direct.unionByName(again).unionByName(row).unionByName(last).groupBy("run_id").agg(F.min(F.struct("step", "why")).alias("stop"))
    made = own.filter(call).join(found.withColumnRenamed("run_id", "r"), F.col("run_id").eqNullSafe(F.col("r"))).filter((F.col("step") < F.col("stop.step")) | ((F.col("step") == F.col("stop.step")) & (F.col("stop.why") > REASONS.index("repeat_detected"))))
    calls = made.groupBy("run_id").agg(F.count("*").alias("executed")).withColumnRenamed("run_id", "r")
    named = F.element_at(F.array(*[F.lit(r) for r in REASONS]), F.col("stop.why") + 1)
    return found.join(calls, F.col("run_id").eqNullSafe(F.col("r")), "left").select("run_id", named.alias("reason"), F.col("stop.step").alias("step"), F.coalesce("executed", F.lit(0)).alias("executed"))
