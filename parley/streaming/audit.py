"""A running audit log: call records from files go to a log by day, records that can't be read to a side channel.

Both sinks write each file of records once, however often the stream is stopped and started: the file sinks' own logs name
the files of finished batches, and the checkpoint names the records of a batch. Readers of the log see whole batches only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: A call as it is recorded; args is JSON text.
CALL = "ts double, tool string, actor string, status string, duration_ms double, args string, error string"
#: Characters of an error that are kept, and digits of the digest of arguments.
ERROR, DIGEST = 500, 32


def parsed(lines: DataFrame) -> DataFrame:
    """value, call (null fields where they are missing) and fault ('' if there is none) for lines of text."""
    call = F.from_json("value", f"{CALL}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    own = lines.select("value", call.alias("call"))
    fault = F.when(F.trim("value") == "", "empty").when(F.col("call").isNull() | F.col("call._broken").isNotNull(), "not a record").when(F.col("call.tool").isNull() | (F.col("call.tool") == ""), "no tool").when(F.col("call.ts").isNull(), "no time")
    return own.withColumn("fault", F.coalesce(fault, F.lit("")))


def records(lines: DataFrame) -> DataFrame:
    """Readable calls as records of the log: arguments become a digest, and the day of the call is a column."""
    c = parsed(lines).filter("fault = ''").select("call.*")
    digest = F.substring(F.sha2(F.coalesce("args", F.lit("")), 256), 1, DIGEST)
    return c.select(
        F.round("ts", 3).alias("ts"), "tool", F.coalesce("actor", F.lit("mcp")).alias("actor"), F.coalesce("status", F.lit("ok")).alias("status"), F.round(F.coalesce("duration_ms", F.lit(0.0)), 2).alias("duration_ms"),
        digest.alias("args_digest"), F.substring(F.coalesce("error", F.lit("")), 1, ERROR).alias("error"), F.to_date(F.timestamp_seconds(F.floor("ts"))).alias("day"),
    )


def rejected(lines: DataFrame) -> DataFrame:
    return parsed(lines).filter("fault <> ''").select("value", "fault")


def start(spark: SparkSession, source: str, log: str, side: str, checkpoint: str, once: bool = True) -> tuple[StreamingQuery, StreamingQuery]:
    """Follow the text files of a folder: records to `log` by day, what can't be read to `side`. With once, both streams end when
    they have read what is there."""
    out = []
    for name, path, make, days in (("log", log, records, ["day"]), ("side", side, rejected, [])):
        lines = spark.readStream.text(source)
        writer = make(lines).writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{checkpoint}/{name}").outputMode("append")
        writer = writer.partitionBy(*days) if days else writer
        out.append((writer.trigger(availableNow=True) if once else writer).start())
    return out[0], out[1]


def tail(log: DataFrame, n: int = 20) -> DataFrame:
    """The last n records, oldest first; only the newest days that hold n are read."""
    per_day = log.groupBy("day").count().orderBy(F.desc("day")).limit(n).collect()  # each day has a record, so n days suffice
    first, left = None, n
    for day, count in per_day:
        first, left = day, left - count
        if left <= 0:
            break
    own = log if first is None else log.filter(F.col("day") >= F.lit(first))
    return own.orderBy(F.desc("ts"), F.desc("args_digest"), F.desc("tool")).limit(n).orderBy("ts", "args_digest", "tool")
