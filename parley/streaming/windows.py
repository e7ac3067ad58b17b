"""Event streams: windows, sessions, deduplication, frames. Each function takes a batch or a streaming DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from parley.sources import manifest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "item_key string, target string, external_id string, meeting_id long, created_at double"


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """window_start, event_type, n, total per window; late events within the watermark still count."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "1 hour", slide: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, session_start, n per stretch of events with gaps below `gap`."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


def distinct_calls(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def frames(stream: DataFrame) -> DataFrame:
    """conn_id, frames, bytes at each stop message of a stream (conn_id, kind, size): sizes add up until 'stop', then begin anew."""

    def step(key: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        count, size = state.get if state.exists else (0, 0)
        out = []
        for frame in rows:
            stop = (frame["kind"] == "stop").to_numpy(bool)
            counts = count + np.cumsum(~stop)
            sizes = size + np.cumsum(np.where(stop, 0, frame["size"].fillna(0)).astype(np.int64))
            ends = np.flatnonzero(stop)
            each = pd.DataFrame({"frames": np.diff(counts[ends], prepend=0), "bytes": np.diff(sizes[ends], prepend=0)})
            out.append(each.assign(conn_id=key[0]))
            count, size = (int(x[-1] - (x[ends[-1]] if len(ends) else 0)) for x in (counts, sizes))
        state.update((count, size))
        yield pd.concat(out)[["conn_id", "frames", "bytes"]]

    return stream.groupBy("conn_id").applyInPandasWithState(step, "conn_id long, frames long, bytes long", "frames long, bytes long", "append", "NoTimeout")


#: Versions of a ledger that stay readable, and commits between two clearances of older ones.
KEPT, CLEARED = 5, 20


def read_ledger(spark: SparkSession, path: str, schema: str = LEDGER) -> DataFrame:
    """The ledger that into_ledger() keeps, its newest state; empty where there is none."""
    content = manifest.read(spark, f"{path}/manifest")
    folders = sorted((content or {}).get("buckets", {}).values())
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _clear(spark: SparkSession, path: str) -> None:
    """Delete versions older than the newest KEPT, and what only they name."""
    folder = f"{path}/manifest"
    known = manifest.versions(spark, folder)
    held = {f.rsplit("/", 2)[-2] for v in known[-KEPT:] for f in manifest.read(spark, folder, v)["buckets"].values()}
    for v in known[:-KEPT]:
        manifest.delete(spark, f"{folder}/{v}.json")
    for name in manifest.names(spark, f"{path}/data"):
        if name not in held:
            manifest.delete(spark, f"{path}/data/{name}")


def into_ledger(path: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that upserts each micro-batch. Keys are dealt into buckets by hash; a batch reads and writes only those
    that it touches, and a manifest names the newest folder of every bucket and swaps at once. A batch that its stream has
    applied is skipped; another stream, or the same one with a new checkpoint, counts its batches anew and meets the whole
    ledger all the same. Of two writers at once one fails with manifest.Conflict, and its stream tries again. Folders of
    versions that nobody can read any more are deleted now and then."""
    from parley.operators.ledger import upserted

    def write(batch: DataFrame, epoch: int) -> None:
        spark, bucket = batch.sparkSession, F.pmod(F.xxhash64("item_key", "target"), F.lit(buckets)).cast("int")
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or ""
        before = manifest.read(spark, f"{path}/manifest") or {"version": 0, "buckets": {}, "applied": {}}
        if stream and before["applied"].get(stream, -1) >= epoch:
            return
        touched = [str(r["bucket"]) for r in batch.select(bucket.alias("bucket")).distinct().collect()]  # no more than there are buckets
        old = [before["buckets"][k] for k in touched if k in before["buckets"]]
        merged = upserted(spark.read.schema(batch.schema).parquet(*old) if old else batch.limit(0), batch)
        at = f"{path}/data/{uuid.uuid4().hex}"
        merged.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(at)
        version = before["version"] + 1
        manifest.commit(spark, f"{path}/manifest", version, {"version": version, "buckets": before["buckets"] | {k: f"{at}/bucket={k}" for k in touched}, "applied": before["applied"] | ({stream: epoch} if stream else {})})
        if version % CLEARED == 0:
            _clear(spark, path)

    return write
