"""Control of recording connections: replies to start, audio, stop, demo and ping, and the end of silent connections.

Messages are (conn_id, seq, ts, kind, size); replies (conn_id, seq, reply, frames, bytes) carry the seq of the message that caused
them. A connection opens with its first message. audio adds a frame; stop hands the recording over and empties it; demo
hands over nothing; ping asks for a pong; start empties the recording; other kinds are errors. A connection that says
nothing for longer than `idle` is closed, its recording lost; a later message opens it anew.

live() keeps this as state of a stream, with a timer a connection; in_batch() computes the same from a table of messages.
Messages of a connection that arrive in order give the same replies however they are cut into batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

REPLIES = "conn_id long, seq long, reply string, frames long, bytes long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Control(StatefulProcessor):
    def __init__(self, idle_ms: int):
        self.idle = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seq long, ms long")
        self.recording = handle.getListState("recording", "seq long, size long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(["ts", "seq"])
        seen = self.last.get() if self.last.exists() else None
        held = [int(size) for _, size in self.recording.get()] if self.recording.exists() else []
        stored, out = len(held), []
        for seq, ts, kind, size in zip(batch["seq"].tolist(), batch["ts"], batch["kind"], batch["size"].fillna(0).astype(int).tolist(), strict=True):
            ms = ts.value // 1_000_000
            if seen and ms - seen[1] > self.idle:
                out.append((seen[0], "closed", len(held), sum(held)))
                seen, held, stored = None, [], -1
            if not seen:
                out.append((seq, "connected", 0, 0))
            seen = seq, ms
            if kind == "audio":
                held.append(size)
                out.append((seq, "recording", len(held), sum(held)))
            elif kind == "stop":
                out.append((seq, "processing", len(held), sum(held)))
            elif kind in ("demo", "ping", "start"):
                out.append((seq, {"demo": "processing", "ping": "pong", "start": "started"}[kind], 0, 0))
            else:
                out.append((seq, "error", 0, 0))
            if kind in ("stop", "start"):
                held, stored = [], -1
        self._keep(seen, held, stored)
        yield pd.DataFrame(out, columns=["seq", "reply", "frames", "bytes"]).assign(conn_id=key[0])[["conn_id", "seq", "reply", "frames", "bytes"]]

    def _keep(self, seen: tuple[int, int], held: list[int], stored: int) -> None:
        """Frames behind the first `stored` are added; -1: the recording began anew."""
        if stored < 0:
            self.recording.clear()
        new = [(k, size) for k, size in enumerate(held) if k >= stored]
        if new:
            self.recording.appendList(new)
        self.last.update(seen)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(seen[1] + self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [int(size) for _, size in self.recording.get()] if self.recording.exists() else []
        seq = self.last.get()[0]
        self.last.clear()
        self.recording.clear()
        yield pd.DataFrame({"conn_id": [key[0]], "seq": [seq], "reply": ["closed"], "frames": [len(held)], "bytes": [sum(held)]})


def live(messages: DataFrame, idle_ms: int, late: str = "0 seconds") -> DataFrame:
    """The replies of a stream of messages; ts is a timestamp. Needs the state store of PROVIDER."""
    timed = messages.withWatermark("ts", late)
    return timed.groupBy("conn_id").transformWithStateInPandas(_Control(idle_ms), REPLIES, "append", "EventTime")


def in_batch(messages: DataFrame, idle_ms: int, now_ms: int | None = None) -> DataFrame:
    """The replies to a table of messages; connections silent for idle_ms before now_ms (the last message) are closed."""
    by_conn = Window.partitionBy("conn_id").orderBy("ms", "seq")
    own = messages.withColumn("ms", F.unix_millis("ts"))
    before = F.lag("ms").over(by_conn)
    own = own.withColumn("opens", before.isNull() | (F.col("ms") - before > idle_ms)).withColumn("later", F.lead("ms").over(by_conn))
    ends = F.coalesce(F.col("kind").isin("stop", "start"), F.lit(False))
    cut = F.sum((F.col("opens")).cast("long")).over(by_conn) + F.coalesce(F.sum(ends.cast("long")).over(by_conn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = own.withColumn("part", cut)
    in_part, audio = Window.partitionBy("conn_id", "part").orderBy("ms", "seq"), F.col("kind") == "audio"
    frames, size = F.coalesce(F.sum(audio.cast("long")).over(in_part), F.lit(0)), F.coalesce(F.sum(F.when(audio, F.coalesce("size", F.lit(0)).cast("long"))).over(in_part), F.lit(0))
    own = own.withColumn("frames", frames).withColumn("bytes", size)
    now = F.lit(messages.agg(F.unix_millis(F.max("ts"))).first()[0] if now_ms is None else now_ms).cast("long")
    silent = F.when(F.col("later").isNotNull(), F.col("later") - F.col("ms") > idle_ms).otherwise(F.col("ms") + idle_ms <= now)
    zero = F.lit(0).cast("long")
    kept, of_kind = F.col("kind").isin("audio", "stop"), {"audio": "recording", "stop": "processing", "demo": "processing", "ping": "pong", "start": "started"}
    reply = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in of_kind.items() for x in pair]), F.col("kind")), F.lit("error"))
    row = lambda when, name, f, b: F.when(when, F.struct(name.alias("reply"), f.alias("frames"), b.alias("bytes")))
    lost = F.col("kind").isin("stop", "start")  # what they leave behind is empty
    each = F.array_compact(F.array(
        row(F.col("opens"), F.lit("connected"), zero, zero),
        row(F.lit(True), reply, F.when(kept, F.col("frames")).otherwise(zero), F.when(kept, F.col("bytes")).otherwise(zero)),
        row(silent, F.lit("closed"), F.when(lost, zero).otherwise(F.col("frames")), F.when(lost, zero).otherwise(F.col("bytes"))),
    ))
    return own.select("conn_id", "seq", F.explode(each).alias("r")).select("conn_id", "seq", "r.reply", "r.frames", "r.bytes")
