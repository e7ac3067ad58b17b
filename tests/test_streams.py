"""Running streams against their batch forms, and restarts."""

import datetime
import json
import os
import random

import pytest
from parley.sources import manifest
from parley.streaming import audit, control, windows
from pyspark.sql import functions as F

SCHEMA = "conn_id long, seq long, ts timestamp, kind string, size long"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, control.PROVIDER)
    yield spark
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def messages(n=120, seed=1):
    rng, at, out = random.Random(seed), 0, []
    for seq in range(n):
        at += rng.choice([1, 2, 5, 45])
        out.append((rng.randint(1, 4), seq, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=at), rng.choice(["audio", "audio", "audio", "stop", "ping", "start", "demo", "odd", None]), rng.choice([3, 10, None])))
    return out


def plain(rows, idle):
    state, out, last = {}, [], max(r[2] for r in rows)
    for conn, seq, ts, kind, size in rows:
        seen = state.get(conn)
        if seen and (ts - seen[1]).total_seconds() > idle:
            out.append((conn, seen[0], "closed", len(seen[2]), sum(seen[2])))
            seen = None
        if not seen:
            out.append((conn, seq, "connected", 0, 0))
        held = seen[2] if seen else []
        if kind == "audio":
            held = [*held, size or 0]
        n, total = (len(held), sum(held)) if kind in ("audio", "stop") else (0, 0)
        out.append((conn, seq, {"audio": "recording", "stop": "processing", "demo": "processing", "ping": "pong", "start": "started"}.get(kind, "error"), n, total))
        state[conn] = seq, ts, [] if kind in ("stop", "start") else held
    out += [(conn, seq, "closed", len(h), sum(h)) for conn, (seq, ts, h) in state.items() if (last - ts).total_seconds() >= idle]
    return sorted(out)


def test_control_in_batch_is_the_plain_rule(spark):
    for seed in range(3):
        rows = messages(seed=seed)
        assert sorted(map(tuple, control.in_batch(spark.createDataFrame(rows, SCHEMA), 60_000).collect())) == plain(rows, 60)


@pytest.mark.parametrize("files", [1, 4])
def test_control_as_a_stream_equals_the_batch(rocks, tmp_path, files):
    spark, rows, idle = rocks, messages(seed=5), 60_000
    for k in range(files):
        own = rows[k * len(rows) // files : (k + 1) * len(rows) // files]
        spark.createDataFrame(own, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
        for at in (f"{tmp_path}/in/part{k}",):
            for name in os.listdir(at):
                os.utime(f"{at}/{name}", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    control.live(stream, idle).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("conn_id", "seq", "reply", "frames", "bytes").collect())) == plain(rows, 60)


def calls(first, last):
    return [json.dumps({"ts": 1_700_000_000.1234 + 40_000 * i, "tool": f"t{i % 3}", "actor": "a", "status": "ok", "duration_ms": 1.239, "args": json.dumps({"k": i}), "error": "x" * 900}) for i in range(first, last)]


def run(spark, at):
    for q in audit.start(spark, f"{at}/calls", f"{at}/log", f"{at}/side", f"{at}/check"):
        q.awaitTermination()


def test_audit_survives_restarts_without_lost_or_doubled_lines(spark, tmp_path):
    at = str(tmp_path)
    os.mkdir(f"{at}/calls")
    with open(f"{at}/calls/a.jsonl", "w") as f:
        f.write("\n".join([*calls(0, 5), "{broken", "", '{"ts": 1.0}', '{"tool": "t"}', '{"ts": "soon", "tool": "t"}']))
    run(spark, at)
    with open(f"{at}/calls/b.jsonl", "w") as f:
        f.write("\n".join(calls(5, 9)))
    run(spark, at)
    for name in ("log", "side"):  # as after a stop between the sink and the end of the batch
        commits = sorted(x for x in os.listdir(f"{at}/check/{name}/commits") if x.isdigit())
        os.remove(f"{at}/check/{name}/commits/{commits[-1]}")
        crc = f"{at}/check/{name}/commits/.{commits[-1]}.crc"
        if os.path.exists(crc):
            os.remove(crc)
    run(spark, at)
    log = spark.read.parquet(f"{at}/log")
    assert sorted(r["ts"] for r in log.collect()) == [round(1_700_000_000.1234 + 40_000 * i, 3) for i in range(9)]
    first = log.orderBy("ts").first()
    assert (len(first["error"]), len(first["args_digest"]), first["duration_ms"], str(first["day"])) == (500, 32, 1.24, "2023-11-14")
    assert sorted(r["fault"] for r in spark.read.parquet(f"{at}/side").collect()) == ["empty", "no time", "no tool", "not a record", "not a record"]
    assert len([x for x in os.listdir(f"{at}/log") if x.startswith("day=")]) > 3
    assert [r["ts"] for r in audit.tail(log, 3).collect()] == [round(1_700_000_000.1234 + 40_000 * i, 3) for i in (6, 7, 8)]
    assert audit.tail(log, 50).count() == 9 and audit.tail(log.limit(0), 5).count() == 0


LEDGER = "item_key string, target string, external_id string, meeting_id long, created_at double"


def upsert(spark, at, ledger, check):
    stream = spark.readStream.schema(LEDGER).option("maxFilesPerTrigger", 1).parquet(f"{at}/in/*")
    q = stream.writeStream.foreachBatch(windows.into_ledger(ledger, 8)).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None


def test_the_ledger_outlives_its_checkpoint(spark, tmp_path):
    at, ledger = str(tmp_path), str(tmp_path / "ledger")
    assert windows.read_ledger(spark, ledger).count() == 0
    put = lambda k, rows: spark.createDataFrame(rows, LEDGER).coalesce(1).write.parquet(f"{at}/in/part{k}")
    put(0, [(f"k{i}", "t", "A", 1, 1.0) for i in range(20)])
    put(1, [(f"k{i}", "t", "B", 2, 2.0) for i in range(10, 30)])
    upsert(spark, at, ledger, f"{at}/check1")
    want = {f"k{i}": ("B" if i >= 10 else "A", 1 if i < 20 else 2) for i in range(30)}
    state = lambda: {r["item_key"]: (r["external_id"], r["meeting_id"]) for r in windows.read_ledger(spark, ledger).collect()}
    assert state() == want
    put(2, [("k0", "t", "C", 3, 3.0), ("new", "t", "C", 3, 3.0)])
    upsert(spark, at, ledger, f"{at}/check2")  # a new checkpoint: all batches come again, from epoch 0
    want |= {"k0": ("C", 1), "new": ("C", 3)}
    assert state() == want and windows.read_ledger(spark, ledger).count() == 31
    versions = manifest.versions(spark, f"{ledger}/manifest")
    last = sorted(x for x in os.listdir(f"{at}/check2/commits") if x.isdigit())[-1]
    for name in (last, f".{last}.crc"):
        if os.path.exists(f"{at}/check2/commits/{name}"):
            os.remove(f"{at}/check2/commits/{name}")
    upsert(spark, at, ledger, f"{at}/check2")  # the last batch comes again and is skipped
    assert manifest.versions(spark, f"{ledger}/manifest") == versions and state() == want


def test_old_versions_of_a_ledger_are_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(windows, "CLEARED", 7)
    ledger = str(tmp_path / "ledger")
    write = windows.into_ledger(ledger, 2)
    for k in range(7):
        write(spark.createDataFrame([(f"k{k % 3}", "t", f"X{k}", 1, float(k))], LEDGER), k)
    assert len(os.listdir(f"{ledger}/data")) <= windows.KEPT + 2 and len(manifest.versions(spark, f"{ledger}/manifest")) == windows.KEPT
    assert sorted(r["external_id"] for r in windows.read_ledger(spark, ledger).collect()) == ["X4", "X5", "X6"]
