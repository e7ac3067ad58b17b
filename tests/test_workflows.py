"""Outbox, replay of agents, validation, places in groups."""

import random
import re

import pytest
from parley.operators import agents, outbox, schemas, sequence
from pyspark.sql import functions as F

ITEMS = "meeting_id string, ord int, assignee string, task string, deadline string, priority string, context string"


@pytest.fixture
def asked(spark):
    rows = [("m1", 1, "Ann", "write it", "2024-5-3", "HIGH", "c"), ("m1", 2, None, "read it", "soon", None, None), ("m2", 1, " ann ", "write  it", "", "low", ""), ("m1", 3, "ANN", "Write it", None, "high", "")]
    people = spark.createDataFrame([("ann", "acc-1"), ("bob", "acc-2")], "name string, account string")
    return outbox.requests(spark.createDataFrame(rows, ITEMS), people)


class Target:
    """An outside system that keeps what it is given by id, as files."""

    def __init__(self, path, broken=(), dies=False):
        self.path, self.broken, self.dies = path, broken, dies

    def __call__(self, rows):
        own = rows.select("external_id", "target", "summary", F.when(F.col("target").isin(*self.broken), "is down").alias("error"))
        own.filter("error is null").write.mode("append").parquet(self.path)
        if self.dies:
            raise RuntimeError("died after the effect")
        return rows.select("external_id", F.when(F.col("target").isin(*self.broken), "is down").alias("error"))


def test_requests(asked):
    own = {(r["meeting_id"], r["ord"], r["target"]): r for r in asked.collect()}
    r = own["m1", 1, "tickets"]
    assert (r["summary"], r["account"], r["due"], r["priority"], r["labels"]) == ("[会议待办] write it", "acc-1", "2024-05-03", "High", ["meeting-auto", "meeting-m1"])
    assert r["description"] == "来源：会议 m1\n负责人：Ann\n上下文：c" and own["m1", 1, "tasks"]["description"] == "负责人：Ann\n来源会议：m1\n上下文：c"
    assert own["m1", 2, "tickets"]["description"].split("\n")[1] == "负责人：未指定" and own["m1", 2, "tickets"]["due"] is None and own["m1", 2, "tickets"]["account"] is None
    assert own["m1", 1, "tickets"]["external_id"] == own["m1", 3, "tickets"]["external_id"] != own["m2", 1, "tickets"]["external_id"]


def test_a_run_that_dies_after_the_effect_doubles_nothing(spark, asked, tmp_path):
    box, world = outbox.Outbox(spark, str(tmp_path / "box")), str(tmp_path / "world")
    with pytest.raises(RuntimeError, match="died"):
        box.run(asked, Target(world, dies=True))
    assert box.ledger().count() == 0 and box.open().count() == 6
    out = outbox.Outbox(spark, str(tmp_path / "box")).run(asked, Target(world, broken=("tasks",)), 1.0)
    by = {r["target"]: r["status"] for r in outbox.counters(out).collect()}
    assert by == {"tickets": "enabled,created=3,skipped=1,failed=0", "tasks": "enabled,created=0,skipped=0,failed=4"}
    assert box.open().count() == 3
    out = box.run(asked, Target(world), 2.0)
    assert {r["target"]: r["status"] for r in outbox.counters(out).collect()} == {"tickets": "enabled,created=0,skipped=4,failed=0", "tasks": "enabled,created=3,skipped=1,failed=0"}
    assert box.ledger().count() == spark.read.parquet(world).select("external_id").distinct().count() == 6
    assert {r["created_at"] for r in box.ledger().filter("target = 'tickets'").collect()} == {1.0}
    assert {r["target"]: r["status"] for r in outbox.counters(box.run(asked.limit(0), Target(world)), enabled=("tasks",)).collect()} == {"tickets": "disabled,created=0,skipped=0,failed=0", "tasks": "enabled,created=0,skipped=0,failed=0"}
    assert {r["meeting_id"]: (r["created"], r["skipped"]) for r in outbox.meetings(out).collect()} == {"m1": (2, 4), "m2": (1, 1)}


def test_texts_of_a_run_are_written_once(spark, asked, tmp_path, monkeypatch):
    full, written = [], outbox.shared.written
    monkeypatch.setattr(outbox.shared, "written", lambda df, name, *a: ("description" in df.columns and full.append(name), written(df, name, *a))[1])
    out = outbox.Outbox(spark, str(tmp_path / "box")).run(asked, lambda rows: rows.select("external_id", F.when(F.col("target") == "tasks", "down").alias("error")))
    assert full == ["asked"] and {(r["target"], r["status"], r["error"]) for r in out.collect()} >= {("tickets", "created", None), ("tasks", "failed", "down")}


def test_open_intents_are_sent_though_nobody_asks_again(spark, asked, tmp_path):
    box, world = outbox.Outbox(spark, str(tmp_path / "box")), str(tmp_path / "world")
    with pytest.raises(RuntimeError):
        box.run(asked, Target(world, dies=True))
    box.run(asked.limit(0), Target(world))
    assert box.open().count() == 0 and box.ledger().count() == 6


def plain(rows, steps, errors):
    seen, bad, made, last = set(), 0, 0, 0
    for step, kind, signature, ok in rows:
        if step > steps:
            return "max_steps", steps, made
        last = step
        if kind in ("llm_error", "final"):
            return {"final": "final_answer"}.get(kind, kind), step, made
        if kind == "unknown":
            bad += 1
        elif signature in seen:
            return "repeat_detected", step, made
        else:
            seen.add(signature)
            made += 1
            bad = 0 if ok else bad + 1
        if bad >= errors:
            return "tool_errors", step, made
    return ("max_steps" if last >= steps else "open"), last, made


@pytest.mark.parametrize(("steps", "errors"), [(5, 3), (40, 3), (12, 2), (3, 1)])
def test_replay_is_the_loop(spark, steps, errors):
    rng = random.Random(steps)
    runs = {}
    for run in range(150):
        runs[run] = [(k, kind, None if kind in ("final", "llm_error", "unknown") else f"s{rng.randint(0, 40)}", rng.random() < 0.6) for k, kind in enumerate(rng.choices(["call", "unknown", "final", "llm_error"], [20, 4, 1, 0.5], k=rng.randint(1, 50)), 1)]
    runs[None] = [(1, "call", None, True), (2, "call", None, True)]
    frame = spark.createDataFrame([(run, *r) for run, own in runs.items() for r in own], "run_id long, step int, kind string, signature string, ok boolean").repartition(5)
    assert {r[0]: tuple(r[1:]) for r in agents.stops(frame, steps, errors).collect()} == {run: plain(own, steps, errors) for run, own in runs.items()}


def test_places_in_groups(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.random(), i) for i in range(3000)]
    got = {r["i"]: r["place"] for r in sequence.numbered(spark.createDataFrame(rows, "g long, x double, i long").repartition(7), ["g"], ["x", "i"]).collect()}
    for g in (1, 2, None):
        assert [got[i] for _, _, i in sorted((r for r in rows if r[0] == g), key=lambda r: r[1:])] == list(range(1, sum(r[0] == g for r in rows) + 1))
    assert sequence.numbered(spark.createDataFrame([], "g long, x double"), ["g"], ["x"]).count() == 0


SCHEMA = {
    "type": "object", "required": ["query", "k"], "additionalProperties": False,
    "properties": {
        "query": {"type": "string", "minLength": 2, "maxLength": 5, "pattern": "^[a-z]+$"}, "k": {"type": "integer", "minimum": 1, "maximum": 9}, "mode": {"enum": ["fast", 2, None]}, "w": {"type": ["number", "null"], "exclusiveMinimum": 0},
        "tags": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "object", "required": ["n"], "properties": {"n": {"type": "boolean"}}}}, "v": {"const": 1},
    },
}
CASES = [
    ('{"query": "abc", "k": 3}', []), ('{"query": "abc", "k": 3.0, "mode": 2.0, "w": null, "v": 1, "tags": [{"n": true}]}', []), (None, ["$"]), ("{", ["$"]), ("[1]", ["$"]), ("{}", ["$", "$"]),
    ('{"query": "a", "k": 0}', ["$.query", "$.k"]), ('{"query": "ABCDEF", "k": 10}', ["$.query", "$.query", "$.k"]), ('{"query": 5, "k": "3"}', ["$.query", "$.k"]), ('{"query": "abc", "k": 1.5}', ["$.k"]), ('{"query": "abc", "k": true}', ["$.k"]),
    ('{"query": "abc", "k": 1, "mode": "slow"}', ["$.mode"]), ('{"query": "abc", "k": 1, "mode": null, "w": 0}', ["$.w"]), ('{"query": "abc", "k": 1, "tags": []}', ["$.tags"]), ('{"query": "abc", "k": 1, "x": 1, "y": 2}', ["$.x", "$.y"]), ('{"query": "abc", "k": null}', ["$.k"]),
    ('{"query": "abc", "k": 1, "tags": [{"n": 1}, {}, 7]}', ["$.tags", "$.tags[0].n", "$.tags[1]", "$.tags[2]"]), ('{"query": "abc", "k": 1, "v": 2}', ["$.v"]), ('{"query": "abc", "k": 12345678901}', ["$.k"]),
]


def test_schemas(spark):
    df = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(CASES)], "i int, arguments string").withColumn("tool", F.lit("search"))
    for table in (df, df.repartition(3)):
        got = {r["i"]: [v["path"] for v in r["violations"]] for r in schemas.validated(table, {"search": SCHEMA}).collect()}
        assert got == {i: want for i, (_, want) in enumerate(CASES)}
    assert schemas.validated(df.limit(1), {"other": SCHEMA}).first()["violations"][0]["message"] == "the tool is not known"
    for bad in ({"oneOf": []}, {"type": "text"}, {"additionalProperties": {"type": "string"}}):
        with pytest.raises(ValueError):
            schemas.violations(bad, F.col("arguments"))
    with pytest.raises(re.error):
        schemas.violations({"pattern": "("}, F.col("arguments"))


def test_permissions(spark):
    calls = spark.createDataFrame([(1, "read"), (2, "write"), (3, "other"), (4, None)], "i int, tool string")
    tools = spark.createDataFrame([("read", True), ("write", False)], "tool string, readonly boolean")
    reasons = lambda **x: [r["reason"] for r in schemas.permitted(calls, tools, **x).orderBy("i").collect()]
    assert reasons() == [None, "write tools are disabled", "unknown tool", "unknown tool"]
    assert reasons(allow_write=True)[:2] == [None, None]
    assert reasons(allowlist=("write",))[:2] == ["tool not in allowlist", "write tools are disabled"]


def test_selections_by_rows_equal_those_by_arrays(spark):
    from parley.operators import evaluation

    rng = random.Random(7)
    runs = {r: ([rng.choice("abcd") for _ in range(rng.randint(0, 5))], [rng.choice("abce") for _ in range(rng.randint(0, 4))]) for r in range(80)}
    runs |= {100: (["a", "b"], ["a", "b"]), 101: (["a"], ["a", "b"])}
    flat = lambda k: spark.createDataFrame([(r, i, t) for r, own in runs.items() for i, t in enumerate(own[k], 1)], "run_id long, place long, tool string")
    got = {r[0]: tuple(r[1:]) for r in evaluation.selections(flat(0), flat(1)).collect()}
    arrays = spark.createDataFrame([(r, *own) for r, own in runs.items() if own[0] or own[1]], "run_id long, c array<string>, e array<string>")
    s = evaluation.selection(F.col("c"), F.col("e"))
    want = {r[0]: tuple(r[1:]) for r in arrays.select("run_id", "c", "e", s["first_ok"].alias("f"), s["exact"].alias("x"), F.round(s["set_recall"], 6).alias("r"), F.round(s["precision"], 6).alias("p")).select("run_id", "f", "x", "r", "p").collect()}
    assert got == want
