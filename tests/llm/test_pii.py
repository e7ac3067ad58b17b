"""Personal data in texts with very many matches, long texts and overlapping spans."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
from parley.llm import pii  # noqa: E402


def test_places_before(spark):
    rng = random.Random(1)
    rows = [(k, [rng.randint(0, 9) for _ in range(n)]) for k, n in enumerate([0, 1, 255, 256, 257, 5000])]
    df = spark.createDataFrame(rows, "k int, v array<int>")
    got = {r["k"]: (r["s"], r["m"]) for r in df.select("k", pii._before(F.col("v"), lambda a, x: a + x, 0).alias("s"), pii._before(F.col("v"), lambda a, x: F.greatest(a, x), 0).alias("m")).collect()}
    assert got == {k: ([sum(v[:i]) for i in range(len(v))], [max(v[:i], default=0) for i in range(len(v))]) for k, v in rows}


def test_cut_of_pages(spark):
    text = "".join(random.Random(2).choices("ab é日\n", k=3 * pii.PAGE + 7))
    cuts = [(0, 0), (0, 5), (pii.PAGE - 1, pii.PAGE + 1), (pii.PAGE, 2 * pii.PAGE), (5, len(text)), (len(text) - 1, len(text))]
    df = spark.createDataFrame([(a, b, text) for a, b in cuts], "a int, b int, text string")
    assert {(r["a"], r["b"]): r["c"] for r in df.select("a", "b", pii._cut(pii._pages(F.col("text")), F.col("a"), F.col("b")).alias("c")).collect()} == {(a, b): text[a:b] for a, b in cuts}


def test_reach(spark):
    rng = random.Random(3)
    make = lambda n: [(a, a + rng.randint(1, 9)) for a in sorted(rng.choices(range(400), k=n))]
    rows = [(k, make(rng.choice([0, 3, 60])), make(rng.choice([0, 2, 400]))) for k in range(30)]
    df = spark.createDataFrame(rows, "k int, own array<struct<start:int,end:int>>, others array<struct<start:int,end:int>>")
    got = {r["k"]: r["r"] for r in df.select("k", pii._reach(F.col("own"), F.col("others")).alias("r")).collect()}
    for k, own, others in rows:
        assert [r > a for r, (a, _) in zip(got[k], own, strict=True)] == [any(s < b and e > a for s, e in others) for a, b in own]


def test_a_text_of_a_hundred_thousand_numbers(spark):
    dense, mails = "12 a" * 100_000, "a@b.co +1 555 123 4567 é " * 5_000
    docs = spark.createDataFrame([(1, dense), (2, mails)], "doc_id long, text string")
    began = time.time()
    rows = {r["doc_id"]: r for r in pii.personal_data(docs).collect()}
    assert (rows[1]["n_spans"], rows[2]["n_email"], rows[2]["n_phone"]) == (0, 5_000, 5_000)
    places = [f"{kind}:{m.start(k)}:{m.end(k)}" for m in re.finditer(r"(a@b\.co) (\+1 555 123 4567)", mails) for k, kind in ((1, "email"), (2, "phone"))]
    assert rows[2]["spans"].split(",") == places
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(docs).collect()}
    assert clean == {1: dense, 2: "<EMAIL> <PHONE> é " * 5_000}
    assert time.time() - began < 240
