"""Greedy matching and forms in texts against the plain rules."""

import random

import pytest
from parley.operators import matching, terms


def plain(golden, predicted):
    used, out = set(), []
    for grp, g, who, words in sorted(golden, key=lambda r: r[1]):
        for other, p, name, task in sorted(predicted, key=lambda r: r[1]):
            if other == grp and (grp, p) not in used and who and (who in (name or "") or (name or "") in who) and any(w.lower() in (task or "").lower() for w in words):
                used.add((grp, p))
                out.append((grp, g, p))
                break
    return sorted(out)


@pytest.mark.parametrize(("small", "seed"), [(100_000, 1), (0, 2), (3, 3)])
def test_greedy_is_the_sequential_rule(spark, small, seed):
    rng = random.Random(seed)
    names, words = ["Ann", "Anna", "An", "Bo", "", "Bo Li"], ["red", "Re", "blue", "b", "green"]
    golden = [(grp, g, rng.choice(names), rng.choices(words, k=rng.randint(0, 2))) for grp in range(4) for g in range(rng.choice([0, 12, 25]))]
    predicted = [(grp, p * 7, rng.choice([*names, None]), rng.choice(["a RED one", "blue", "Green b", "", None, "red blue"])) for grp in range(5) for p in range(rng.choice([0, 10, 25]))]
    g = spark.createDataFrame(golden + [(9, 1, "Ann", ["red"])], "grp long, g long, assignee string, keywords array<string>")
    p = spark.createDataFrame(predicted, "grp long, p long, assignee string, task string")
    pairs = matching.greedy(g, p, small)
    assert sorted(map(tuple, pairs.collect())) == plain(golden, predicted)
    rows = {r["grp"]: r for r in matching.scores(g, p, pairs).collect()}
    assert rows[9]["golden"] == 1 and rows[9]["matched"] == rows[9]["f1"] == 0


def test_greedy_of_one_large_class_takes_few_rounds(spark, monkeypatch):
    rounds, own = [], matching._round
    monkeypatch.setattr(matching, "_round", lambda *a: rounds.append(1) or own(*a))
    g = spark.createDataFrame([(1, k, "Ann" if k % 2 else "Anna", ["red"]) for k in range(300)], "grp long, g long, assignee string, keywords array<string>")
    p = spark.createDataFrame([(1, k, "Anna Lee", "red") for k in range(500)], "grp long, p long, assignee string, task string")
    assert sorted(map(tuple, matching.greedy(g, p, 0).collect())) == [(1, k, k) for k in range(300)] and len(rounds) == 1


def test_forms_by_grams_equal_the_loop(spark):
    rng = random.Random(5)
    letters = "ab语义检索cd E"
    make = lambda n: "".join(rng.choices(letters, k=n))
    forms = sorted({make(rng.randint(1, 7)) for _ in range(400)}) + ["", "not there at all"]
    texts = [(i, make(rng.randint(0, 60))) for i in range(200)] + [(900, None), (901, "")]
    f, t = spark.createDataFrame([(x,) for x in forms], "form string"), spark.createDataFrame(texts, "k long, text string")
    want = sorted((k, x) for k, text in texts for x in forms if x and x.lower() in (text or "").lower())
    for loop in (0, 10_000):
        assert sorted(map(tuple, terms.contained(t, f, "k", loop=loop).collect())) == want


def test_a_glossary_of_many_forms(spark):
    forms = spark.range(100_000).selectExpr("concat('term', cast(id as string)) as form")
    texts = spark.createDataFrame([(1, "about TERM77 and term99999, term100000"), (2, "nothing")], "k long, text string")
    assert {r["form"] for r in terms.contained(texts, forms, "k").collect()} == {"term7", "term77", "term9", "term99", "term999", "term9999", "term99999", "term1", "term10", "term100", "term1000", "term10000"}
    index = terms.gram_index(forms)
    assert index.count() == 100_000 and index.groupBy("gram").count().agg({"count": "max"}).first()[0] < 40_000
