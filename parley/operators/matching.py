"""Greedy matching of expected and found items within groups, as a distributed job.

The rule is sequential: expected items take, in their order, the first found item that fits and is still free. What the rule
decides is decided here by many tasks. Expected items with the same requirement form a class, so candidates are rows
(class, found item) and not pairs of items. In each round, classes that can take the same free items are merged; the r-th
open item of a class would take the r-th free item of its candidates, and surely does so if no item of another class that
comes before it can take one of the first r. All such pairs are taken at once. Groups with few candidates left are finished by
the rule itself in one task each.
"""

from __future__ import annotations

import pandas as pd
from parley.operators import terms
from parley.sources import shared
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Candidates that a group has at most when it is finished in one task.
SMALL = 100_000
#: Candidates of the groups that a task finishes together, on average.
BATCH = 20_000


def candidates(golden: DataFrame, predicted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, edges): members (grp, g, cls) of golden (grp, g, assignee, keywords) that are named and have keywords; edges
    (grp, cls, p) where an item of predicted (grp, p, assignee, task) fits: one name lies in the other and a keyword in the
    task, whatever its case. cls is the smallest g of a requirement; the g of a group are distinct, so are its p. Rows without a group match nothing."""
    golden, predicted = golden.filter("grp is not null"), predicted.filter("grp is not null")
    own = F.array_sort(F.array_distinct(F.transform("keywords", F.lower)))
    named = golden.filter("assignee <> '' and size(keywords) > 0").select("grp", "g", "assignee", own.alias("keywords"))
    classes = named.groupBy("grp", "assignee", "keywords").agg(F.min("g").alias("cls"))
    members = named.join(classes, ["grp", "assignee", "keywords"]).select("grp", "g", "cls")
    tasks = predicted.select("task").distinct()
    words = classes.select(F.explode("keywords").alias("form")).distinct()
    hits = terms.contained(tasks, words, "task", "task").select("task", F.col("form").alias("keyword"))
    wanted = classes.select("grp", "cls", F.col("assignee").alias("want"), F.explode("keywords").alias("keyword"))
    found = predicted.select("grp", "p", F.coalesce("assignee", F.lit("")).alias("assignee"), "task").join(hits, "task")
    fits = F.col("assignee").contains(F.col("want")) | F.col("want").contains(F.col("assignee"))
    return members, found.join(wanted, ["grp", "keyword"]).filter(fits).select("grp", "cls", "p").distinct()


def _fold(members: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """The rule itself on some groups. A class's free candidates only ever lose items, so each list is walked once."""
    lists = {key: iter(sorted(own)) for key, own in edges.groupby(["grp", "cls"])["p"]}
    used, pairs = set(), []
    for grp, g, cls in sorted(zip(members["grp"], members["g"], members["cls"], strict=True)):
        p = next((p for p in lists.get((grp, cls), ()) if (grp, p) not in used), None)
        if p is not None:
            used.add((grp, p))
            pairs.append((grp, g, p))
    return pd.DataFrame(pairs, columns=["grp", "g", "p"])


def _round(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs that the rule is certain to make, at least one in each group with candidates."""
    sign = edges.groupBy("grp", "cls").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("p")).alias("x"), F.bit_xor(F.xxhash64("p", F.lit(1))).alias("y"))
    merged = sign.withColumn("c", F.min("cls").over(Window.partitionBy("grp", "n", "x", "y"))).select("grp", "cls", "c")
    own = members.join(merged, ["grp", "cls"])
    heads = own.groupBy("grp", "c").agg(F.min("g").alias("head"))
    free = edges.join(merged.filter("cls = c").select("grp", "cls"), ["grp", "cls"], "left_semi").withColumnRenamed("cls", "c").join(heads, ["grp", "c"])
    at_item = Window.partitionBy("grp", "p").orderBy("head")
    rival = F.when(F.row_number().over(at_item) == 1, F.lead("head").over(at_item)).otherwise(F.first("head").over(at_item))
    in_class = Window.partitionBy("grp", "c").orderBy("p")
    free = free.withColumn("rival", rival).withColumn("rival", F.min("rival").over(in_class)).withColumn("k", F.row_number().over(in_class))
    placed = own.withColumn("k", F.row_number().over(Window.partitionBy("grp", "c").orderBy("g")))
    return placed.join(free, ["grp", "c", "k"]).filter("rival is null or g < rival").select("grp", "g", "p")


def greedy(golden: DataFrame, predicted: DataFrame, small: int = SMALL) -> DataFrame:
    """grp, g, p: the pairs that the sequential rule makes. Inputs as in candidates(); rounds go on until none is open."""
    members, edges = (shared.written(x, "matching") for x in candidates(golden, predicted))
    kinds = dict(members.dtypes)
    schema, out = f"grp {kinds['grp']}, g {kinds['g']}, p {dict(edges.dtypes)['p']}", []
    while True:
        large = edges.groupBy("grp").count().filter(F.col("count") > small).select("grp")
        heaps = F.pmod(F.xxhash64("grp"), F.lit(1 + edges.count() // BATCH))
        few = (x.join(large, "grp", "left_anti").withColumn("heap", heaps).groupBy("heap") for x in (members, edges))
        out.append(next(few).cogroup(next(few)).applyInPandas(_fold, schema))
        members, edges = (shared.written(x.join(large, "grp", "left_semi"), "matching") for x in (members, edges))
        if edges.isEmpty():
            break
        pairs = shared.written(_round(members, edges), "matched")
        out.append(pairs)
        left = shared.written(edges.join(pairs.select("grp", "p"), ["grp", "p"], "left_anti"), "matching")
        open_ = members.join(pairs.select("grp", "g"), ["grp", "g"], "left_anti")
        members, edges = open_.join(left.select("grp", "cls").distinct(), ["grp", "cls"], "left_semi"), left
        edges = edges.join(members.select("grp", "cls").distinct(), ["grp", "cls"], "left_semi")
    both = out[0]
    for more in out[1:]:
        both = both.unionByName(more)
    return both


def scores(golden: DataFrame, predicted: DataFrame, pairs: DataFrame) -> DataFrame:
    """grp, golden, predicted, matched, precision, recall, f1 (3 digits) for every group of either side."""
    from parley.operators.evaluation import prf

    one = lambda df, c: df.groupBy("grp").agg(F.count("*").alias(c))
    all_ = one(golden, "golden").join(one(predicted, "predicted"), "grp", "full").join(one(pairs, "matched"), "grp", "left").na.fill(0)
    p, r, f1 = prf(F.col("matched"), F.col("predicted"), F.col("golden"))
    return all_.select("grp", "golden", "predicted", "matched", F.round(p, 3).alias("precision"), F.round(r, 3).alias("recall"), F.round(f1, 3).alias("f1"))
