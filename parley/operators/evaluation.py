"""Scores of retrieval and extraction results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_hits(results: DataFrame, expected: DataFrame, queries: DataFrame) -> DataFrame:
    """The rows of queries (query_id, ...) with first_rank (null: none), hit1, hit5, reciprocal. results: query_id, doc_id,
    rank; expected: query_id, doc_id."""
    ranks = results.join(expected, ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    own = queries.join(ranks, "query_id", "left")
    rank = F.col("first_rank")
    return own.select(*queries.columns, "first_rank", F.coalesce((rank <= 1).cast("int"), F.lit(0)).alias("hit1"), F.coalesce((rank <= 5).cast("int"), F.lit(0)).alias("hit5"), F.coalesce(1.0 / rank, F.lit(0.0)).alias("reciprocal"))


def recall_mrr(hits: DataFrame, *by: str) -> DataFrame:
    return hits.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg("hit1"), 3).alias("recall1"), F.round(F.avg("hit5"), 3).alias("recall5"), F.round(F.avg("reciprocal"), 3).alias("mrr"))


def ablation(hits: DataFrame, category: str = "category") -> DataFrame:
    """category (null: all), and on minus off of each metric, for hits with an arm column."""
    cells = hits.groupBy(category, "arm").agg(F.sum("hit1").alias("h"), F.sum("reciprocal").alias("r"), F.count("*").alias("n"))
    wide = cells.rollup(category).agg(*[(F.sum(F.when(F.col("arm") == a, F.col(c))) / F.sum(F.when(F.col("arm") == a, F.col("n")))).alias(f"{c}_{a}") for a in ("on", "off") for c in "hr"])
    return wide.select(category, F.round(F.col("h_on") - F.col("h_off"), 3).alias("recall1_delta"), F.round(F.col("r_on") - F.col("r_off"), 3).alias("mrr_delta"))


def verifiable(results: DataFrame, corpus: DataFrame) -> DataFrame:
    """query_id, cited, verifiable: how many chunks a query's results cite, and the share that the corpus holds."""
    known = corpus.select("doc_id", F.lit(1).alias("known"))
    held = results.select("query_id", "doc_id").join(known, "doc_id", "left")
    return held.groupBy("query_id").agg(F.count("*").alias("cited"), F.round(F.avg(F.coalesce("known", F.lit(0))), 6).alias("verifiable"))


def term_hits(expected: DataFrame, results: DataFrame, corpus: DataFrame) -> DataFrame:
    """query_id, expected, found, share: terms (query_id, term) that lie in a text of the query's results."""
    texts = results.select("query_id", "doc_id").join(corpus.select("doc_id", F.lower("text").alias("low")), "doc_id")
    found = expected.join(texts, "query_id", "left").groupBy("query_id", "term").agg(F.coalesce(F.max(F.col("low").contains(F.lower("term")).cast("int")), F.lit(0)).alias("hit"))
    return found.groupBy("query_id").agg(F.count("*").alias("expected"), F.sum("hit").alias("found"), F.round(F.avg("hit"), 6).alias("share"))


def prf(matched: Column, predicted: Column, golden: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 from counts; empty sides give 0."""
    p = F.when(predicted > 0, matched / predicted).otherwise(0.0)
    r = F.when(golden > 0, matched / golden).otherwise(0.0)
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def selection(called: Column, expected: Column) -> dict[str, Column]:
    """Scores of a sequence of tool calls against the expected one."""
    common = F.size(F.array_intersect(called, expected))
    return {
        "first_ok": F.coalesce(F.get(called, F.lit(0)) == F.get(expected, F.lit(0)), F.lit(False)).cast("int"),
        "exact": (called == expected).cast("int"),
        "set_recall": F.when(F.size(expected) > 0, common / F.size(F.array_distinct(expected))).otherwise(1.0),
        "precision": F.when(F.size(called) > 0, F.size(F.filter(called, lambda c: F.array_contains(expected, c))) / F.size(called)).otherwise(0.0),
    }


def selections(called: DataFrame, expected: DataFrame) -> DataFrame:
    """run_id, first_ok, exact, set_recall, precision (6 digits) of runs' tool calls (run_id, place from 1, tool) against those
    expected, as selection() scores arrays of them; runs of either side have a row. Calls meet by place and are counted by
    tool, so no run is one row."""
    both = called.select("run_id", "place", F.col("tool").alias("c")).join(expected.select("run_id", "place", F.col("tool").alias("e")), ["run_id", "place"], "full")
    same = F.coalesce(F.col("c") == F.col("e"), F.lit(False))
    order = both.groupBy("run_id").agg(F.coalesce(F.max(F.when(F.col("place") == 1, same.cast("int"))), F.lit(0)).alias("first_ok"), F.min(same.cast("int")).alias("exact"))
    n = lambda df, name: df.groupBy("run_id", "tool").agg(F.count("*").alias(name))
    tools = n(called, "c").join(n(expected, "e"), ["run_id", "tool"], "full").na.fill(0, ["c", "e"])
    wanted, made = F.count_if(F.col("e") > 0), F.sum("c")
    sets = tools.groupBy("run_id").agg(F.when(wanted > 0, F.count_if((F.col("c") > 0) & (F.col("e") > 0)) / wanted).otherwise(1.0).alias("set_recall"), F.when(made > 0, F.sum(F.when(F.col("e") > 0, F.col("c")).otherwise(0)) / made).otherwise(0.0).alias("precision"))
    return order.join(sets, "run_id").select("run_id", "first_ok", "exact", F.round("set_recall", 6).alias("set_recall"), F.round("precision", 6).alias("precision"))


def answer_level(answers: DataFrame, corpus: DataFrame) -> DataFrame:
    """arm, answered, citation_valid_rate, term_covered_rate (null without expected terms) for answers (id, arm, text, answered,
    citations, terms): an answer's citations are valid if there are some and the corpus (doc_id) holds all; its terms are
    covered if the text holds one of those expected. Every arm has a row."""
    cited = answers.filter("answered").select("id", "arm", F.explode(F.array_distinct("citations")).alias("doc_id")).join(corpus.select("doc_id", F.lit(1).alias("known")).distinct(), "doc_id", "left")
    valid = cited.groupBy("id", "arm").agg(F.min(F.coalesce("known", F.lit(0))).alias("valid"))
    own = answers.join(valid, ["id", "arm"], "left")
    yes, asks = F.col("answered"), F.col("answered") & (F.size("terms") > 0)
    covered = F.exists("terms", lambda t: F.col("text").contains(t))
    n = F.greatest(F.count_if(yes), F.lit(1))
    return own.groupBy("arm").agg(F.count_if(yes).alias("answered"), F.round(F.count_if(yes & (F.col("valid") == 1)) / n, 3).alias("citation_valid_rate"), F.when(F.count_if(asks) > 0, F.round(F.count_if(asks & covered) / F.count_if(asks), 3)).alias("term_covered_rate"))


def degradation(runs: DataFrame, samples: int = 3) -> DataFrame:
    """runs, completed, completed_rate, errors_recorded, reports_written, error_samples of runs (run_id, status, errors, report)."""
    failed = F.size("errors") > 0
    some = F.max_by("errors", F.struct(failed.cast("int"), F.col("run_id").cast("string")))
    return runs.agg(
        F.count("*").alias("runs"), F.count_if(F.col("status") == "completed").alias("completed"), F.round(F.count_if(F.col("status") == "completed") / F.count("*"), 3).alias("completed_rate"),
        F.count_if(failed).alias("errors_recorded"), F.count_if(F.trim(F.coalesce("report", F.lit(""))) != "").alias("reports_written"), F.slice(some, 1, samples).alias("error_samples"),
    )
