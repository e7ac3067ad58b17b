"""The stored index: search by bounds against scoring all, additions, versions."""

import random

import pytest
from parley.operators import index, retrieval
from parley.sources import manifest
from pyspark.sql import functions as F


def corpus(spark, first, last, seed=1):
    rng, words = random.Random(seed), [f"w{k}" for k in range(400)]
    rows = []
    for i in range(last):
        text = " ".join(rng.choices(words, weights=[1 / (1 + k) for k in range(400)], k=rng.choice([5, 30, 200])))
        if first <= i:
            rows.append((i, f"t{i % 7}", "s", "语义检索 " + text if i % 50 == 0 else text, "knowledge" if i % 3 else "meetings"))
    return spark.createDataFrame(rows, "doc_id long, title string, section string, text string, source_type string").repartition(2)


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "w3 w250 w250 语义"), (2, "w1"), (3, "nothing here"), (4, "w399 w0 w17 w80"), (5, None)], "query_id long, text string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_search_equals_scoring_all_and_reads_less(spark, asked, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "RANGE", 32)
    monkeypatch.setattr(index, "FIRST", 2)
    docs = corpus(spark, 0, 1500)
    built = index.build(docs, str(tmp_path / "i"))
    for k in (1, 5, 2000):
        found, reads = index.search(built, asked, k)
        assert rows(found) == rows(retrieval.ranked(retrieval.bm25(asked, docs), k).select("query_id", "rank", "doc_id", "score"))
        seen = {r["query_id"]: (r["blocks"], r["read"]) for r in reads.collect()}
        assert set(seen) == {1, 2, 4} and all(read <= blocks for blocks, read in seen.values())
        if k == 1:
            assert sum(read for _, read in seen.values()) < 0.7 * sum(blocks for blocks, _ in seen.values())
    near = retrieval.ranked(retrieval.cosine(asked, docs, 4), 4).select("query_id", "rank", "doc_id", "score")
    assert rows(index.nearest(built, asked, 4)) == rows(near)


def test_additions_equal_a_full_build(spark, asked, tmp_path):
    whole = index.build(corpus(spark, 0, 300), str(tmp_path / "whole"))
    part = index.build(corpus(spark, 0, 120), str(tmp_path / "part"))
    more = index.append(index.append(part, corpus(spark, 60, 200)), corpus(spark, 0, 300))
    assert index.append(more, corpus(spark, 0, 300)) is more
    assert (more.content["version"], len(more.segments), more.documents(), more.mean()) == (3, 3, 300, whole.mean())
    want = rows(index.search(whole, asked, 7)[0])
    small = index.compact(more)
    assert rows(index.search(more, asked, 7)[0]) == rows(index.search(small, asked, 7)[0]) == want and len(small.segments) == 1
    assert rows(index.search(index.load(spark, str(tmp_path / "part"), version=3), asked, 7)[0]) == want  # an old version stays whole
    assert len(index.vacuum(small)) == 3 and rows(index.search(index.load(spark, str(tmp_path / "part")), asked, 7)[0]) == want
    by = {r["source_type"]: (r["chunks"], r["docs"]) for r in index.stats(small).collect()}
    assert by[None] == (300, 7) and by["meetings"][0] == 100
    assert index.corpus(small).filter(F.size("tokens") > 0).count() == 300


def test_only_the_best_leave_a_range(spark, asked, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "RANGE", 32)
    counts, written = [], index.shared.written
    monkeypatch.setattr(index.shared, "written", lambda df, name: (out := written(df, name), name == "scored" and counts.append(out.count()))[0])
    index.search(index.build(corpus(spark, 0, 500), str(tmp_path / "i")), asked, 1)
    assert len(counts) == 1 and 0 < counts[0] <= 2 * 3 * index.FIRST  # three queries find something; ties count


def test_what_is_stored_is_not_analysed_or_joined_again(spark, tmp_path, monkeypatch):
    built = index.append(index.build(corpus(spark, 0, 100), str(tmp_path / "i")), corpus(spark, 50, 150))
    assert "Join" not in index.corpus(built)._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(index.T, "tokens", None)
    assert index.compact(built).documents() == 150


def test_buckets_of_batches_are_those_of_the_expression(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a", "语义"]), (2, []), (3, None), (4, ["b"])], "doc_id long, tokens array<string>")
    got = {r["doc_id"]: r["b"] for r in retrieval.with_buckets(docs, 64).collect()}
    want = {r["doc_id"]: r["b"] for r in docs.select("doc_id", retrieval.buckets(F.col("tokens"), 64).alias("b")).collect()}
    assert got == {**want, 3: []}


def test_versions_swap_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "i")
    with pytest.raises(ValueError):
        index.load(spark, path)
    with pytest.raises(ValueError):
        index.build(corpus(spark, 0, 0), path)
    first = index.build(corpus(spark, 0, 20), path)
    index.append(first, corpus(spark, 20, 30))
    with pytest.raises(manifest.Conflict):
        index.append(first, corpus(spark, 20, 25))
    assert index.load(spark, path).documents() == 30 and manifest.versions(spark, f"{path}/manifest") == [1, 2]
    assert len(index.vacuum(index.load(spark, path), keep=2)) == 1  # of the writer that lost
    with pytest.raises(ValueError):
        index.load(spark, path, "other")


def test_many_queries_go_block_by_block(spark, monkeypatch):
    docs, monkey = corpus(spark, 0, 200), spark.range(60).select(F.col("id").alias("query_id"), F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" w1")).alias("text"))
    want = rows(retrieval.ranked(retrieval.cosine(monkey, docs), 3).select("query_id", "rank", "doc_id", "score"))
    for most in (10, 4_096):
        monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", most)
        assert rows(retrieval.ranked(retrieval.cosine(monkey, docs, 3), 3).select("query_id", "rank", "doc_id", "score")) == want


def test_blocks_of_queries_read_buckets_that_are_cut_once(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", 10)
    names, written = [], retrieval.shared.written
    monkeypatch.setattr(retrieval.shared, "written", lambda df, name: (names.append(name), written(df, name))[1])
    queries = spark.range(40).select(F.col("id").alias("query_id"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"))
    plan = retrieval.cosine(queries, corpus(spark, 0, 50), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert names.count("buckets") == 1 and "regexp_extract_all" not in plan


def test_running_best_keeps_the_smallest_ids_of_ties(spark):
    same = spark.range(30_000).select((F.lit(30_000) - F.col("id")).alias("doc_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("x")).coalesce(1)
    queries = spark.createDataFrame([(1, [1.0, 2.0]), (-5, [0.0, 1.0])], "query_id long, x array<double>")
    found = retrieval.nearest(queries, same, 3)
    assert found.count() == 6
    assert rows(retrieval.ranked(found, 3).select("query_id", "doc_id")) == [(-5, 1), (-5, 2), (-5, 3), (1, 2), (1, 3), (1, 4)]


@pytest.mark.parametrize("limit", ["BROADCAST_QUERIES", "BROADCAST_TERMS", None])
def test_best_of_bm25_is_that_of_all_scores(spark, asked, monkeypatch, limit):
    docs = corpus(spark, 0, 400)
    docs = docs.unionByName(docs.filter("doc_id % 3 = 0").withColumn("doc_id", F.col("doc_id") + 1000))  # ties
    if limit:
        monkeypatch.setattr(retrieval, limit, 1)
    for k in (1, 7):
        want = rows(retrieval.ranked(retrieval.bm25(asked, docs), k).select("query_id", "rank", "doc_id", "score"))
        assert rows(retrieval.ranked(retrieval.bm25_best(asked, docs, k), k).select("query_id", "rank", "doc_id", "score")) == want
    assert retrieval.bm25_best(asked, docs.limit(0), 3).count() == retrieval.bm25_best(asked.limit(0), docs, 3).count() == 0


def test_signatures_follow_the_files(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(3).write.parquet(path)
    first = manifest.signature(spark, path)
    assert first == manifest.signature(spark, path)
    spark.range(4).write.mode("overwrite").parquet(path)
    assert first != manifest.signature(spark, path)
