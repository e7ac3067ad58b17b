"""Registered queries against their SQL in DuckDB on the smallest tables."""

import math

import duckdb
import pytest
from parley.jobs import catalog, workflows  # noqa: F401  (both fill one catalogue)

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in TABLES:
        out.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return out


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, con, name):
    df = catalog.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    rel = con.sql(catalog.oracle_sql()[name])
    assert cols == sorted(rel.columns)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*cols).collect()), key=repr)
    want = sorted((tuple(plain(x) for x in r) for r in rel.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall()), key=repr)
    assert got == want and got


def test_scripts_are_ranked_by_running_bests(spark, monkeypatch):
    """Joins of all postings took 35 times the input of disk."""
    monkeypatch.setattr(catalog.retrieval, "bm25", None)
    plan = catalog.bm25_scripts(spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan


def test_names_of_queries_are_taken_once():
    with pytest.raises(ValueError):
        catalog.query()(catalog.join_greedy_bipartite)


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["query_id", "rank", "doc_id", "score", "coverage", "phrase", "section_hit", "term_hits"]
    assert set(e.oracle_sql()) <= set(e.queries())
