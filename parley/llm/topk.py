"""Operator 6: exact top-k search by aggregation without random access.

A vector's components become integers floor(64 x). For a query, each dimension is a list of the candidates sorted by what
the component adds to the score. The lists of a block of candidates are read in strips, from the best entry down. What
was read of a candidate, plus the last value read (upper) or the list's last value (lower) for every dimension not read, bounds its
score. Reading stops when no candidate outside the k best lower bounds can still reach the k-th; the final scores of those left are then
resolved. Bounds of all queries of a block are kept by matrix products of what has been read, exact in integers.

Candidates and queries are dealt into blocks by hash; each pair of blocks is a task of bounded size and hands on at most k
rows a query, of which a window keeps the best.

Dense vectors rarely let reading stop before the last strip; the bounds then only spare the final scores of most candidates.

Defined cases: rows with a null id, a null vector or a null or non-finite component take no part; a shorter vector counts
as 0 in the dimensions that it lacks; rows with the query's own id are not candidates; a repeated id is a candidate a row and
a query a row, each with its own ranks; ties go to the smaller id; components and scores of any finite size are exact, but a
score beyond a long is given, and ranked, as the nearest long; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Candidates and queries of a block.
CANDIDATES, QUERIES = 8_192, 1_024
#: Parts of the sorted lists that are read before bounds are compared.
STRIPS = (0.25, 0.5, 0.75, 1.0)


def _matrix(rows: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims))
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def block_top(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> pd.DataFrame:
    """The k best candidates of each query: the query's place in q_ids, query_id, vec_id, score."""
    high = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(1, q.shape[1])
    kind = np.float32 if high < 2**24 else np.float64
    if high >= 2**53:
        return _resolve(q_ids, q, c_ids, c, np.ones((len(q), len(c)), bool), k, object)
    q, c = q.astype(kind), c.astype(kind)
    up, down = np.maximum(q, 0), np.minimum(q, 0)  # a list is read from its largest values for up, from its smallest for down
    ordered = np.sort(c, axis=0)
    least, most = ordered[0], ordered[-1]
    own = q_ids[:, None] == c_ids[None, :]
    alive = ~own
    for part in STRIPS:
        depth = min(len(c), max(1, int(np.ceil(part * len(c)))))
        top, bottom = ordered[len(c) - depth], ordered[depth - 1]
        read_up, read_down = c >= top, c <= bottom
        seen = up @ np.where(read_up, c, 0).T + down @ np.where(read_down, c, 0).T
        upper = seen + up @ np.where(read_up, 0, top).T + down @ np.where(read_down, 0, bottom).T
        lower = seen + up @ np.where(read_up, 0, least).T + down @ np.where(read_down, 0, most).T
        lower[own] = -np.inf
        if len(c) > k:
            floor = np.partition(lower, len(c) - k, axis=1)[:, len(c) - k]
            alive &= upper >= floor[:, None]
        if alive.sum() <= 4 * k * len(q):
            break
    return _resolve(q_ids, q, c_ids, c, alive, k, kind)


def _resolve(q_ids, q, c_ids, c, alive, k, kind) -> pd.DataFrame:
    rows, cols = np.nonzero(alive & (q_ids[:, None] != c_ids[None, :]))
    score = np.empty(len(rows), object if kind is object else np.int64)
    for a in range(0, len(rows), 200_000):
        s = slice(a, a + 200_000)
        if kind is object:
            score[s] = [max(-(2**63), min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(q[i], c[j], strict=True)))) for i, j in zip(rows[s], cols[s], strict=True)]
        else:
            score[s] = np.einsum("ij,ij->i", q[rows[s]], c[cols[s]]).astype(np.int64)
    out = pd.DataFrame({"at": rows, "query_id": q_ids[rows], "vec_id": c_ids[cols], "score": score.astype(np.int64)})
    out = out.sort_values(["at", "score", "vec_id"], ascending=[True, False, True])
    return out[out.groupby("at").cumcount() < k]


def search(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score of the k best for each row of vectors (vec_id, embedding) whose id `every` divides."""
    def part(x):  # beyond 2^53 every double is whole
        return F.when(F.abs(x.cast("double")) < 2.0**53, F.floor(64 * x.cast("double")).cast("double")).otherwise(64 * x.cast("double"))

    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & whole).select("vec_id", F.transform("embedding", part).alias("v"))
    n, queries, dims = own.agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1)), F.max(F.size("v"))).first()
    c_blocks, q_blocks = max(1, -(-n // CANDIDATES)), max(1, -(-queries // QUERIES))

    def blocks(df: DataFrame, mine: str, count: int, other: str, others: int) -> DataFrame:
        return df.withColumn(mine, F.pmod(F.xxhash64("vec_id", "v"), F.lit(count)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    # a repeated id is spread over the blocks by its vector too; equal query rows are one query until the end
    candidates = blocks(own, "cb", c_blocks, "qb", q_blocks)
    asked = blocks(own.filter(F.col("vec_id") % every == 0).groupBy("vec_id", "v").agg(F.count("*").alias("times")), "qb", q_blocks, "cb", c_blocks)
    asked = asked.withColumn("query", F.xxhash64("vec_id", "v"))
    schema = "query long, times long, query_id long, vec_id long, score long"

    def best(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({name.split()[0]: [] for name in schema.split(", ")}).astype("int64")
        q_ids, matrix = q["vec_id"].to_numpy(), _matrix(q["v"], dims)
        out = pd.concat([block_top(q_ids, matrix, c["vec_id"].to_numpy()[a : a + 2 * CANDIDATES], _matrix(c["v"][a : a + 2 * CANDIDATES], dims), k) for a in range(0, len(c), 2 * CANDIDATES)])
        at = out.pop("at").to_numpy()
        return out.assign(query=q["query"].to_numpy()[at], times=q["times"].to_numpy()[at])[["query", "times", "query_id", "vec_id", "score"]]

    found = asked.groupBy("qb", "cb").cogroup(candidates.groupBy("qb", "cb")).applyInPandas(best, schema)
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    top = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return top.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("query_id", "rank", "vec_id", "score")
