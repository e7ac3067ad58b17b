"""Operator 5: packing of documents into sequences of at most 2048 tokens by minimum bin slack.

Tokenised documents become pieces of at most `capacity` ids. Only the lengths matter to packing, and there are at most
`capacity` different ones, so the driver packs a histogram: for the next bin it takes the longest piece left, finds with a
bit set of reachable sums the fullest feasible combination with the others (long pieces preferred), and removes it as
often as the counts allow. Each such step uses up a length, so there are at most `capacity` patterns. Pieces then find their
place by their rank among those of their length, which tasks number by themselves and a sum over tasks shifts.

Defined cases: a null or empty text is the end id alone; a repeated doc_id is a document a row; a null doc_id is kept; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .tokens import encoder


def fullest(lengths: list[int], counts: list[int], room: int) -> list[tuple[int, int]]:
    """(length, times) of a combination with the largest sum up to room; lengths descending, long ones preferred."""
    items, masks, mask = [], [1], (1 << (room + 1)) - 1
    for length, count in zip(lengths, counts, strict=True):
        left, times = min(count, room // length), 1
        while left > 0:
            times = min(times, left)
            items.append((length, times))
            masks.append((masks[-1] | masks[-1] << (length * times)) & mask)
            left -= times
            times *= 2
            if masks[-1] >> room & 1:
                break
        if masks[-1] >> room & 1:
            break
    at, taken = masks[-1].bit_length() - 1, {}
    for k in range(len(items) - 1, -1, -1):
        if not masks[k] >> at & 1:
            length, times = items[k]
            taken[length] = taken.get(length, 0) + times
            at -= length * times
    return list(taken.items())


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(bins, [(length, pieces a bin)]) until no piece is left."""
    left, out = {k: v for k, v in histogram.items() if v}, []
    while left:
        longest = max(left)
        lengths = sorted((k for k in left if k + longest <= capacity), reverse=True)
        rest = fullest(lengths, [left[k] - (k == longest) for k in lengths], capacity - longest)
        use = dict(rest)
        use[longest] = use.get(longest, 0) + 1
        bins = min(left[k] // v for k, v in use.items())
        for k, v in use.items():
            left[k] -= bins * v
            if not left[k]:
                del left[k]
        out.append((bins, sorted(use.items(), reverse=True)))
    return out


def places(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, first bin, pieces a bin and offset of its runs."""
    runs: dict[int, list] = {}
    used: dict[int, int] = {}
    first = 0
    for bins, use in plan:
        at = 0
        for length, times in use:
            runs.setdefault(length, []).append((used.get(length, 0), first, times, at))
            used[length] = used.get(length, 0) + bins * times
            at += length * times
        first += bins
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in runs.items()}


def _cut(tokenizer: str, end_id: int, capacity: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(frames):
        enc, seen, task = encoder(tokenizer), {}, TaskContext.get().partitionId()
        for part in C.text_slices(frames, "text", 4_000_000):
            rows = []
            for doc_id, ids in zip(part["doc_id"].astype(object), enc.encode(part["text"].tolist()), strict=True):
                ids += end
                for k in range(0, len(ids), 4 * capacity):
                    own = ids[k : k + 4 * capacity]
                    n = len(own) // 4
                    rank = seen.get(n, 0)
                    seen[n] = rank + 1
                    rows.append((None if pd.isna(doc_id) else doc_id, k // (4 * capacity), k // 4, n, zlib.crc32(own), task, rank))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"]).astype({"doc_id": "Int64"})

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs (doc_id, text)."""
    sc = docs.sparkSession.sparkContext
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cut = docs.mapInPandas(_cut(tokenizer, end_id, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, task long, rank long")
    pieces = C.materialize(cut, "pieces")
    counts = C.materialize(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = sc.broadcast(places(patterns(histogram, capacity)))
    before = counts.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))

    def place(frames):
        for f in frames:
            rank, length = (f["rank"] + f["before"]).to_numpy(np.int64), f["length"].to_numpy(np.int64)
            sequence, offset = np.zeros(len(f), np.int64), np.zeros(len(f), np.int64)
            for n in np.unique(length):
                mine = length == n
                first_rank, first_bin, times, at = where.value[int(n)]
                k = np.searchsorted(first_rank, rank[mine], "right") - 1
                turn = rank[mine] - first_rank[k]
                sequence[mine] = first_bin[k] + turn // times[k]
                offset[mine] = at[k] + turn % times[k] * n
            yield f[["doc_id", "piece", "start", "length", "ids_crc32"]].astype({"doc_id": "Int64"}).assign(sequence_id=sequence, offset=offset)

    return pieces.join(before, ["task", "length"]).mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
