"""Operator 10: token counts of a SentencePiece model, once per distinct pre-token.

No piece of the model holds its space mark after another character, so merges never cross the start of a run of spaces: a
pre-token is such a run with the text up to the next. Pre-tokens of the whole corpus are counted, the library gives each
distinct one's number of pieces, and per document these numbers are summed. The most frequent pre-tokens (a bounded number)
are looked up in a broadcast map, all others are joined, so no join key is hot. Ids are never kept.

Defined cases: a null or empty text has no tokens and no bytes; a repeated doc_id is a document a row; a null doc_id is
kept; an empty table gives no rows; other columns are ignored. A line feed or tab is part of a pre-token.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Pre-tokens whose count is broadcast, about 150 bytes each in a worker.
KNOWN = 1 << 18
#: Distinct pre-tokens, and characters of texts, that a task counts before it hands them on.
COUNTED, HELD = 400_000, 64_000_000
_RUNS = re.compile(" +[^ ]*")
_models: dict = {}


def model(path: str):
    if path not in _models:
        import sentencepiece

        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]


def pre_tokens(text: str) -> list[str]:
    """The text cut before each run of spaces, each part without one leading space (the model's dummy prefix). To the model
    a literal space mark is a space."""
    text = text.replace("▁", " ")
    if "  " not in text and text[:1] != " " and text[-1:] != " ":
        return text.split(" ") if text else []
    return [x[1:] for x in _RUNS.findall(" " + text)]


def _distinct(frames):
    seen: Counter = Counter()
    size = 0

    def flush():
        return pd.DataFrame({"pre": pd.Series(list(seen.keys()), dtype=object), "n": pd.Series(list(seen.values()), dtype="int64")})

    for f in frames:
        for text in f["text"]:
            seen.update(pre_tokens(text))
            size += len(text)
            if len(seen) > COUNTED or size > HELD:
                yield flush()
                seen, size = Counter(), 0
    yield flush()


def _pieces(path: str) -> Callable:
    def run(frames):
        for f in frames:
            alone = len(model(path).encode("a ")) - len(model(path).encode("a"))  # a space at the end of a text
            yield pd.DataFrame({"pre": pd.Series(f["pre"].tolist(), dtype=object), "n": f["n"].to_numpy(), "pieces": [len(x) if p else alone for p, x in zip(f["pre"], model(path).encode(f["pre"].tolist(), num_threads=1), strict=True)]})

    return run


def _sum(known_b) -> Callable:
    def run(frames):
        known, key = known_b.value, TaskContext.get().partitionId() << 33
        for part in C.text_slices(frames, "text"):
            rows = []
            for k, (doc_id, text) in enumerate(zip(part["doc_id"].astype(object), part["text"], strict=True)):
                own = pre_tokens(text)
                got = list(map(known.get, own))
                rest = Counter([p for p, n in zip(own, got, strict=True) if n is None]) if None in got else {}
                rows.append((key + k, None if pd.isna(doc_id) else doc_id, len(text.encode()), sum(filter(None, got)), [{"pre": p, "times": n} for p, n in rest.items()]))
            yield pd.DataFrame(rows, columns=["key", "doc_id", "n_bytes", "n", "rest"]).astype({"doc_id": "Int64"})
            key += len(part)

    return run


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    distinct = docs.select("text").mapInPandas(_distinct, "pre string, n long").groupBy("pre").agg(F.sum("n").alias("n"))
    counts = C.materialize(distinct.mapInPandas(_pieces(model_path), "pre string, n long, pieces int"), "pre-tokens")
    top = counts.filter(F.col("n") >= C.frequency_floor(counts, "n", KNOWN)).select("pre", "pieces").toArrow().to_pandas()
    known = docs.sparkSession.sparkContext.broadcast(dict(zip(top["pre"], top["pieces"].tolist(), strict=True)))
    summed = docs.mapInPandas(_sum(known), "key long, doc_id long, n_bytes long, n long, rest array<struct<pre: string, times: long>>")
    own = F.struct(F.concat(F.lit("  "), F.col("key").cast("string"), F.lit(" ")).alias("pre"), F.lit(0).cast("long").alias("times"))  # no pre-token has a space after another character
    each = summed.select("key", "doc_id", "n_bytes", "n", F.explode(F.concat(F.array(own), F.col("rest"))).alias("e"))
    mine = [F.when(F.col("e.times") == 0, F.col(c)).alias(c) for c in ("doc_id", "n_bytes", "n")]
    joined = each.select("key", F.col("e.pre").alias("pre"), F.col("e.times").alias("times"), *mine).join(counts.select("pre", "pieces"), "pre", "left")
    sums = joined.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(F.coalesce("n", F.col("times") * F.col("pieces"))).alias("n_tokens"))
    return sums.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
