"""Operator 2: language-model scores from a log-frequency Bloom filter.

Words are lower-cased runs `[^\\x20\\x09-\\x0D]+`; each text ends with an end token. Words and word pairs of the training
rows are counted. A count c becomes the level 1 + floor(2 log2 c), and the filter holds the n-gram once for each level up
to its own, so that probing level after level until a miss gives the quantised count back. Every counted n-gram is in it,
those seen once too: the filter is split by hash range into parts, as many as the texts ask for, each with the bits that its
n-grams need. Tasks send the distinct n-grams of a chunk of texts, with their counts, to the parts that own them; a
part adds the counts up, fills its filter, and sends the levels back to the chunks.

P(w | h) = PAIR * max(low(h w) - DISCOUNT, 0) / high(h) + (1 - PAIR) * P(w), P(w) = (low(w) + 1) / (N + V + 1), where low is the
smallest and high the largest count of a level: sums over w stay at or below 1 but for false positives. The discount tells a
pair seen once from one that is repeated, whatever its context. Both constants were chosen on held-out rows: at sf0.1 the
mean log10 probability of a held-out token is -4.21 by words alone and -3.85 with pairs.

The base columns use exact counts, which go the same way.

Defined cases: a null or empty text is the end token alone; a repeated doc_id is a document a row; a null doc_id counts as
the empty string where rows are dealt, thus as training; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Bits of a filter where no size is given, probes a level, and the share of bits that insertions set at most.
BITS, PROBES, FILL = 1 << 28, 4, 0.5
#: Characters whose n-grams a task counts at once, and characters of all texts for each part of the filter.
CHUNK, PART = 4_000_000, 4_000_000
#: Weight of the pair estimate against the word's own, and what is taken off each pair's count.
PAIR, DISCOUNT = 0.2, 0.75
END, START = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)


def held_out(doc_id: Column, mod: int, part: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod == part


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each with its end token, and where the texts begin."""
    words, at = C.word_hashes(texts)
    return np.insert(words, at[1:], END), at + np.arange(len(at))


def pairs(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, hash of the pair) for each token."""
    before = np.concatenate([[START], ids[:-1]]).astype(np.uint64)
    before[at[:-1]] = START
    return before, C.mix(before * np.uint64(0xD6E8FEB86659FD93) + ids)


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(2 * np.log2(counts) + 1e-9).astype(np.int64)


def low(level: np.ndarray) -> np.ndarray:
    return np.where(level > 0, np.ceil(2 ** ((level - 1) / 2) - 1e-9), 0)


def high(level: np.ndarray) -> np.ndarray:
    return np.where(level > 0, np.ceil(2 ** (level / 2) - 1e-9) - 1, 0)


def places(h: np.ndarray, level: np.ndarray | int, probe: int, size: int = BITS) -> np.ndarray:
    a = C.mix(h + np.uint64(0x9E3779B97F4A7C15) * np.asarray(level, np.uint64))
    return (a + np.uint64(probe) * ((a >> np.uint64(33)) | np.uint64(1))) & np.uint64(size - 1)


def probe(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The level of each n-gram: how many memberships hold in a row."""
    out, alive, level = np.zeros(len(h), np.int64), np.arange(len(h)), 0
    while len(alive):
        level += 1
        for k in range(PROBES):
            alive = alive[C.has_bit(bits, places(h[alive], level, k, len(bits) * 64))]
        out[alive] = level
    return out


def filled(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A filter of all n-grams with their counts, of as many bits as they need."""
    level = levels(counts)
    size = 1 << max(16, int(np.ceil(np.log2(level.sum() * PROBES / FILL + 1))))
    flags = np.zeros(size, np.uint8)
    for step in range(1, int(level.max()) + 1 if len(level) else 1):
        h, level = h[level >= step], level[level >= step]
        for k in range(PROBES):
            flags[places(h, step, k, size)] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def _packed(frames):
    """Rows of about CHUNK characters: a chunk's number, and its documents as arrays. Both later scans get a chunk as one row,
    whatever their batches and splits are."""
    key, size, held = TaskContext.get().partitionId() << 33, 0, []

    def row() -> pd.DataFrame:
        f = pd.concat(held)
        ids = f["doc_id"].astype("Int64").astype(object).where(f["doc_id"].notna(), None)
        return pd.DataFrame({"chunk": [key], "doc_id": [ids.tolist()], "text": [f["text"].tolist()], "held_out": [f["held_out"].astype(bool).tolist()]})

    for part in C.text_slices(frames, "text"):
        held.append(part)
        size += int(part["text"].str.len().fillna(0).sum()) + len(part)
        if size >= CHUNK:
            yield row()
            key, size, held = key + 1, 0, []
    if held:
        yield row()


def _documents(f: pd.DataFrame):
    """(chunk, its documents) of packed rows."""
    for chunk, ids, texts, out in zip(f["chunk"].tolist(), f["doc_id"], f["text"], f["held_out"], strict=True):
        yield chunk, pd.DataFrame({"doc_id": pd.Series([None if pd.isna(i) else int(i) for i in ids], dtype="Int64"), "text": pd.Series(list(texts), dtype=object), "held_out": np.array(list(out), bool)})


def _count(parts: int) -> Callable:
    """For each chunk, order and part: the distinct n-grams in order, and how often each occurs in training rows."""

    def run(frames):
        for chunk, docs in (x for f in frames for x in _documents(f)):
            held = []
            for part in C.text_slices([docs], "text"):
                ids, at = tokens(part["text"].tolist())
                held.append((ids, pairs(ids, at)[1], np.repeat(~part["held_out"].to_numpy(bool), np.diff(at))))
            ids, both, train = (np.concatenate(x) for x in zip(*held, strict=True))
            for order, every in ((1, ids), (2, both)):
                h, back = np.unique(every, return_inverse=True)
                c = np.bincount(back, weights=train, minlength=len(h)).astype(np.uint32)
                owner, first = np.unique(((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32), return_index=True)
                cut = [*first, len(h)]
                spans = list(zip(cut[:-1], cut[1:], strict=True))
                yield pd.DataFrame({"chunk": chunk, "part": owner.astype(np.int64), "n": np.int32(order), "h": [h[a:b].tobytes() for a, b in spans], "c": [c[a:b].tobytes() for a, b in spans]})

    return run


def _levels(f: pd.DataFrame) -> pd.DataFrame:
    """The levels of a part's n-grams for each chunk, and of words the exact counts; a row without chunk has N and V."""
    summed, rows = {}, []
    for order in (1, 2):
        mine = f[f["n"] == order]
        h = np.frombuffer(b"".join(mine["h"]), np.uint64)
        values, back = np.unique(h, return_inverse=True)
        summed[order] = mine, values, back, np.bincount(back, weights=np.frombuffer(b"".join(mine["c"]), np.uint32), minlength=len(values)).astype(np.int64)
    seen = [(values[counts > 0], counts[counts > 0]) for _, values, _, counts in summed.values()]
    bits = filled(*(np.concatenate(x) for x in zip(*seen, strict=True)))
    for order, (mine, values, back, counts) in summed.items():
        level, cut = probe(bits, values).astype(np.uint8)[back], np.cumsum([0, *(len(x) // 8 for x in mine["h"])])
        exact = counts[back] if order == 1 else np.empty(0, np.int64)
        rows += [(chunk, part, order, level[a:b].tobytes(), exact[a:b].tobytes(), 0, 0) for chunk, part, a, b in zip(mine["chunk"], mine["part"], cut[:-1], cut[1:], strict=True)]
    rows.append((None, None, 0, b"", b"", int(seen[0][1].sum()), len(seen[0][0])))
    return pd.DataFrame(rows, columns=["chunk", "part", "n", "level", "c", "total", "distinct"]).astype({"chunk": "Int64", "part": "Int64", "n": np.int32})


def _score(total: int, distinct: int) -> Callable:
    def run(docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        size, done, held = total + distinct + 1, [], []
        for part in C.text_slices([own for _, own in _documents(docs)], "text"):
            held.append(tokens(part["text"].tolist()))
            done.append(part[["doc_id", "held_out"]])
        ids, both = np.concatenate([x for x, _ in held]), np.concatenate([pairs(*x)[1] for x in held])
        at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x) for _, x in held]))])
        found = found.sort_values("part")
        words, back = np.unique(ids, return_inverse=True)
        pair, pair_back = np.unique(both, return_inverse=True)
        of = {n: np.frombuffer(b"".join(found.loc[found["n"] == n, "level"]), np.uint8).astype(np.int64) for n in (1, 2)}
        exact = np.frombuffer(b"".join(found.loc[found["n"] == 1, "c"]), np.int64)
        if (len(of[1]), len(of[2]), len(exact)) != (len(words), len(pair), len(words)):
            raise RuntimeError("a chunk met the levels of other texts: the table of documents changed between two scans")
        before = np.zeros(len(ids))
        before[1:] = high(of[1])[back[:-1]]
        before[at[:-1]] = high(of[1][np.searchsorted(words, END)])  # as many texts begin as end
        p = PAIR * np.maximum(np.minimum(low(of[2])[pair_back], before) - DISCOUNT, 0) / np.maximum(before, 1) + (1 - PAIR) * ((low(of[1]) + 1) / size)[back]
        out = pd.concat(done, ignore_index=True)
        return pd.DataFrame({
            "doc_id": out["doc_id"].astype("Int64"), "held_out": out["held_out"].astype(bool), "n_tokens": np.diff(at), "n_known": np.add.reduceat((exact > 0).astype(np.int64)[back], at[:-1]),
            "base_score": np.add.reduceat(np.log10((exact + 1) / size)[back], at[:-1]), "score": np.add.reduceat(np.log10(p), at[:-1]),
        })

    return run


def bloom_scores(docs: DataFrame, mod: int = 7, part: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, mean_score (a token's) for every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = docs.withColumn("held_out", held_out(F.col("doc_id"), mod, part)).mapInPandas(_packed, "chunk long, doc_id array<long>, text array<string>, held_out array<boolean>")
    docs = C.materialize(packed, "texts", options=C.LONG_ROWS)
    characters = F.aggregate(F.transform("text", lambda t: F.coalesce(F.length(t), F.lit(0)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    parts = 1 + int(docs.agg(F.sum(characters)).first()[0] or 0) // PART
    counts = docs.mapInPandas(_count(parts), "chunk long, part long, n int, h binary, c binary")
    found = C.materialize(counts.groupBy("part").applyInPandas(_levels, "chunk long, part long, n int, level binary, c binary, total long, distinct long"), "levels")
    total, distinct = (int(x or 0) for x in found.filter("chunk is null").agg(F.sum("total"), F.sum("distinct")).first())
    found = found.filter("chunk is not null").select("chunk", "part", "n", "level", "c")
    scored = docs.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInPandas(_score(total, distinct), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", (F.col("score") / F.col("n_tokens")).alias("mean_score"))
