"""Operator 9: toxicity by compression distance between two dictionaries that zstandard trained.

zstandard trains one dictionary on windows of ordinary training text and one on windows of toxic training text, of equal size
beyond a part of ordinary text that both begin with. Toxic training documents are mostly ordinary text too, so the toxic
dictionary is trained on those of their windows that hold a telling stretch: the opening of a word that RATE times as many
toxic as ordinary documents have, and a SHARE of the toxic ones. A window is a word after a stretch that both dictionaries
know; its gain is how many bytes shorter it gets with the toxic dictionary. Shares and counts of windows over several gains
go into a logistic calibration, fitted on the half of the training rows that the dictionaries did not see.

Fitting reads a bounded sample of labelled rows (SAMPLE documents a class, by hash of the id, until half of CHARS
characters are full; TRAINED bytes of windows a dictionary, evenly spread); every document is scored over its whole text.
With no toxic or no ordinary training rows every score is 0; with both, but too few to fit and to calibrate, fitting raises
an error.

Defined cases: a null or wordless text is scored like a single window without gain; a repeated doc_id is a document a row; a
null doc_id counts as the empty string where rows are dealt; null labels are ignored, and an id with several labels is toxic
if one says so; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .lm import held_out

SAMPLE, CHARS = 3_000, 30_000_000
#: What makes the opening of a word telling, and the shortest and longest opening but the whole word.
RATE, SHARE, OPENING = 12.0, 0.02, (3, 8)
#: Bytes of the common part, of the toxic dictionary beyond it at most, and of the windows that one is trained on.
COMMON, TOXIC, TRAINED = 20_000, 8_000, 4_000_000
THRESHOLD = 0.3
#: Words whose gain a worker remembers.
REMEMBERED = 200_000
_WORD = re.compile(r"\w+")
_GAINS = (1, 2, 3, 4, 5, 6)


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def openings(word: str) -> set[str]:
    return {word[:k] for k in (*range(OPENING[0], OPENING[1] + 1), len(word)) if OPENING[0] <= k <= len(word)}


class Compressors:
    def __init__(self, stretch: str, ordinary: bytes, toxic: bytes):
        self.parts = stretch, ordinary, toxic
        self.known: dict[str, int] = {}
        self.made = None

    def __reduce__(self):
        return Compressors, self.parts

    def gains(self, text: str | None) -> list[int]:
        if self.made is None:
            C.release()
            import zstandard as z

            how = z.ZstdCompressionParameters(window_log=17, hash_log=17, chain_log=17, search_log=5, min_match=3, target_length=32, strategy=z.STRATEGY_BTOPT, write_content_size=False, write_checksum=False, write_dict_id=False)
            self.made = [z.ZstdCompressor(dict_data=z.ZstdCompressionDict(x, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=how) for x in self.parts[1:]]
        if len(self.known) > REMEMBERED:
            self.known = {}
        own = words(text)
        ordinary, toxic = self.made
        for w in set(own).difference(self.known):
            window = f"{self.parts[0]} {w} ".encode()
            self.known[w] = len(ordinary.compress(window)) - len(toxic.compress(window))
        return [self.known[w] for w in own]

    def features(self, text: str | None) -> list[float]:
        g = np.array(self.gains(text) or [0], float)
        over = [(g >= k).sum() for k in _GAINS]
        return [*(x / len(g) for x in over[:5]), *np.log1p(over), g.max(), np.maximum(g, 0).mean(), np.log(len(g))]


def _trained(size: int, windows: list[bytes]) -> bytes:
    """A dictionary of zstandard; of windows too few to train one, the windows themselves."""
    import zstandard as z

    try:
        return z.train_dictionary(size, windows, k=16, d=6, steps=1).as_bytes()
    except z.ZstdError:
        return b"".join(dict.fromkeys(windows))[-size:]


def _evenly(windows: Callable[[], Iterator[bytes]]) -> list[bytes]:
    """Every k-th window, so that TRAINED bytes are not exceeded by much."""
    step = 1 + sum(map(len, windows())) // TRAINED
    return list(islice(windows(), 0, None, step))


def dictionaries(rows: list[tuple[str, int]]) -> Compressors:
    """Texts are cut into words again for each purpose: the driver holds no words of all of them."""
    texts = {label: [t for t, own in rows if own == label] for label in (0, 1)}
    held = Counter()
    for text in texts[1]:
        held.update(set().union(*map(openings, set(words(text)))))
    many = {u: n for u, n in held.items() if n >= max(4, SHARE * len(texts[1]))}
    ordinary = Counter()
    for text in texts[0]:
        ordinary.update(set().union(*map(openings, set(words(text)))).intersection(many))
    telling = {u for u, n in many.items() if n / len(texts[1]) >= RATE * (ordinary[u] + 1) / len(texts[0])}
    toxic = _trained(TOXIC, _evenly(lambda: (f" {w} ".encode() for text in texts[1] for w in words(text) if openings(w) & telling)))

    def fours():
        for text in texts[0]:
            own = words(text)
            yield from (f" {' '.join(own[k : k + 4])} ".encode() for k in range(0, len(own), 4))

    both = _trained(COMMON + len(toxic) + 4_000, _evenly(fours))
    base, rest = both[-COMMON:], both[:-COMMON][-len(toxic) :] if toxic else b""
    return Compressors(base[-500:-400].decode("utf-8", "ignore"), base + rest, base + toxic)


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    w = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + 0.5 * np.eye(len(w)), z.T @ (y - p) - 0.5 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def fit(docs: DataFrame, labels: DataFrame, mod: int = 4, part: int = 2):
    """Compressors and calibration from labelled rows outside the held-out part; None without both classes."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = texts.select("doc_id").distinct().join(labels.filter(~held_out(F.col("doc_id"), mod, part)), "doc_id").withColumn("order", F.xxhash64("doc_id"))
    taken = []
    for toxic in (1, 0):
        left = CHARS // 2
        ids = known.filter(F.col("toxic") == toxic).orderBy("order", "doc_id").limit(SAMPLE).select("doc_id", "order")
        some = texts.join(F.broadcast(ids), "doc_id").orderBy("order", "doc_id", "text").limit(2 * SAMPLE)  # SAMPLE ids of 16 bytes; an id may be repeated
        for r in some.toLocalIterator():
            if left <= 0:
                break
            left -= len(r["text"] or "")
            taken.append((r["text"] or "", toxic))
    taken = list(dict.fromkeys(taken))
    halves = [[r for r in taken if zlib.crc32(r[0].encode()) % 2 == k] for k in (0, 1)]
    if {t for _, t in taken} != {0, 1}:
        return None
    if any({t for _, t in half} != {0, 1} for half in halves):
        raise ValueError(f"too few labelled texts to fit toxicity: {[[sum(t == k for _, t in half) for k in (1, 0)] for half in halves]} toxic and ordinary ones in the halves")
    made, y = dictionaries(halves[0]), np.array([t for _, t in halves[1]], float)
    mean, scale, w = calibrate(np.array([made.features(t) for t, _ in halves[1]]), y)
    del taken, halves
    C.give_back()  # the sample's texts
    share = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    w[0] += np.log(share[1] / share[0]) - np.log(y.sum() / (len(y) - y.sum()))  # the sample takes both classes alike
    return made, (mean, scale, w)


def scores(docs: DataFrame, labels: DataFrame, mod: int = 4, part: int = 2) -> DataFrame:
    """The rows of docs with held_out, score and predicted."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, mod, part))

    def run(frames):
        for f in frames:
            if model.value is None:
                yield f.assign(score=0.0, predicted=np.int32(0))
                continue
            made, (mean, scale, w) = model.value
            x = np.array([made.features(t) for t in f["text"]], float).reshape(len(f), len(mean))
            score = 1 / (1 + np.exp(-np.clip(np.c_[np.ones(len(x)), (x - mean) / scale] @ w, -30, 30)))
            yield f.drop(columns="text").assign(score=score, predicted=(score >= THRESHOLD).astype(np.int32))

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = own.mapInPandas(lambda it: (x[["doc_id", "score", "predicted"]].astype({"doc_id": "Int64"}) for x in run(it)), "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out(F.col("doc_id"), mod, part).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that are not predicted toxic."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        if model.value is None:
            return pd.Series(True, index=texts.index)
        made, (mean, scale, w) = model.value
        x = np.array([made.features(t) for t in texts], float).reshape(len(texts), len(mean))
        return pd.Series(1 / (1 + np.exp(-np.clip(np.c_[np.ones(len(x)), (x - mean) / scale] @ w, -30, 30))) < THRESHOLD, index=texts.index)

    return docs.filter(clean(F.col("text").cast("string")))
