"""Operator 12: alignment of the tokens of two tokenizers over the same bytes, and how usual each aligned pair is.

A is a byte-level vocabulary of the tokenizers library, B a SentencePiece model; A encodes a space and the text, B the text, to
which it adds that space. Ends of tokens in bytes are summed up, an end -> index dictionary is kept for each side, and the
ends that both have cut the two id lists into groups. Tokens of a group are linked where their byte ranges overlap.

A text is aligned stretch by stretch: from a space or line feed after another character up to the next. Both tokenizers cut there
before they merge, so each stretch has its ids to itself and both have an end at its end; a distinct stretch is encoded and
aligned once per worker. Texts with other white space, runs of it or a literal space mark are aligned as a whole.

The first pass over the documents writes their counts, digests and distinct id pairs. The second counts in how many documents a
pair occurs (summed in tasks before they are dealt). The third looks up the counts of the most frequent pairs, of
bounded number, in a broadcast; the rest of each document's pairs is joined. The highest count of an A id comes from a
table no longer than the vocabulary.

Defined cases: a null or empty text, and one whose tokens don't give the same bytes back (a literal space mark), has no
tokens: zeros and an empty digest. Special strings in a text are plain text. A repeated doc_id is a document a row; a
null doc_id is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Callable
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import tokens, vocabulary

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Stretches that a worker remembers at most, the longest that it remembers, and the links of all.
REMEMBERED, LONGEST, LINKS = 600_000, 100, 6_000_000
#: Pairs whose counts are broadcast, 13 bytes each, and distinct pairs that a task counts before it hands them on.
KNOWN, COUNTED = 1 << 20, 1 << 20
_ODD = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c", "\0", "\x1c", "\x1d", "\x1e", "\x1f", vocabulary.SPACE_MARK)
_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_aligners: dict[tuple[str, str], Aligner] = {}


def links(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Index pairs of overlapping tokens of one group, from their lengths."""
    if len(a) == 1 or len(b) == 1:
        return [(i, j) for i in range(len(a)) for j in range(len(b))]
    out, i, j, end_a, end_b = [], 0, 0, a[0], b[0]
    while True:
        out.append((i, j))
        low = min(end_a, end_b)
        if end_a == low:
            i += 1
            if i == len(a):  # a group ends on both sides at once
                return out
            end_a += a[i]
        if end_b == low:
            j += 1
            end_b += b[j]


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a, self.bytes_b = vocabulary.byte_level(path_a), vocabulary.pieces(path_b)
        self.sizes_a, self.sizes_b = list(map(len, self.bytes_a)), list(map(len, self.bytes_b))
        self.names = list(map(str, range(max(len(self.bytes_a), len(self.bytes_b)))))
        self.many = tokens.encoder(path_a)  # encodes many stretches as one text
        self.mark = self.b.piece_to_id(vocabulary.SPACE_MARK)
        self.reset()

    def reset(self) -> None:
        """Forget all stretches. Of each: its digest text, the numbers of A and B tokens and groups, where its links begin; a
        link is (A id << 32) + B id."""
        self.index: dict[str, int] = {}
        self.texts: list[bytes] = []
        self.n_a, self.n_b, self.n_groups, self.at, self.pairs = array("q"), array("q"), array("q"), array("q", [0]), array("q")

    def align(self, a: list[int], b: list[int], whole: bytes) -> int:
        """The number of a new stretch; -1 if the tokens don't give its bytes. An end -> index dictionary for each side, and the
        ends that both have, in order, cut the ids into groups; links are those of each group."""
        if b"".join([self.bytes_b[i] for i in b]) != whole or b"".join([self.bytes_a[i] for i in a]) != whole:
            return -1
        at_a = {end: k for k, end in enumerate(accumulate([self.sizes_a[i] for i in a]), 1)}
        at_b = {end: k for k, end in enumerate(accumulate([self.sizes_b[i] for i in b]), 1)}
        common, names, text, found, i, j = sorted(at_a.keys() & at_b.keys()), self.names, [], [], 0, 0
        for end in common:
            i2, j2 = at_a[end], at_b[end]
            if i2 - i == j2 - j == 1:
                text.append(f"{names[a[i]]}|{names[b[j]]}")
                found.append(a[i] << 32 | b[j])
            else:
                own_a, own_b = a[i:i2], b[j:j2]
                text.append(f"{','.join([names[x] for x in own_a])}|{','.join([names[x] for x in own_b])}")
                found += [own_a[x] << 32 | own_b[y] for x, y in links([self.sizes_a[x] for x in own_a], [self.sizes_b[y] for y in own_b])]
            i, j = i2, j2
        self.pairs.extend(found)
        self.texts.append(";".join(text).encode())
        self.n_a.append(len(a))
        self.n_b.append(len(b))
        self.n_groups.append(len(common))
        self.at.append(len(self.pairs))
        return len(self.texts) - 1

    def stretches(self, text: str) -> list[str] | None:
        """Stretches without their space, those after a line feed with it; None for a text to be aligned as a whole."""
        if text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _ODD) or (not text.isascii() and _WIDE.search(text)):
            return None
        return text.replace("\n", " \n").split(" ")

    def learn(self, new: list[str]) -> None:
        words = [x for x in new if x.isalpha()]
        rest = [x for x in new if not x.isalpha()]
        plain = [] if self.many.whole or self.many.spaceless or self.many.lower else [x for x in rest if self.many.cut not in x]
        if not plain and rest:
            words, rest = [], new
        ids = dict(zip(words, self.many.in_words(words), strict=True)) | dict(zip(plain, self.many.apart([x if x[0] == "\n" else " " + x for x in plain]), strict=True))
        other = [x for x in rest if x not in ids]
        direct = dict(zip(other, self.a.encode_batch_fast([x if x[0] == "\n" else " " + x for x in other], add_special_tokens=False), strict=True))
        for x, b in zip(new, self.b.encode(new, num_threads=1), strict=True):
            if x[0] == "\n" and b[:1] == [self.mark]:  # the space that the model adds
                b = b[1:]
            self.index[x] = self.align(memoryview(ids[x]).cast("I").tolist() if x in ids else direct[x].ids, b, x.encode() if x[0] == "\n" else b" " + x.encode())

    def entries(self, texts: list[str | None]) -> list[list[int]]:
        """The stretches of each text by number; none for a text without tokens."""
        if len(self.index) > REMEMBERED or len(self.pairs) > LINKS:
            self.reset()
        cut = [self.stretches(t) if t else [] for t in texts]
        new = list({x for own in cut if own for x in own}.difference(self.index))
        self.learn(new)
        out = []
        for t, own in zip(texts, cut, strict=True):
            if own is None:
                made = [self.align(self.a.encode(" " + t, add_special_tokens=False).ids, self.b.encode(t, num_threads=1), (" " + t).encode())]
            else:
                made = list(map(self.index.__getitem__, own))
            out.append([] if -1 in made else made)
        for x in new:
            if len(x) > LONGEST:
                self.index.pop(x)
        return out


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def _sums(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n).astype(np.int64)


def _aligned(path_a: str, path_b: str) -> Callable:
    def run(frames):
        own, key = aligner(path_a, path_b), TaskContext.get().partitionId() << 33
        for part in C.text_slices(frames, "text"):
            made, n = own.entries([t if isinstance(t, str) else None for t in part["text"]]), len(part)
            sizes = np.fromiter(map(len, made), np.int64, n)
            flat, row = np.fromiter((e for m in made for e in m), np.int64, int(sizes.sum())), np.repeat(np.arange(n), sizes)
            at, pairs = np.frombuffer(own.at, np.int64).copy(), np.frombuffer(own.pairs, np.int64).copy() if own.pairs else np.empty(0, np.int64)
            count = at[1:] - at[:-1]
            out = {c: _sums(row, np.frombuffer(x, np.int64)[flat] if len(flat) else flat, n) for c, x in (("n_a", own.n_a), ("n_b", own.n_b), ("n_groups", own.n_groups))}
            out["n_links"] = _sums(row, count[flat] if len(flat) else flat, n)
            digest = [hashlib.sha256(b";".join([own.texts[e] for e in m])).hexdigest() if m else "" for m in made]
            # distinct stretches of each text with their number, then distinct pairs of these with theirs
            both, times = np.unique(row << 32 | flat, return_counts=True)
            doc, entry = both >> 32, both & 0xFFFFFFFF
            many = count[entry] if len(entry) else entry
            inside = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            names, local = np.unique(pairs[np.repeat(at[entry], many) + inside], return_inverse=True)
            held, back = np.unique(np.repeat(doc, many) << 32 | local, return_inverse=True)
            weight = _sums(back, np.repeat(times, many), len(held)).astype("<u4")
            cuts = np.searchsorted(held >> 32, np.arange(n + 1))
            linked = names[held & 0xFFFFFFFF] if len(held) else np.empty(0, np.int64)
            left, right = (linked >> 32).astype("<u4"), (linked & 0xFFFFFFFF).astype("<u4")
            spans = list(zip(cuts[:-1], cuts[1:], strict=True))
            yield pd.DataFrame({"key": key + np.arange(n), "doc_id": part["doc_id"].astype("Int64").to_numpy(), **out, "groups_sha256": digest, **{c: [x[i:j].tobytes() for i, j in spans] for c, x in (("a", left), ("b", right), ("times", weight))}})
            key += n

    return run


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """key (a number for each row), doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and the distinct linked pairs of each row of
    docs (doc_id, text): a, b, times, little-endian unsigned 32-bit integers in the order of a and b. Written."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a binary, b binary, times binary"
    return C.materialize(docs.mapInPandas(_aligned(path_a, path_b), schema), "aligned")


def _codes(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of some rows as one number each, and how many each row has."""
    a, b = (np.frombuffer(b"".join(f[c]), "<u4").astype(np.int64) for c in "ab")
    return a << 32 | b, (f["a"].str.len() // 4).to_numpy(np.int64)


def _tally(frames):
    held, size = [], 0

    def flush() -> pd.DataFrame:
        names, back = np.unique(np.concatenate([n for n, _ in held]), return_inverse=True)
        return pd.DataFrame({"pair": names, "n": _sums(back, np.concatenate([c for _, c in held]), len(names))})

    for f in frames:
        names, counts = np.unique(_codes(f)[0], return_counts=True)
        held.append((names, counts))
        size += len(names)
        if size > COUNTED:
            whole = flush()
            held, size = [(whole["pair"].to_numpy(), whole["n"].to_numpy())], len(whole)
            if size > COUNTED // 2:
                yield whole
                held, size = [], 0
    if held:
        yield flush()


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair (a << 32 | b), n (how many documents hold it linked), best (no pair of that A id has more) of aligned() rows.
    Written."""
    counts = C.materialize(rows.select("a", "b").mapInPandas(_tally, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    a = F.shiftright("pair", 32).alias("a")
    most = counts.groupBy(a).agg(F.max("n").alias("most"))  # no longer than the vocabulary of A
    return C.materialize(counts.withColumn("a", a).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counts")


def _look_up(known_b) -> Callable:
    def run(frames):
        names, counts, best = known_b.value
        for f in frames:
            codes, sizes = _codes(f)
            times, row = np.frombuffer(b"".join(f["times"]), "<u4").astype(np.int64), np.repeat(np.arange(len(f)), sizes)
            at = np.minimum(np.searchsorted(names, codes), max(len(names) - 1, 0))
            hit = names[at] == codes if len(names) else np.zeros(len(codes), bool)
            use = at[hit]
            out = f.drop(columns=["a", "b", "times"])
            out["n_best"], out["count_sum"] = _sums(row[hit], times[hit] * best[use], len(f)), _sums(row[hit], times[hit] * counts[use], len(f))
            ends = np.searchsorted(row[~hit], np.arange(len(f) + 1))
            rest = list(zip(codes[~hit].tolist(), times[~hit].tolist(), strict=True))
            out["rest"] = [[{"pair": p, "times": t} for p, t in rest[i:j]] for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    return run


def alignment(docs: DataFrame, path_a: str, path_b: str, known: int = KNOWN) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of docs (doc_id, text)."""
    rows = aligned(docs, path_a, path_b)
    counts = pair_counts(rows)
    top = counts.filter(F.col("n") >= C.frequency_floor(counts, "n", known)).toArrow().to_pandas().sort_values("pair")
    shared = docs.sparkSession.sparkContext.broadcast(tuple(top[c].to_numpy(t) for c, t in (("pair", np.int64), ("n", np.int64), ("best", bool))))
    plain = "key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    part = C.materialize(rows.mapInPandas(_look_up(shared), plain + ", rest array<struct<pair: long, times: long>>"), "looked-up")
    more = part.filter(F.size("rest") > 0).select("key", F.explode("rest").alias("e")).select("key", "e.pair", "e.times").join(counts, "pair")
    more = more.groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    add = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
    return part.join(more, "key", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", add("n_best", "more_best"), add("count_sum", "more_sum"), "groups_sha256")
