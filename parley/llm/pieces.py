"""Operator 4: SentencePiece encoding and decoding with an Aho-Corasick automaton over the pieces.

One pass over a text follows the automaton's output links to all pieces that end at a position. A unigram model relaxes the
best score of each position over them (Viterbi). In a BPE model the best segmentation by score is not what the merges
give, so there only those pieces are relaxed that may follow the best piece of the position before: two pieces are compatible
where merging their joint text yields just these two, and exactly one piece per position is, which leaves nothing for
scores to decide. The ids are those of the library for both kinds.

A pass covers a pre-token (a run of spaces with the text up to the next), as no piece holds its space mark after another
character; distinct pre-tokens are encoded once per worker. Characters without a piece fall back to bytes, or to the
unknown id.

Defined cases: a null or empty text has no ids; a repeated doc_id is a document a row; a null doc_id is kept; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .counts import pre_tokens

#: Pre-tokens and pairs of pieces that a worker remembers at most, and the longest pre-token that it remembers.
REMEMBERED, LONGEST = 500_000, 100
_MARK = "▁"
_coders: dict[str, Coder] = {}


class Coder:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces or not model.normalizer_spec.add_dummy_prefix:
            raise ValueError("only models with the identity normalizer and a dummy prefix are supported")
        self.bpe = model.trainer_spec.model_type == 2
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [library.id_to_piece(i) for i in range(library.vocab_size())]
        self.unknown = library.unk_id()
        self.byte = {int(n[1:-1], 16): i for i, n in enumerate(self.names) if library.is_byte(i)}
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.silent = {i for i in range(len(self.names)) if library.is_control(i)}
        skip = self.silent | set(self.of_byte) | {self.unknown}
        self.ids = {n: i for i, n in enumerate(self.names) if i not in skip and not library.is_unused(i)}
        if any(_MARK in n.lstrip(_MARK) for n in self.ids):
            raise ValueError("a piece holds the space mark after another character")
        self.score = [library.get_score(i) for i in range(len(self.names))]
        self.automaton = ahocorasick.Automaton()
        for n, i in self.ids.items():
            if not self.bpe or self.merged(n) == [n]:
                self.automaton.add_word(n, (len(n), i))
        self.automaton.make_automaton()
        self.known: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def merged(self, text: str) -> list[str]:
        """The merges of a short text, best score first."""
        own = list(text)
        while True:
            best, at = None, -1
            for k in range(len(own) - 1):
                i = self.ids.get(own[k] + own[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if best is None:
                return own
            own[at : at + 2] = [own[at] + own[at + 1]]

    def follows(self, a: int, b: int) -> bool:
        if (a, b) not in self.pairs:
            if len(self.pairs) > REMEMBERED:
                self.pairs = {}
            self.pairs[a, b] = self.merged(self.names[a] + self.names[b]) == [self.names[a], self.names[b]]
        return self.pairs[a, b]

    def segment(self, text: str) -> bytes:
        """Ids of a marked pre-token as unsigned 32-bit integers."""
        n = len(text)
        last = [-1] * (n + 1)  # the piece that ends before a position; -1: none, or a character without a piece
        if self.bpe:
            for end, (size, i) in self.automaton.iter(text):
                start = end + 1 - size
                if last[end + 1] < 0 and (start == 0 or last[start] < 0 or self.follows(last[start], i)):
                    last[end + 1] = i
        else:
            low = min(self.score) - 10
            best, done = [0.0] + [float("-inf")] * n, 0
            for end, (size, i) in [*self.automaton.iter(text), (n, (0, -1))]:
                for k in range(done + 1, min(end, n) + 1):  # positions that no further piece can end at
                    best[k], last[k] = max((best[k], last[k]), (best[k - 1] + low, -1), key=lambda x: x[0])
                done = max(done, min(end, n))
                if size and best[end + 1 - size] + self.score[i] > best[end + 1]:
                    best[end + 1], last[end + 1] = best[end + 1 - size] + self.score[i], i
        out, at = [], n
        while at:
            if last[at] >= 0:
                out.append(last[at])
                at -= len(self.names[last[at]])
            else:
                at -= 1
                out += [self.byte[b] for b in reversed(text[at].encode("utf-8"))] if self.byte else [self.unknown]
        return array("I", reversed(out)).tobytes()

    def encode(self, text: str | None) -> bytes:
        if len(self.known) > REMEMBERED:
            self.known = {}
        out = []
        for pre in pre_tokens(text or ""):
            ids = self.known.get(pre)
            if ids is None:
                ids = self.segment(_MARK + pre.replace(" ", _MARK))
                if len(pre) <= LONGEST:
                    self.known[pre] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        out, held = [], bytearray()
        for i in array("I", ids):
            if i in self.of_byte:
                held.append(self.of_byte[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held = bytearray()
            if i not in self.silent:
                out.append(self.names[i])
        out.append(held.decode("utf-8", "replace"))
        return "".join(out).replace(_MARK, " ").removeprefix(" ")


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def encoded(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text and ids (unsigned little-endian 32-bit integers) for every row of docs (doc_id, text)."""

    def run(frames):
        for part in C.text_slices(frames, "text"):
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").array, "text": part["text"].tolist(), "ids": [coder(model_path).encode(t) for t in part["text"]]})

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInPandas(run, "doc_id long, text string, ids binary")


def round_trips(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, and whether decoding gives the text again (but that it can't tell its space mark from a space)."""

    def run(frames):
        for part in C.text_slices(frames, "text"):
            ids = [coder(model_path).encode(t) for t in part["text"]]
            same = [coder(model_path).decode(x) == (t or "").replace(_MARK, " ") for x, t in zip(ids, part["text"], strict=True)]
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").array, "n_tokens": [len(x) // 4 for x in ids], "ids_crc32": [zlib.crc32(x) for x in ids], "round_trip": same})

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInPandas(run, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")
