"""Operator 13: conversations as token ids with a loss mask, assembled from parts that are encoded separately.

A turn is START, its role, a line feed, its text, END, a line feed. START and END are two ids behind the vocabulary, which no
text can be encoded to; roles and texts are encoded on their own and the ids are spliced. The loss mask is 1 on the ids of
an assistant's text: +1 where such a text begins and -1 behind it, summed up along all ids of a slice.

The formatted text, which writes START and END as `<|im_start|>` and `<|im_end|>`, can be read back too: in contents a
backslash goes into each `<|` after the `<`, and one more into each `<`, backslashes, `|`, so that `<|` never stands in a content
and taking one backslash away restores it. In roles backslashes and line feeds are escaped besides.

Turns are rows of the output, in order over the whole table (turns.ordered), so that a long conversation is many rows. Reading
back decodes them turn by turn; only the digests follow a conversation through one task, holding no turn.

Defined cases: a null text or role is empty, a null turn comes first, a null conv_id is a conversation of its own; turns of
one number go by role, then by the SHA-256 of their text; repeated rows are turns of their own. An empty table gives no
rows; other columns are ignored. Text is valid UTF-8, as Spark's strings are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import tokens, vocabulary
from . import turns as T

#: The control strings; their ids follow the largest of the vocabulary in this order.
START, END = "<|im_start|>", "<|im_end|>"
_OPEN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_ROLE = re.compile(r"\\(.)")


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return _ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def assemble(roles: list[str], texts: list[str], encoder, learnt: frozenset[str]) -> tuple[list[bytes], list[bytes]]:
    """The ids (little-endian unsigned 32-bit integers) and the mask (a byte an id) of each turn."""
    start, end = (np.array([encoder.largest + k], "<u4") for k in (1, 2))
    names = [escape_role(r) for r in roles]
    of = dict(zip([*set(names), "\n"], encoder.encode([*set(names), "\n"]), strict=True))
    line = np.frombuffer(of["\n"], "<u4")
    parts, lengths = [], []
    for name, own in zip(names, encoder.encode([escape(t) for t in texts]), strict=True):
        turn = [start, np.frombuffer(of[name], "<u4"), line, np.frombuffer(own, "<u4"), end, line]
        parts += turn
        lengths.append([len(x) for x in turn])
    sizes = np.array(lengths)
    ids, ends = np.concatenate(parts), np.cumsum(sizes).reshape(sizes.shape)
    asks = np.array([r in learnt for r in roles])
    steps = np.zeros(len(ids) + 1, np.int64)
    np.add.at(steps, ends[asks, 2], 1)
    np.add.at(steps, ends[asks, 3], -1)
    mask, cuts = np.cumsum(steps[:-1]).astype(np.uint8), [0, *ends[:, -1].tolist()]
    return [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], [mask[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _format(path: str, learnt: frozenset[str]) -> Callable:
    def run(frames):
        for part in C.text_slices(frames, "text"):
            ids, mask = assemble(part["role"].tolist(), part["text"].tolist(), tokens.encoder(path), learnt)
            yield pd.DataFrame({"key": part["key"], "seq": part["seq"], "ids": ids, "loss": mask})

    return run


def formatted(rows: DataFrame, path: str, learnt: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """key, seq, ids, loss: a row a turn of rows (conv_id, turn, role, text), written; the mask covers texts of the roles
    learnt."""
    named = rows.select(T.key_of(F.col("conv_id")).alias("key"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    return C.materialize(T.ordered(named, "turns").mapInPandas(_format(path, frozenset(learnt)), "key string, seq long, ids binary, loss binary"), "chat")


def parse(ids: np.ndarray, loss: np.ndarray, table: list[bytes]) -> tuple[str, str, str, str]:
    """(formatted text, role, text, text under the mask) of a turn's ids; the last three as they were before escaping."""
    size = len(table) - 2
    if ids[0] != size or np.count_nonzero(ids >= size) != 2:
        raise ValueError("a turn's ids don't begin with START and hold END once")
    close = int(np.flatnonzero(ids == size + 1)[0])
    text = lambda own: b"".join([table[i] for i in own.tolist()]).decode()
    role, _, content = text(ids[1:close]).partition("\n")
    return text(ids), unescape_role(role), unescape(content), unescape(text(ids[loss == 1]))


def table_of(path: str) -> list[bytes]:
    """The bytes of each id, START and END behind the vocabulary."""
    return [*vocabulary.byte_level(path), START.encode(), END.encode()]


def _read(path: str) -> Callable:
    def run(frames):
        table = table_of(path)
        for f in frames:
            rows = [parse(np.frombuffer(i, "<u4"), np.frombuffer(m, np.uint8), table) for i, m in zip(f["ids"], f["loss"], strict=True)]
            own = pd.DataFrame(rows, columns=["formatted", "role", "text", "learnt"])
            yield pd.concat([f[["key", "seq"]].reset_index(drop=True), own], axis=1)

    return run


def read_back(chat: DataFrame, path: str) -> DataFrame:
    """key, seq, formatted, role, text, learnt (the text under the mask) of each turn that formatted() wrote."""
    return chat.mapInPandas(_read(path), "key string, seq long, formatted string, role string, text string, learnt string")


class _Digest:
    def __init__(self, key: str):
        self.key, self.turns, self.chars, self.length = key, 0, 0, 0
        self.sha, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, role: str, text: str, learnt: str) -> None:
        self.turns += 1
        self.sha.update(f"{role}\n{text}\n".encode())
        self.loss.update(learnt.encode())
        self.chars += len(learnt)
        self.length += len(formatted)

    def result(self) -> tuple:
        return self.key, self.turns, self.sha.hexdigest(), self.chars, self.loss.hexdigest(), self.length


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from read_back()."""
    schema = "key string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    folded = C.materialize(T.fold(turns, ["formatted", "role", "text", "learnt"], _Digest, schema), "digests")
    return folded.select(T.id_of(F.col("key")), *folded.columns[1:])
