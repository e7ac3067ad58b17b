"""Operator 7: quality rules on repetition, measured with rolling hashes in numpy.

For each n-gram length of COVER, the characters of words inside n-grams that occur earlier in the text are a share of all
word characters; so are the characters of lines equal to an earlier line. A document fails above the share of its length
or DUP_LINES, and where the base rules fail: fewer than 10 words, or more than a fifth of the words in 5-word windows that
occur twice or more.

Defined cases: a null, empty or wordless text has no words and fails; a repeated doc_id is a document a row; a null doc_id
is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Largest share of characters inside repeated n-grams, by n, and inside repeated lines.
COVER = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
DUP_LINES = 0.20
_SYMBOLS = b"#*$%&|<>"
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _covered(starts: np.ndarray, width: int, total: int) -> np.ndarray:
    """Which of `total` words lie in a window of `width` words that begins at one of the starts."""
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: str | None) -> tuple[int, int, int, int, int, bool, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n_symbols = sum(raw.count(bytes([c])) for c in _SYMBOLS)
    data = np.frombuffer(b" " + raw + b" ", np.uint8)
    inside = ~_SPACE[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    n = len(starts)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    sizes = chars[ends] - chars[starts]
    word_chars = int(sizes.sum())
    lines: dict[bytes, None] = {}
    dup_lines = dup_chars = 0
    for line in raw.split(b"\n"):
        if line.translate(None, b" \t\n\x0b\x0c\r"):
            if line in lines:
                dup_lines += 1
                dup_chars += sum(len(w.decode("utf-8", "surrogatepass")) for w in line.translate(bytes.maketrans(b"\t\x0b\x0c\r", b"    ")).split(b" "))
            lines[line] = None
    ids = np.unique(np.array([hash(raw[a - 1 : b - 1]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64), return_inverse=True)[1].astype(np.uint64) if n else np.empty(0, np.uint64)
    repeat_words, fine = 0, dup_chars <= DUP_LINES * word_chars
    for width, most in COVER.items():
        if n < width:
            break
        grams = C.ngram_hashes(ids + np.uint64(1), width)
        _, first, back, counts = np.unique(grams, return_index=True, return_inverse=True, return_counts=True)
        if width == 5:
            repeat_words = int(_covered(np.flatnonzero(counts[back] > 1), width, n).sum())
        later = np.flatnonzero(first[back] != np.arange(len(grams)))
        fine &= not len(later) or int(sizes[_covered(later, width, n)].sum()) <= most * word_chars
    failed = n < 10 or 100 * repeat_words > 20 * n
    return n, word_chars, n_symbols, dup_lines, repeat_words, bool(failed), bool(fine and not failed)


_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def measures(text: Column) -> Column:
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t) for t in texts], columns=_COLUMNS)

    return F.pandas_udf(run, _SCHEMA)(text.cast("string"))


def repetition_rules(docs: DataFrame) -> DataFrame:
    """doc_id and all measures for every row of docs (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), measures(F.col("text")).alias("m")).select("doc_id", "m.*")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that the rules keep."""
    return docs.filter(measures(F.col("text"))["kept"])
