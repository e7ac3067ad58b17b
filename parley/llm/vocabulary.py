"""The bytes of each id of a vocabulary."""

from __future__ import annotations

from functools import cache

#: The space mark of pieces, and the bytes that byte-level vocabularies write as the character of that number.
SPACE_MARK = "▁"
VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


@cache
def byte_level(path: str) -> list[bytes]:
    """By id: the other bytes are written, in order, as the characters from 256 on. Special tokens stand for themselves."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    hidden = [b for b in range(256) if b not in set(VISIBLE)]
    of = {chr(b): b for b in VISIBLE} | {chr(256 + k): b for k, b in enumerate(hidden)}
    names = {i: n for n, i in library.get_vocab().items()}
    out = []
    for i in range(max(names, default=-1) + 1):
        name = names.get(i, "")
        out.append(bytes(map(of.__getitem__, name)) if all(c in of for c in name) else name.encode())
    return out


@cache
def pieces(path: str) -> list[bytes]:
    """By id: a piece in UTF-8 with its space marks as spaces; a byte piece is that byte."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [library.id_to_piece(i) for i in range(library.vocab_size())]
    return [bytes([int(n[3:5], 16)]) if library.is_byte(i) else n.replace(SPACE_MARK, " ").encode() for i, n in enumerate(names)]
