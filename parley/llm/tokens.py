"""Token ids of whole texts by the tokenizers library, with each distinct stretch of text encoded once per worker.

A stretch is a run of white space with the characters up to the next. Both kinds of tokenizers cut a text before its merges
wherever a stretch begins: one keeps a space with the word after it, the other drops white space. So a text's ids are those
of its stretches in a row. New stretches go to the library many at once, with a special token between them where the ids
are cut apart; the marks `.,!?;:` after a letter are cut off first, as merges never cross that place. A text with
characters that Python and the library class differently goes to the library as it is, and so does every text if a
tokenizer's ids of the probes below are not those of its stretches.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

from . import common as C

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Stretches that a worker remembers at most, about 200 bytes each, and the longest that it remembers.
REMEMBERED, LONGEST = 700_000, 100
_MARKS = ".,!?;:"
_RUNS = re.compile(r"\s*\S+|\s+$")
_ODD = "\0\x1c\x1d\x1e\x1f"
#: White space of text beside single spaces and line ends.
_OTHER = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c", *(chr(c) for c in range(0x80, 0x3001) if chr(c).isspace()))
_PROBES = ("", " ", "a", " a b", "a  b", "a\nb", "a\n\n b\t c \n", "it's. I'll, x'. Foo.'s", "A1b2 33, (x) #! é.", "ÀÉ ß. œ, ﬁ! İ. é.", "日本語。 テスト. 한국어", " a b　", "́a ́.", "<|endoftext|> a<|endoftext|>.", "A <|ENDOFTEXT|>", "👍🏽. 👍!")
_encoders: dict[str, PieceEncoder] = {}
C.CACHES.append(_encoders)


class PieceEncoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.largest = max(self.library.get_vocab().values(), default=0)
        made = json.loads(self.library.to_str())
        special = [t for t in made["added_tokens"] if t["special"] and not (t["lstrip"] or t["rstrip"] or t["normalized"])]
        self.cut, self.cut_id = (special[-1]["content"], special[-1]["id"]) if special else ("", -1)
        self.lower = '"Lowercase"' in json.dumps(made["normalizer"])
        self.spaceless = not self.direct([" \n "])[0]
        names = [self.library.id_to_token(i) or "" for i in range(self.largest + 1)]
        self.ends, self.starts = (np.array([f(n) for n in names], bool) for f in (lambda n: n.endswith("</w>"), lambda n: n.startswith("\u0120")))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.whole = not special
        self.whole = self.whole or [*self.encode(list(_PROBES)), *self.encode([" ".join(_PROBES)])] != self.direct([*_PROBES, " ".join(_PROBES)])

    def direct(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def apart(self, stretches: list[str], block: int = 5_000) -> list[bytes]:
        """The ids of each stretch, by encoding many of them as one text."""
        out: list[bytes] = []
        for k in range(0, len(stretches), block):
            own = stretches[k : k + block]
            ids = np.array(self.library.encode_batch_fast([self.cut.join(own)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == self.cut_id)
            if len(cuts) != len(own) - 1:  # a stretch holds the special token itself
                out += self.direct(own)
                continue
            data, ends = ids.tobytes(), (4 * cuts).tolist()
            out += [data[a:b] for a, b in zip([0, *(e + 4 for e in ends)], [*ends, len(data)], strict=True)]
        return out

    def in_words(self, words: list[str], block: int = 5_000) -> list[bytes]:
        """The ids of words of letters after a space, which come apart again at the tokens that begin or end a word."""
        out: list[bytes] = []
        for k in range(0, len(words), block):
            own = words[k : k + block]
            ids = np.array(self.library.encode_batch_fast([" " + " ".join(own)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1 if self.spaceless else np.append(np.flatnonzero(self.starts[ids])[1:], len(ids))
            if len(cuts) != len(own):
                out += self.apart(list(map(self.literal, own)))
                continue
            data, at = ids.tobytes(), [0, *(4 * cuts).tolist()]
            out += [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        return out

    def literal(self, key: str) -> str:
        return key[1:] if key[:1] == "\0" else key if self.spaceless or key[:1].isspace() else " " + key

    def recall(self, keys: set[str]) -> None:
        older = self.older
        if older:
            self.known.update((key, older[key]) for key in keys if key in older)

    def learn(self, keys: set[str]) -> None:
        """A key is a stretch without its single space; the first of a text begins with a null character instead."""
        known = self.known
        self.recall(keys)
        keys = keys.difference(known)
        cores = {key: key.rstrip(_MARKS) for key in keys if key[-1] in _MARKS}
        cores = {key: core for key, core in cores.items() if core[-1:].isalpha() and core[-1] <= "\xff"}
        marks = list({key[len(core) :] for key, core in cores.items()})
        self.recall(set(cores.values()))
        plain = keys.difference(cores).union(cores.values()).difference(known)
        words = [x for x in plain if x.isalpha()]
        known.update(zip(words, self.in_words(words), strict=True))
        rest = list(plain.difference(words))
        known.update(zip(rest, self.apart(list(map(self.literal, rest))), strict=True))
        ids = dict(zip(marks, self.direct(marks), strict=True))
        known.update({key: known[core] + ids[key[len(core) :]] for key, core in cores.items()})

    def folded(self, text: str) -> str:
        """Lower case where that is certain to be what the library's normalizer does first."""
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text
        return text if "<|" in text else text.lower()

    def stretches(self, text: str) -> list[str]:
        if self.spaceless:
            return (self.folded(text) if self.lower else text).split()
        if text[:1].isspace() or text[-1:].isspace() or any(x in text for x in _OTHER[: 8 if text.isascii() else None]):
            out = [x[1:] if x[0] == " " and x[1:2] and not x[1].isspace() else x for x in _RUNS.findall(text)]
            if out and not text[0].isspace():
                out[0] = "\0" + out[0]
            return out
        return ("\0" + text.replace("\n", " \n")).split(" ") if text else []

    def encode(self, texts: list[str]) -> list[bytes]:
        texts = [t or "" for t in texts]
        if self.whole:
            return self.direct(texts)
        if len(self.known) > REMEMBERED // 2:  # what is met again moves on from the older half, the rest goes
            self.known, self.older = {}, self.known
        known, new, rows, out = self.known, set(), [], []
        get = known.get
        for t in texts:
            x = [] if any(c in t for c in _ODD) else self.stretches(t)
            ids = list(map(get, x))
            gaps = [k for k, i in enumerate(ids) if i is None] if None in ids else []
            keys = [x[k] for k in gaps]
            new.update(keys)
            rows.append((ids, gaps, keys))
        if new:
            self.learn(new)
        for t, (ids, gaps, keys) in zip(texts, rows, strict=True):
            for k, key in zip(gaps, keys, strict=True):
                ids[k] = known[key]
            out.append(b"".join(ids) if ids or not t else self.direct([t])[0])
        for key in new:
            if len(key) > LONGEST:
                known.pop(key, None)
        return out


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        C.give_back()  # what other operators' tasks have freed in this worker
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
