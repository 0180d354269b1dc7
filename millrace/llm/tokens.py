"""Byte-level BPE of whole texts, word by word: every distinct pre-token goes through the library's model once per worker."""

from __future__ import annotations

import os
import sys
import unicodedata
from struct import pack

import numpy as np

_LETTER, _NUMBER, _OTHER, _BLANK, _UNKNOWN = range(5)
#: What the pattern's \s takes (Unicode White_Space).
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SHORT = np.array([ord(x) for x in "stmd"], np.uint32)


def _classes() -> np.ndarray:
    kind = {"L": _LETTER, "N": _NUMBER}
    out = np.fromiter((kind.get(c[0], _UNKNOWN if c == "Cn" else _OTHER) for c in map(unicodedata.category, map(chr, range(sys.maxunicode + 1)))), np.uint8, sys.maxunicode + 1)
    out[_WHITE] = _BLANK
    return out


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in the vocabulary: itself where it prints, else the next free letter from U+0100."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return {b: chr(b if b in prints else next(free)) for b in range(256)}


class Words:
    """Splits texts into pre-tokens as the tokenizer does, and has the ids of each.

    The split works on arrays of code points. Texts with code points that are unassigned here, or that contain
    a special string, go through the library as a whole; `whole` then has their ids.
    """

    loaded: dict[str, "Words"] = {}

    def __init__(self, path: str, most: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.model._resize_cache(0)  # words are cached here
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.letters = str.maketrans(_byte_letters())
        self.space = self.letters[32]
        self.kind = _classes()
        self.known: dict[str, bytes] = {}
        self.most = most

    @classmethod
    def load(cls, path: str) -> "Words":
        """One per worker process and vocabulary."""
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def split(self, text: str) -> list[str] | None:
        """The pre-tokens; None if the library must take the whole text."""
        if not text:
            return []
        if any(s in text for s in self.specials):
            return None
        try:
            c = np.frombuffer(text.encode("latin-1"), np.uint8)
            k = self.kind[:256].take(c)
        except UnicodeEncodeError:
            c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            k = self.kind.take(c)
            if (k == _UNKNOWN).any():
                return None
        n = len(c)
        change = np.empty(n, bool)
        change[0] = True
        np.not_equal(k[1:], k[:-1], out=change[1:])
        blank = k == _BLANK
        # the last blank of a run that something follows stands apart; a plain space goes to what follows
        last = np.flatnonzero(blank[:-1] & change[1:])
        change[last] = True
        glued = last[c[last] == 32]
        change[glued + 1] = False
        quote = np.flatnonzero(c[:-1] == 39)
        if len(quote):
            quote = quote[change[quote]]  # a token begins at the quote
            nxt = c[quote + 1]
            third = np.where(quote + 2 < n, c[np.minimum(quote + 2, n - 1)], 0)
            two = ((nxt == ord("r")) | (nxt == ord("v"))) & (third == ord("e")) | (nxt == ord("l")) & (third == ord("l"))
            one = np.isin(nxt, _SHORT)
            for hit, size in ((one, 2), (two, 3)):
                at = quote[hit]
                change[at + 1] = False
                end = at + size
                change[end[end < n]] = True
        starts = np.flatnonzero(change).tolist()
        starts.append(n)
        return [text[a:b] for a, b in zip(starts, starts[1:])]

    def mapped(self, word: str) -> str:
        if word.isascii() and word.isprintable():  # these bytes stand for themselves, but for the space
            return word.replace(" ", self.space)
        return word.encode("utf-8", "replace").decode("latin-1").translate(self.letters)

    def ids_of_word(self, word: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(self.mapped(word))]
        return pack(f"<{len(ids)}{self.code}", *ids)

    def pieces(self, word: str) -> int:
        return len(self.model.tokenize(self.mapped(word)))

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> bytes:
        """All ids of the text, packed in little-endian order."""
        found = self.split(text)
        if found is None:
            return np.array(self.whole(text), self.dtype).tobytes()
        known = self.known
        try:
            return b"".join(map(known.__getitem__, found))
        except KeyError:
            if len(known) > self.most:
                known.clear()
            for w in found:
                if w not in known:
                    known[w] = self.ids_of_word(w)
            return b"".join(map(known.__getitem__, found))
