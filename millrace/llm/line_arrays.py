"""Lines in numpy and plain Python, one machine's work: what tests hold the DataFrame form in `lines` against."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from itertools import combinations

import numpy as np

from .common import BASE, INVERSE, U64, mix64, powers

BLOCKS, PERMUTATIONS, ROWS = 4, 24, 6
SIMILARITY = 0.8

_ODD = mix64(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * U64(0xC2B2AE3D27D4EB4F)) | U64(1)
_CHARS: list[np.ndarray] = []


def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter or digit, and its hash (1 to 9 are as 0)."""
    if not _CHARS:
        n = 0x110000
        _CHARS.append(np.fromiter((unicodedata.category(chr(c))[0] in "LN" for c in range(n)), bool, n))
        codes = np.arange(1, n + 1, dtype=np.uint64)
        codes[49:58] = codes[48]
        _CHARS.append(mix64(codes * U64(0xD1342543DE82EF95)))
    return _CHARS[0], _CHARS[1]


def normalised(line: str) -> str:
    """Lower case, digits 1 to 9 as 0, every run of characters that are no letter or digit as one space."""
    keep, _ = _characters()
    c = np.frombuffer(line.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where((c > 48) & (c < 58), 48, np.where(keep[c], c, 32)).astype(np.uint32)
    return " ".join(filter(None, c.tobytes().decode("utf-32-le", "surrogatepass").split(" ")))


class Lines:
    """The lines with a letter or digit of texts that follow each other: arrays with a row a line.

    text, pos: which text, and which of its lines; k1, k2: equal normalised lines have equal ones; chars: length of
    the normalised line; first, count: its words, whose hashes are in `words`.
    """

    def __init__(self, texts: list[str]):
        keep, codes = _characters()
        # each text ends with a newline, so that no line spans two
        c = np.frombuffer("".join(f"{t}\n" for t in texts).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = keep[c]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        start, stop = edge[::2], edge[1::2]
        sums = np.zeros(len(c) + 1, np.uint64)
        np.cumsum(codes[c] * powers(BASE, len(c)), out=sums[1:])
        size = (stop - start).astype(np.uint64)
        self.words = mix64((sums[stop] - sums[start]) * powers(INVERSE, len(c) + 1)[start] + size * U64(0xA0761D6478BD642F))
        newline = np.flatnonzero(c == 10)
        line = np.searchsorted(newline, start)
        self.first = np.flatnonzero(np.diff(line, prepend=-1))
        last = np.append(self.first[1:], len(start))[: len(self.first)]
        self.count = last - self.first
        line = line[self.first]
        # how many newlines lie before each text
        before = np.cumsum([0] + [t.count("\n") + 1 for t in texts])
        self.text = np.searchsorted(before, line, "right") - 1
        self.pos = line - before[self.text]
        letters = np.concatenate([[0], np.cumsum(stop - start)])
        self.chars = letters[last] - letters[self.first] + self.count - 1
        place = np.arange(len(start)) - np.repeat(self.first, self.count)
        self.k1, self.k2 = (mix64(np.add.reduceat(mix64(self.words ^ U64(salt)) * powers(BASE, int(place.max(initial=0)) + 1)[place], self.first) + self.count.astype(np.uint64)) if len(start) else np.empty(0, np.uint64) for salt in (0, 0x9FB21C651E98DF25))

    def simhash(self) -> np.ndarray:
        """64 bits by the majority of a line's word hashes."""
        out = np.empty(len(self.first), np.uint64)
        for lo, hi, words, first in self._runs():
            ones = np.add.reduceat(np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1), first, axis=0, dtype=np.int32)
            out[lo:hi] = np.packbits(2 * ones > self.count[lo:hi, None], axis=1).view(np.uint64).ravel()
        return out

    def _runs(self, most: int = 1 << 16) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Runs of lines with about `most` words: first line, last + 1, their words, where each line's words begin."""
        lo = 0
        while lo < len(self.first):
            hi = max(lo + 1, int(np.searchsorted(self.first, self.first[lo] + most)))
            end = self.first[hi] if hi < len(self.first) else len(self.words)
            yield lo, hi, self.words[self.first[lo] : end], self.first[lo:hi] - self.first[lo]
            lo = hi

    def keys(self, sim: np.ndarray) -> np.ndarray:
        """(lines x keys): three of four blocks of the SimHash with their number (not negative), and the bands (negative)."""
        block = [(sim >> U64(16 * k)) & U64(0xFFFF) for k in range(BLOCKS)]
        out = [U64(k << 48) | sum((block[b] << U64(16 * i) for i, b in enumerate(three)), U64(0)) for k, three in enumerate(combinations(range(BLOCKS), BLOCKS - 1))]
        ends = []
        for odd in _ODD:
            x = self.words * odd
            ends += [np.minimum.reduceat(x, self.first), np.maximum.reduceat(x, self.first)]
        for k in range(0, len(ends), ROWS):
            key = np.full(len(sim), k + 1, np.uint64)
            for e in ends[k : k + ROWS]:
                key = mix64(key * U64(0xD6E8FEB86659FD93) + e)
            out.append(key | U64(1 << 63))
        return np.stack(out, 1)


def _most(x: int) -> int:
    """The edits that a longer length of x allows."""
    return int((1 - SIMILARITY) * x + 1e-9)


def edit_distance(a: str, b: str, most: int) -> int:
    """The edit distance, or most + 1 if it is larger: Myers' bit vectors, as integers of any length."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    n = min(len(a), len(b))
    lo = 0
    while lo < n and a[lo : lo + 16] == b[lo : lo + 16]:
        lo += 16
    while lo < n and a[lo] == b[lo]:
        lo += 1
    lo = min(lo, n)
    hi = 0
    while hi < n - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    at: dict[str, int] = {}
    for i, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << len(b)) - 1, 1 << len(b) - 1
    up, down, score, left = full, 0, len(b), len(a)
    for c in a:
        eq = at.get(c, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (full & ~(x | up)), up & x
        score += (plus & top > 0) - (minus & top > 0)
        left -= 1
        if score - left > most:
            return most + 1
        plus, eq = (plus << 1 | 1) & full, eq | down
        up, down = (minus << 1 & full) | (full & ~(eq | plus)), plus & eq
    return min(score, most + 1)


def alike(a: str, b: str) -> bool:
    """1 - edit distance / longer length >= SIMILARITY. Where words alone prove it, characters are not compared."""
    most = _most(max(len(a), len(b)))
    x, y = a.split(" "), b.split(" ")
    if len(x) == len(y) and sum(max(len(p), len(q)) for p, q in zip(x, y) if p != q) <= most:
        return True
    return edit_distance(a, b, most) <= most
