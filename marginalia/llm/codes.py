"""Batches of texts as arrays of code points, so that counting runs in numpy."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Sequence
from functools import cache

import numpy as np

SPACE, LINE, LETTER, UPPER, DIGIT, ORDINARY, VOWEL, ENDER = (1 << k for k in range(8))
_P = np.uint64(1099511628211)
_P_INV = np.uint64(pow(1099511628211, -1, 1 << 64))


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """(flags, lower-case code) of every code point of the basic plane; the last entry stands for all others."""
    flags, lower = np.zeros(65536, np.uint8), np.arange(65536, dtype=np.uint32)
    for i in range(65536):
        c = chr(i)
        kind = unicodedata.category(c)
        if c in "\n\r\x0b\x0c\x85  ":
            flags[i] = SPACE | LINE
        elif c.isspace() or kind == "Zs":
            flags[i] = SPACE
        elif kind[0] == "L" or kind in ("Mn", "Mc"):
            flags[i] = LETTER | (UPPER if kind in ("Lu", "Lt") else 0)
            if (low := c.lower()) and len(low) == 1:
                lower[i] = ord(low)
            if unicodedata.normalize("NFD", c.lower())[0] in "aeiouy":
                flags[i] |= VOWEL
        elif kind[0] == "N":
            flags[i] = DIGIT
        elif c in ".,;:!?'\"()-‘’“”„…–—«»¿¡":
            flags[i] = ORDINARY | (ENDER if c in ".!?…" else 0)
    return flags, lower


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, _P, np.uint64)), np.cumprod(np.full(n, _P_INV, np.uint64))


class Batch:
    """Code points of all texts, each followed by a 0."""

    def __init__(self, texts: Sequence[str | None]):
        whole = "\0".join((t or "").replace("\0", " ") for t in texts) + "\0"
        code = np.frombuffer(whole.encode("utf-32-le", "replace"), np.uint32)
        self.code = np.where(code < 65536, code, 0xFFFD)
        flags, lower = tables()
        self.flags = flags[self.code]
        self.lower = lower[self.code]
        self.ends = np.flatnonzero(code == 0)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1])
        self.n = len(texts)

    def doc(self, places: np.ndarray) -> np.ndarray:
        """Number of the text that each place is in."""
        return np.searchsorted(self.ends, places)

    def per_doc(self, places: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.doc(places), weights, self.n).astype(np.float64)

    def count(self, mask: np.ndarray) -> np.ndarray:
        """How many places of each text the mask holds for."""
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (total[self.ends] - total[self.starts]).astype(np.float64)

    def runs(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the runs where the mask holds."""
        edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
        return edge[::2], edge[1::2]

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of lower-cased runs."""
        n = len(self.code)
        size = 1 << (n - 1).bit_length() if n > 1 else 1
        up, down = powers(size)
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.lower.astype(np.uint64) * up[:n])])
            return (total[end] - total[start]) * down[start]


def word_hashes(words: Iterable[str]) -> np.ndarray:
    """Sorted hashes of words as Batch.hashes gives them."""
    b = Batch(sorted(set(words)))
    return np.unique(b.hashes(b.starts, b.ends))


def member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    at = np.searchsorted(ordered, values)
    return ordered[np.minimum(at, len(ordered) - 1)] == values if len(ordered) else np.zeros(len(values), bool)
