"""Character n-grams of many texts as numpy arrays (used inside Arrow tasks, on bounded slices)."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

from .textarrays import mix

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
SPACE = 32


@functools.lru_cache(maxsize=2)
def _class_table(digits: bool) -> np.ndarray:
    """True at the code points that are letters (and, if asked, digits)."""
    test = str.isalnum if digits else str.isalpha
    return np.fromiter((test(chr(i)) for i in range(0x110000)), dtype=bool, count=0x110000)


class Letters:
    """Lower-cased code points of a slice of texts; what is not a letter is a blank, and every text ends with one.

    points: code points after one leading blank; doc: text row of every point;
    letters: how many letters each text has.
    """

    def __init__(self, texts: pa.Array, digits: bool = False):
        lowered = [(t or "").lower() + " " for t in texts.to_pylist()]
        sizes = np.fromiter(map(len, lowered), dtype=np.int64, count=len(lowered))
        raw = np.frombuffer((" " + "".join(lowered)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.is_letter = _class_table(digits)[raw]
        self.points = np.where(self.is_letter, raw, SPACE).astype(_U)
        self.n = len(lowered)
        self.doc = np.concatenate([[0], np.repeat(np.arange(self.n), sizes)]).astype(np.int32) if self.n else np.zeros(1, np.int32)
        self.letters = np.bincount(self.doc[self.is_letter], minlength=self.n)[:self.n]

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text row) of the n-grams whose inner points are letters; the first and last may be the blank beside a word."""
        m = len(self.points) - n + 1
        if m <= 0:
            return np.zeros(0, _U), np.zeros(0, np.int32)
        inner = self.is_letter[1:1 + m].copy()
        for j in range(2, n - 1):
            inner &= self.is_letter[j:j + m]
        at = np.flatnonzero(inner)
        h = self.points[at] + _U(n << 24)
        for j in range(1, n):
            h *= _P
            h += self.points[at + j]
        return mix(h), self.doc[at + 1]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text row) of every run of letters."""
        starts = np.flatnonzero(self.is_letter[1:] & ~self.is_letter[:-1]) + 1
        ends = np.flatnonzero(self.is_letter[:-1] & ~self.is_letter[1:]) + 1
        if not len(starts):
            return np.zeros(0, _U), np.zeros(0, np.int32)
        # Polynomial over the word by reduceat; a word's own length fixes the powers.
        length = ends - starts
        offset = np.arange(len(self.points)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(self.points)]])))
        power = np.multiply.accumulate(np.concatenate([[_U(1)], np.full(int(length.max()), _P, dtype=_U)]))
        inside = np.minimum(offset, len(power) - 1)
        terms = np.where(self.is_letter, self.points * power[inside], _U(0))
        return mix(np.add.reduceat(terms, starts) + length.astype(_U)), self.doc[starts]
