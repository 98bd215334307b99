"""Words of many texts as numpy arrays: positions, 64-bit word hashes, hashes of word runs.

Used inside Arrow tasks, on slices of bounded bytes.  All hashes are polynomials modulo
2**64 over the bytes (or words), finished with a mixer; they are the same in every process.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import offset_type

_U = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)   # odd 64-bit multipliers
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up = np.full(size, base, dtype=_U)
        up[0] = 1
        down = np.full(size, pow(base, -1, 1 << 64), dtype=_U)
        down[0] = 1
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= 1 << 22:
            _powers[base] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finisher."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class Words:
    """The words of a slice of an Arrow string array (nulls have none).

    data: bytes; start, end: of each word in data; doc: its row in the slice;
    first: the first word of each row, one more at the end.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        n = len(texts)
        if texts.null_count:
            texts = texts.fill_null("")
        off = np.frombuffer(texts.buffers()[1], dtype=offset_type(texts))[texts.offset:texts.offset + n + 1].astype(np.int64)
        lo, hi = int(off[0]), int(off[-1])
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8)[lo:hi] if raw is not None else np.zeros(0, np.uint8)
        off = off - lo
        if lower:
            upper = (data >= 65) & (data <= 90)
            data = data + (upper.astype(np.uint8) << 5)
        self.data = data
        self.text_offsets = off
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[off] = True
        before = np.zeros(len(data), dtype=bool)
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.zeros(len(data), dtype=bool)
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, off)
        self.doc = np.repeat(np.arange(n), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, base: int = BASES[0]) -> np.ndarray:
        """One 64-bit hash a word."""
        n = len(self.data)
        up, down = _power_table(base, n + 1)
        total = np.zeros(n + 1, dtype=_U)
        np.cumsum((self.data.astype(_U) + _U(1)) * up[:n], out=total[1:])
        h = (total[self.end] - total[self.start]) * down[self.start]
        return mix(h + (self.end - self.start).astype(_U) * _U(0xD6E8FEB86659FD93))

    def runs(self, word_hashes: np.ndarray, k: int, base: int = BASES[0]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k consecutive words and which of the starts lie in one text; length max(0, words - k + 1)."""
        n = len(word_hashes) - k + 1
        if n <= 0:
            return np.zeros(0, _U), np.zeros(0, bool)
        h = word_hashes[:n].copy()
        for j in range(1, k):
            h *= _U(base)
            h += word_hashes[j:j + n]
        return mix(h), self.doc[:n] == self.doc[k - 1:k - 1 + n]


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    n = len(values) - w + 1
    if n <= 0:
        return values[:0]
    have, span = values, 1
    while span * 2 <= w:
        have = np.minimum(have[:len(have) - span], have[span:])
        span *= 2
    return np.minimum(have[:n], have[w - span:w - span + n])


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
