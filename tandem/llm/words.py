"""Words of whole batches as hash arrays: no Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tandem.llm.common import text_bytes

BASE = 0x9E3779B97F4A7C15
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

#: A byte of a word: letters, digits and every byte of a character outside ASCII.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX[0])
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX[1])
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    inverse = pow(BASE, -1, 1 << 64)
    out = []
    for b in (BASE, inverse):
        p = np.full(max(n, 1), np.uint64(b))
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


class Hasher:
    """Word hashes of string arrays; keeps the powers it needs between batches."""

    def __init__(self, word_byte: np.ndarray = WORD_BYTE, lower: bool = True):
        self.word_byte, self.lower = word_byte, lower
        self.up, self.down = powers(1)

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, text number, first byte, length) of every word; bytes count in the lower-cased batch."""
        data, at = text_bytes(pc.utf8_lower(texts) if self.lower else texts)
        if len(data) >= len(self.up):
            self.up, self.down = powers(len(data) + 1)
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = self.word_byte[data]
        flips = np.flatnonzero(inside[1:] != inside[:-1])
        cuts = np.unique(at[(at > 0) & (at < len(data))])
        # A text's end also ends a word: where both sides are word bytes it adds one end and one start.
        glued = cuts[inside[cuts] & inside[cuts + 1]]
        edges = np.sort(np.concatenate([flips, glued, glued]))
        first, end = edges[0::2], edges[1::2]
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data.astype(np.uint64) * self.up[: len(data)], dtype=np.uint64, out=total[1:])
        self.data, self.total, self.first, self.size = data, total, first, end - first
        return self.prefixes(None), np.searchsorted(at, first, "right") - 1, first, self.size

    def prefixes(self, length: int | None, which: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Hash of the first ``length`` bytes (all, if None) of the last words found; shorter words whole."""
        first, size = self.first[which], self.size[which]
        size = size if length is None else np.minimum(size, length)
        return mixed((self.total[first + size] - self.total[first]) * self.down[first] + size.astype(np.uint64))


def grams(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` hashes; the run at i starts at i."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    n = len(h) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(BASE) + h[k : k + n]
    return mixed(out)
