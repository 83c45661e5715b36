"""Hashes of words and of stretches of words, for whole Arrow columns of texts at once.

A word's hash is a polynomial of its bytes modulo 2**64, taken from running sums over the
text's bytes; a stretch's hash is a polynomial of its words' hashes, taken from running
sums over the words. Both are finished by a bijective mix, depend on nothing outside
the word or stretch, and are the same on every machine. Lanes use other factors, so that
two lanes together make a hash of 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes whose running sums are held at once, and bytes of texts that are worked on together.
_STRETCH, _PART = 1 << 18, 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base modulo 2**64, and of its inverse."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (self.base, pow(self.base, -1, 1 << 64)))


def _summed(terms: np.ndarray) -> np.ndarray:
    out = np.empty(len(terms) + 1, np.uint64)
    out[0] = 0
    np.cumsum(terms, out=out[1:])
    return out


class Words:
    """The words of some texts, one after the other; text i has the words from ``first[i]`` up to ``first[i + 1]``."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds
        solid = ~_SPACE[data]
        begins, stops = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        stops[:-1] &= ~solid[1:]
        inner = bounds[(bounds > 0) & (bounds < len(data))]
        begins[inner], stops[inner - 1] = solid[inner], solid[inner - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, bounds)

    def __len__(self) -> int:
        return len(self.starts)


class Hasher:
    """Hashes of one lane. lower: A-Z count as a-z."""

    def __init__(self, lane: int = 0, lower: bool = False):
        letters = np.arange(256, dtype=np.uint64)
        if lower:
            letters[0x41:0x5B] += np.uint64(0x20)
        self._table = mix(letters + np.uint64(0x5851F42D4C957F2D + 1000 * lane))
        self._bytes, self._words = _Powers(0x9E3779B97F4A7C15 + 4 * lane), _Powers(0xD1342543DE82EF95 + 4 * lane)

    def load(self, words: Words) -> None:
        """Take the words whose stretches are asked for next."""
        n = len(words)
        hashes, low = np.empty(n, np.uint64), 0
        while low < n:
            high = max(low + 1, int(np.searchsorted(words.ends, words.starts[low] + _STRETCH, "right")))
            at, to = words.starts[low], words.ends[high - 1]
            self._bytes.reach(to - at + 1)
            sums = _summed(self._table[words.data[at:to]] * self._bytes.up[: to - at])
            starts, ends = words.starts[low:high] - at, words.ends[low:high] - at
            hashes[low:high] = mix((sums[ends] - sums[starts]) * self._bytes.down[starts])
            low = high
        self._words.reach(n + 1)
        self.words, self._sums = hashes, _summed(hashes * self._words.up[:n])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hashes of the stretches of words from starts up to ends."""
        return mix((self._sums[ends] - self._sums[starts]) * self._words.down[starts] + (ends - starts).astype(np.uint64))


def parts(texts: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) of consecutive rows of a column of texts; null is an empty text."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    if len(texts) == 0:
        return
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + _PART, "right")) - 1)
        yield low, high, Words(data[offsets[low]: offsets[high]], offsets[low: high + 1] - offsets[low])
        low = high
