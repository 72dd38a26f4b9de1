"""Words of whole Arrow text batches as arrays: the numpy side of the word-based operators.

A word is a longest run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return, with A-Z in lower case. Bytes above 0x7F never match these, so bytes of UTF-8 do as well as
code points. A word's hash is 64 bits wide and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**64, 256, dtype=_U, endpoint=False) | _U(1)
_BYTE[65:91] = _BYTE[97:123]
_P = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_P**i and its inverse modulo 2**64 for i up to n."""
    if not _powers or len(_powers[0]) <= n:
        n = max(n, CHUNK)
        up, down = np.full(n + 1, _P, _U), np.full(n + 1, pow(_P, -1, 2**64), _U)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def text_chunks(column: pa.Array | pa.ChunkedArray, chunk: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, their UTF-8 bytes, their offsets) in pieces of about ``chunk`` bytes; null is empty.

    A text is never cut; one that is longer comes alone.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, at, data = column.buffers()
    n = len(column)
    off = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + chunk, "right")) - 1)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


class Words:
    """The words of a chunk: starts, ends, and for each text the number of words before it (one more at the end)."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        self.raw = raw
        if not len(raw):
            self.starts = self.ends = np.zeros(0, np.int64)
            self.first = np.zeros(len(off), np.int64)
            return
        solid = ~_SPACE[raw]
        begin, end = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1]
        end[:-1] &= ~solid[1:]
        edge = off[:-1][off[:-1] < len(raw)]
        begin[edge] = solid[edge]
        edge = off[1:][off[1:] > 0] - 1
        end[edge] = solid[edge]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, off)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def segments(self) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(first word, end word, first byte, running sums of the bytes' terms): bounded pieces of a long text."""
        k, n = 0, len(self.starts)
        while k < n:
            base = int(self.starts[k])
            m = max(k + 1, int(np.searchsorted(self.ends, base + CHUNK, "right")))
            b = self.raw[base : int(self.ends[m - 1])]
            sums = np.zeros(len(b) + 1, _U)
            np.cumsum(_BYTE[b] * powers(len(b))[0][: len(b)], out=sums[1:])
            yield k, m, base, sums
            k = m

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self.starts), _U)
        for k, m, base, sums in self.segments():
            s, e = self.starts[k:m] - base, self.ends[k:m] - base
            out[k:m] = mix((sums[e] - sums[s]) * powers(len(sums))[1][s])
        return out
