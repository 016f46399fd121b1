"""Words of whole texts as 64-bit numbers, computed for many texts at once with numpy.

A word is a run of bytes outside space and 0x09-0x0D, or with ``letters`` a run of letters and digits; upper-case A-Z
can be folded. Every function is a pure function
of the text, so any executor that repeats a task gives the same numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15          # odd, so that it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 2 ** 64)
PIECE_BYTES = 500_000              # texts are worked on in pieces of about this size, one text at least: numbers take some 50 times as much
WORD_SQL = r"[^\x20\x09-\x0D]+"


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit numbers (a bijection)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U)
    out[0] = 1
    done, step = 1, base
    while done < n:
        more = min(done, n - done)
        out[done:done + more] = out[:more] * U(step)
        done, step = done + more, step * step % 2 ** 64
    return out


class Powers:
    """Powers of the base and of its inverse, as long as the longest run of bytes so far."""
    up = _powers(BASE, 1 << 10)
    down = _powers(INVERSE, 1 << 10)

    @classmethod
    def reach(cls, n: int) -> None:
        if n > len(cls.up):
            size = 1 << (n - 1).bit_length()
            cls.up, cls.down = _powers(BASE, size), _powers(INVERSE, size)


class Words:
    """The words of a few texts: ``hash`` of each word, where it starts and ends in ``data``, and ``ptr``: text i has
    the words ptr[i] to ptr[i + 1]."""
    def __init__(self, data: np.ndarray, edges: np.ndarray, fold: bool, letters: bool = False):
        self.edges = edges
        if fold:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        self.data = data
        n = len(data)
        inside = (data != 32) & ((data < 9) | (data > 13))
        if letters:  # ASCII letters and digits, and all bytes of other characters
            inside = ((data >= 97) & (data <= 122)) | ((data >= 65) & (data <= 90)) | ((data >= 48) & (data <= 57)) | (data >= 128)
        starts, ends = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        starts[:n] = inside
        starts[1:n] &= ~inside[:-1]
        ends[1:] = inside
        ends[1:n] &= ~inside[1:]
        cut = edges[1:-1][(edges[1:-1] > 0) & (edges[1:-1] < n)]
        starts[cut] |= inside[cut]
        ends[cut] |= inside[cut - 1]
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends)
        self.ptr = np.searchsorted(self.start, edges)
        Powers.reach(n + 1)
        self._total = np.zeros(n + 1, U)
        np.cumsum((data.astype(U) + U(1)) * Powers.up[:n], out=self._total[1:])
        self.hash = self._named(self.end)

    def _named(self, end: np.ndarray) -> np.ndarray:
        own = (self._total[end] - self._total[self.start]) * Powers.down[self.start]
        return mix(own + mix((end - self.start).astype(U) * U(0xD6E8FEB86659FD93)))

    def prefix(self, n: int) -> np.ndarray:
        """The number of the first n bytes of each word."""
        return self._named(np.minimum(self.start + n, self.end))

    def __len__(self) -> int:
        return len(self.edges) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)


def pieces(column: pa.Array, fold: bool = True, letters: bool = False, size: int = PIECE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) of a text column, a few whole texts at a time; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    edges = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(edges, edges[low] + size, "right")) - 1)
        yield low, high, Words(data[edges[low]:edges[high]], edges[low:high + 1] - edges[low], fold, letters)
        low = high


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """The number of each run of n words, in order."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    out = words[:m].copy()
    for i in range(1, n):
        out = mix(out * U(BASE) + words[i:m + i])
    return mix(out + U(n))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
