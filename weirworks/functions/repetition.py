"""Exact detector of a unit of 50 or more characters printed three times in a row within one line.

The backtracking regex for this is quadratic and worse.  A run of period p and length 3p always covers
two whole neighbouring blocks that start at multiples of p, so it is enough to compare the blocks
``[kp, kp+p)`` and ``[kp+p, kp+2p)`` for every p and k: n log n pairs, compared by rolling hash in numpy and
confirmed on the characters themselves.

Most texts and lines are spared that: a text without a line of 150 characters has no run, and a run of 3p >= 150 characters holds a window of 32 that starts at a multiple of 32 and stands
there again p later, so a line in which no such window stands twice has no run.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dims

# workers get the functions themselves and need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
WINDOW = 32            # at most (2 * unit + 1) / 2, so that one that starts at a multiple lies in the first two units
PAIRS_PER_STEP = 1 << 17
LINE_ENDS = (0x0A, 0x0D, 0x2028, 0x2029)


POWERS: list[np.ndarray] = []


def _powers(n: int) -> np.ndarray:
    """Powers of the base from 0 on; the longest table so far is kept."""
    if not POWERS or len(POWERS[0]) < n:
        table = np.ones(max(n, 1 << 14), dtype=np.uint64)
        np.cumprod(np.full(len(table) - 1, BASE, dtype=np.uint64), out=table[1:])
        POWERS[:] = [table]
    return POWERS[0]


def _periodic_run(line: np.ndarray, start: int, p: int) -> bool:
    """Whether the square at ``start`` grows, left and right, to three periods."""
    back = min(p, start)
    left = line[start - back:start] == line[start - back + p:start + p]
    ahead = min(p, len(line) - start - 2 * p)
    right = line[start + 2 * p:start + 2 * p + ahead] == line[start + p:start + p + ahead]
    grown = 0
    for same in (left[::-1], right):
        grown += len(same) if same.all() else int(np.argmin(same))
    return grown >= p


def _stands_again(line: np.ndarray) -> bool:
    """Whether a window that starts at a multiple of its length stands elsewhere too, by hash."""
    hashes, step = line.astype(np.uint64), 1
    with np.errstate(over="ignore"):
        while step < WINDOW:
            hashes, step = hashes[:-step] * (BASE + np.uint64(2 * step)) + hashes[step:], 2 * step
    own = np.sort(hashes[::WINDOW])
    at = np.minimum(np.searchsorted(own, hashes), len(own) - 1)
    return bool((own[1:] == own[:-1]).any()) or int((own[at] == hashes).sum()) > len(own)


def has_triple(line: np.ndarray, unit: int = dims.REPETITION_UNIT) -> bool:
    n = len(line)
    if n < 3 * unit:
        return False
    with np.errstate(over="ignore"):
        scale = _powers(n + 1)
        prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(line.astype(np.uint64) * scale[:n], out=prefix[1:])
        periods = np.arange(unit, n // 3 + 1)
        blocks = n // periods - 1
        step_ends = np.cumsum(blocks)
        first = 0
        while first < len(periods):
            done = step_ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(step_ends, done + PAIRS_PER_STEP, side="right")))
            counts = blocks[first:last]
            p = np.repeat(periods[first:last], counts)
            k = np.arange(len(p)) - np.repeat(np.cumsum(counts) - counts, counts)
            i = k * p
            one = (prefix[i + p] - prefix[i]) * scale[p]
            two = prefix[i + 2 * p] - prefix[i + p]
            for hit in np.flatnonzero(one == two):
                a, q = int(i[hit]), int(p[hit])
                if np.array_equal(line[a:a + q], line[a + q:a + 2 * q]) and _periodic_run(line, a, q):
                    return True
            first = last
    return False


def _has_line(text: str, n: int) -> bool:
    """Whether some line has ``n`` or more characters: from one line's start it looks back from ``n`` further on."""
    for end in LINE_ENDS[1:]:
        text = text.replace(chr(end), "\n")
    at = 0
    while len(text) - at >= n:
        end = text.rfind("\n", at, at + n)
        if end < 0:
            return True
        at = end + 1
    return False


def text_has_triple(text: str | None, unit: int = dims.REPETITION_UNIT) -> bool:
    if text is None or len(text) < 3 * unit:
        return False
    # a character takes two units at most
    if not _has_line(text, 3 * unit if text.isascii() else -(-3 * unit // 2)):
        return False
    chars = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype=np.uint16)
    if 2 * unit >= 2 * WINDOW - 1 and not _stands_again(chars):
        return False
    ends = np.flatnonzero(np.isin(chars, LINE_ENDS))
    starts = np.concatenate(([0], ends + 1))
    stops = np.concatenate((ends, [len(chars)]))
    long = [chars[starts[j]:stops[j]] for j in np.flatnonzero(stops - starts >= 3 * unit)]
    # shorter units than the window asks for are looked for in every line
    return any((2 * unit < 2 * WINDOW - 1 or _stands_again(line)) and has_triple(line, unit) for line in long)


@F.arrow_udf(T.BooleanType())
def _repeats(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """One text at a time: a batch of them is never held as Python objects."""
    for texts in batches:
        yield pa.array((text_has_triple(text.as_py()) for text in texts), pa.bool_(), size=len(texts))
        pa.default_memory_pool().release_unused()


def repetition_loop(text: Column) -> Column:
    """Only texts long enough to repeat are sent to the Arrow worker."""
    worth = F.when(F.length(text) >= 3 * dims.REPETITION_UNIT, text)
    return _repeats(worth)
