"""Removal of long repeated word sequences, found by recompression.

Rounds name the words of a text anew: first the words inside a run of equal words, then, twice, adjacent pairs whose
first name falls in one half of a hash and whose second in the other. A name is a number of what it stands for, so every
executor names equal sequences alike without a shared dictionary. Whether two neighbours become a pair depends on them
alone, so two occurrences of one sequence get the same names but for the first ``EDGE`` words and the last few. Runs of
high-level names that span at least ``PHRASE`` words make phrases, and a window of ``WINDOW`` words is known by the
smallest phrase that starts where every occurrence of the window is named alike.

Spark then works in rounds over batches of whole texts (see ``exchange``). The first asks which phrases stand in more
than one place; windows with other phrases are unique. The second verifies the rest: it asks which of their whole word
sequences occur more than once. Every word under a repeated window goes. Sequences are compared by 64-bit numbers.

Null texts have no words, texts shorter than a window lose none; repeated rows are repeats of each other; the result has
one row per row of the input, none for an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import asked, batched, each_row, joined, several, unpack_rows, values
from .words import BASE, Powers, U, Words, mix, pieces

WINDOW = 35
PAIR_ROUNDS = 2        # names then span at most 4 words
PHRASE = 6             # words that a phrase spans at least; at most 3 more
EDGE = 4               # from this word of a window on, names do not depend on what stands before it
LAST = 25              # the last word of a window at which a phrase may start: it then ends on names that hold everywhere
NONE = ~U(0)


def names(words: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, first word) of the names that the rounds give; ``ptr`` says where texts begin, names stay inside one."""
    apart = np.zeros(len(words) + 1, bool)
    apart[ptr] = True
    equal = np.zeros(len(words) + 1, bool)
    equal[1:-1] = (words[1:] == words[:-1]) & ~apart[1:-1]
    symbol = np.where(equal[1:] | equal[:-1], mix(words ^ U(0x52554E)), words)
    start = np.arange(len(words))
    for turn in range(PAIR_ROUNDS):
        first = (mix(symbol + U(turn + 1)) >> U(63)).astype(bool)
        pair = first[:-1] & ~first[1:] & ~apart[start[1:]]
        symbol = symbol.copy()
        at = np.flatnonzero(pair)
        symbol[at] = mix(mix(symbol[at] * U(BASE) + U(turn)) + symbol[at + 1])
        kept = np.append(True, ~pair) if len(start) else np.zeros(0, bool)
        symbol, start = symbol[kept], start[kept]
    return symbol, start


def _sequence(numbers: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The number of each run numbers[low:high]."""
    Powers.reach(len(numbers) + 1)
    total = np.zeros(len(numbers) + 1, U)
    np.cumsum(mix(numbers) * Powers.up[:len(numbers)], out=total[1:])
    return mix((total[high] - total[low]) * Powers.down[low] + (high - low).astype(U))


def phrases(words: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """For each word the number of the phrase that starts there, NONE where none does."""
    out = np.full(len(words), NONE)
    symbol, start = names(words, ptr)
    edges = np.append(start, len(words))
    low = np.arange(len(start))
    high = np.searchsorted(edges, start + PHRASE)
    ends = ptr[np.searchsorted(ptr, start, "right")] if len(start) else start
    good = (high < len(edges)) & (edges[np.minimum(high, len(start))] <= ends)
    out[start[good]] = _sequence(symbol, low[good], high[good])
    return out


def windows(words: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, phrase, place of that phrase) of every window inside one text."""
    count = np.maximum(np.diff(ptr) - WINDOW + 1, 0)
    first = np.repeat(ptr[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    if not len(first):
        return first, np.zeros(0, U), first
    best, place, reach, width = phrases(words, ptr), np.arange(len(words)), 1, LAST - EDGE + 1
    while reach < width:                     # leftmost smallest of the next ``reach`` places, the reach growing
        step = min(reach, width - reach)
        less = best[step:] < best[:-step]
        best, place = np.append(np.where(less, best[step:], best[:-step]), best[-step:]), np.append(np.where(less, place[step:], place[:-step]), place[-step:])
        reach += step
    return first, best[first + EDGE], place[first + EDGE]


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, count = np.unique(keys, return_counts=True)
    return found, count.astype(np.uint32)[:, None]


def _pieces(row: dict) -> tuple[pa.RecordBatch, Iterator[tuple[int, int, Words]]]:
    rows = unpack_rows(row["docs"])
    return rows, pieces(rows.column(1), fold=False)


def _ask_phrases(row: dict):
    found = []
    for _, _, w in _pieces(row)[1]:
        _, phrase, place = windows(w.hash, w.ptr)
        found.append(phrase[np.append(True, place[1:] != place[:-1])] if len(place) else phrase)
    return [_counted(np.concatenate(found))]


def _open_windows(row: dict) -> Iterator[tuple[int, int, Words, np.ndarray, np.ndarray]]:
    """Windows whose phrase stands in several places, with the numbers of their sequences; after the first answers."""
    again = values(row, 0, 1)[:, 0].astype(bool)
    keys = _ask_phrases(row)[0][0]
    for low, high, w in _pieces(row)[1]:
        first, phrase, _ = windows(w.hash, w.ptr)
        first = first[again[np.searchsorted(keys, phrase)]] if len(first) else first
        yield low, high, w, first, _sequence(w.hash, first, first + WINDOW)


def _ask_windows(row: dict):
    empty = (np.zeros(0, U), np.zeros((0, 1), np.uint32))
    return [empty, _counted(np.concatenate([k for *_, k in _open_windows(row)]))]


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in each_row(batches):
        docs = unpack_rows(row["docs"])
        again, keys = values(row, 1, 1)[:, 0].astype(bool), _ask_windows(row)[1][0]
        total, gone, digest = [], [], []
        for low, high, w, first, sequence in _open_windows(row):
            hit = first[again[np.searchsorted(keys, sequence)]] if len(first) else first
            change = np.zeros(len(w.hash) + 1, np.int64)
            np.add.at(change, hit, 1)
            np.add.at(change, hit + WINDOW, -1)
            kept = np.cumsum(change[:-1]) == 0
            for i in range(high - low):
                own = kept[w.ptr[i]:w.ptr[i + 1]]
                left = w.data[w.edges[i]:w.edges[i + 1]].tobytes().split()
                total.append(len(own))
                gone.append(int(len(own) - own.sum()))
                digest.append(hashlib.sha256(b" ".join(compress(left, own.tolist()))).hexdigest())
        yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 per document: every word under a window of ``WINDOW`` words that starts
    in more than one place of the table is removed."""
    table = batched(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    some = asked(table, _ask_phrases, several, 1, 0)
    more = asked(joined(table, some), _ask_windows, several, 1, 0)
    final = joined(table, some.unionByName(more)).select("docs", "answers")
    return final.mapInArrow(_cleaned, "doc_id long, n_words long, n_removed long, kept_sha256 string")
