"""Bounded-space online packing of documents into fixed windows of tokens.

Each partition keeps at most ``OPEN`` open windows. A document's whole windows go out at once; the rest is placed
best-fit. When it fits nowhere, the fullest window is emitted: with at most ``SLACK`` tokens of padding as it is, with
more room after it took the first tokens of the piece. The windows still open at the end of a partition are merged:
the pieces of ``MERGED`` neighbouring partitions are placed again, largest first, best-fit, uncut. So no task ever holds
more than its open windows or the leftovers of ``MERGED`` partitions, whatever the size of the input.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirworks.sources.workdir import written

from .bpe import Encoder
from .exchange import release

WINDOW = 2048
OPEN = 64
SLACK = 16
MERGED = 4
END = (1).to_bytes(4, "little")
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Windows:
    """Open windows ordered by what is left in them; ``put`` gives (window, offset)."""
    def __init__(self, first: int, size: int):
        self.size, self.next = size, first
        self.open: list[tuple[int, int]] = []      # (free, window), sorted

    def new(self) -> int:
        self.next += 1
        return self.next - 1

    def fit(self, length: int) -> tuple[int, int] | None:
        """Best fit: the window with the least room that holds the piece."""
        at = bisect.bisect_left(self.open, (length, -1))
        if at == len(self.open):
            return None
        free, window = self.open.pop(at)
        self.add(free - length, window)
        return window, self.size - free

    def add(self, free: int, window: int) -> None:
        if free:
            bisect.insort(self.open, (free, window))

    def begin(self, length: int) -> tuple[int, int]:
        window = self.new()
        self.add(self.size - length, window)
        return window, 0


def _placed(windows: Windows, total: int, limit: int, slack: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, length, window, offset) for the pieces of one document of ``total`` tokens."""
    start, size = 0, windows.size
    while total - start >= size:
        yield start, size, windows.new(), 0
        start += size
    while start < total:
        length = total - start
        if (found := windows.fit(length)) is None and len(windows.open) >= limit:
            free, window = windows.open.pop(0)     # the fullest goes out
            if free > slack:
                yield start, free, window, size - free
                start += free
                continue
        window, offset = found or windows.begin(length)
        yield start, length, window, offset
        start += length


def _pack_part(batches: Iterator[pa.RecordBatch], vocabulary: str, ranks: str, size: int) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    encoder, windows = Encoder(vocabulary, ranks), Windows(part << 32, size)
    for batch in batches:
        columns: list[list] = [[] for _ in range(8)]
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = encoder.ids(text.as_py() or "") + END
            total = len(ids) // 4
            for start, length, window, offset in _placed(windows, total, OPEN, SLACK):
                crc = zlib.crc32(memoryview(ids)[4 * start:4 * (start + length)])
                for column, value in zip(columns, (doc, start, length, crc, total, window, offset, False), strict=True):
                    column.append(value)
        yield _batch(columns)
    # the windows that are still open are known by now: one row each, without a document
    left = sorted(w for _, w in windows.open)
    del encoder
    release()
    yield _batch([[None] * len(left), *[[0] * len(left)] * 4, left, [0] * len(left), [True] * len(left)])


def _batch(columns: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.bool_()]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "open"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _merge(pieces, size: int):
    """Place the leftover pieces of a few partitions again, largest first; rows come in any order."""
    pieces = pieces.sort_values(["length", "sequence_id", "offset"], ascending=[False, True, True], kind="stable")
    windows = Windows((1 << 62) + (int(pieces["group"].iloc[0]) << 32), size)
    spots = [windows.fit(n) or windows.begin(n) for n in pieces["length"]]
    pieces["sequence_id"], pieces["offset"] = [w for w, _ in spots], [o for _, o in spots]
    return pieces.drop(columns="group")


def pack(docs: DataFrame, vocabulary: str | None = None, ranks: str | None = None, size: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and then id 1; a null text is empty, so it is that one id. Repeated rows are packed as often
    as they occur; an empty table gives no rows. ``vocabulary`` and ``ranks`` are the paths of one vocabulary's files.
    """
    if vocabulary is None or ranks is None:
        import public_tokenizers
        vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
        ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    vocabulary, ranks = str(vocabulary), str(ranks)
    placed = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lambda batches: _pack_part(batches, vocabulary, ranks, size), PIECE + ", open boolean"), "packed")
    rows = placed.where("NOT open").drop("open")
    left = placed.where("open").select("sequence_id")        # at most OPEN windows of each partition
    done = rows.join(left, "sequence_id", "left_anti")
    group = (F.shiftright("sequence_id", 32) / F.lit(MERGED)).cast("long")
    again = rows.join(left, "sequence_id", "left_semi").withColumn("group", group).groupBy("group").applyInPandas(lambda p: _merge(p, size), PIECE)
    names = [c.split()[0] for c in PIECE.split(", ")]
    return done.select(*names).unionByName(again.select(*names))
