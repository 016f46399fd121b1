"""Questions of document batches about keys of the whole corpus, asked and answered by shuffles.

A batch is a few megabytes of whole documents, one row of a written table. It asks about its distinct 64-bit keys, each
with its own counts; a shuffle brings the questions of one slice of the key space together, equal keys are summed, and
the answers go back in the order of the questions, so that no key travels twice. A batch asks once for a key however
often it occurs, so a key that a third of all documents hold is as cheap as any other: a slice's rows are at most one
for each batch. Sorted keys are sent as differences.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirworks.sources.workdir import written

from .words import U

BATCH_BYTES = 4_000_000      # of text in a batch; a longer text is a batch of its own
SLICE_BYTES = 16_000_000     # of text for each slice of the key space: about two million keys meet in a slice


def pack_rows(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def unpack_rows(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def _cut(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    part, serial = TaskContext.get().partitionId(), 0
    for batch in batches:
        length = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < len(length):
            before = length[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(length, before + size, "right")))
            yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + serial], pa.int64()), pa.array([int(length[high - 1] - before)], pa.int64()),
                                              pa.array([pack_rows(batch.slice(low, high - low))], pa.binary())], ["batch", "bytes", "docs"])
            low, serial = high, serial + 1
        release()


def batched(docs: DataFrame, size: int = BATCH_BYTES) -> DataFrame:
    """The written table of batches (batch, bytes, docs); the second column of ``docs`` is the text."""
    return written(docs.mapInArrow(lambda batches: _cut(batches, size), "batch long, bytes long, docs binary"), "batches")


def slices(table: DataFrame) -> int:
    return max(1, -(-(table.agg(F.sum("bytes")).first()[0] or 0) // SLICE_BYTES))


def release() -> None:
    """Give free memory back to the system: a worker lives on, and what one stage needed would add up with the next one's."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):            # the C library of Linux
        ctypes.CDLL(None).malloc_trim(0)


def each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time: a batch of text is megabytes, so no second one is held as Python objects."""
    for rows in batches:
        for i in range(rows.num_rows):
            yield rows.slice(i, 1).to_pylist()[0]
            release()


def _planes(x: np.ndarray) -> bytes:
    """Byte planes, most of them zero, so that they compress."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes()


def _unplanes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def encode(keys: np.ndarray, values: np.ndarray) -> bytes:
    """Sorted keys with their values (keys x columns of uint32)."""
    head = np.array([len(keys), values.shape[1]], "<u8").tobytes()
    body = _planes(np.diff(keys, prepend=U(0))) + b"".join(_planes(values[:, k]) for k in range(values.shape[1]))
    return zstandard.ZstdCompressor(level=1).compress(head + body)


def decode(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, k = (int(x) for x in np.frombuffer(raw[:16], "<u8"))
    keys = np.cumsum(_unplanes(raw[16:16 + 8 * n], U), dtype=U) if n else np.zeros(0, U)
    values = np.empty((n, k), np.uint32)
    for i in range(k):
        values[:, i] = _unplanes(raw[16 + 8 * n + 4 * n * i:16 + 8 * n + 4 * n * (i + 1)], np.uint32) if n else 0
    return keys, values


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sums of their values."""
    if not len(keys):
        return keys, values.astype(np.uint32)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(values[order], first, axis=0).astype(np.uint32)


Ask = Callable[[dict], list[tuple[np.ndarray, np.ndarray]]]
Answer = Callable[[int, np.ndarray, np.ndarray], tuple[np.ndarray, list]]


def _asked(batches: Iterator[pa.RecordBatch], ask: Ask, count: int) -> Iterator[pa.RecordBatch]:
    edges = np.array([(k << 64) // count for k in range(1, count)], U)
    for row in each_row(batches):
        number, at, kind, payload = [], [], [], []
        for stream, (keys, values) in enumerate(ask(row)):
            cuts = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
            for k in np.flatnonzero(np.diff(cuts)):
                number.append(row["batch"])
                at.append(int(k))
                kind.append(stream)
                payload.append(encode(keys[cuts[k]:cuts[k + 1]], values[cuts[k]:cuts[k + 1]]))
        yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(at, pa.int32()), pa.array(kind, pa.int32()), pa.array(payload, pa.binary())],
                                         ["batch", "slice", "stream", "keys"])


def _answered(rows: pd.DataFrame, answer: Answer, totals: int) -> pd.DataFrame:
    rows = rows.sort_values("batch", kind="stable")
    parts = [decode(x) for x in rows["keys"]]
    keys = np.concatenate([k for k, _ in parts])
    found, back = np.unique(keys, return_inverse=True)
    values = np.concatenate([v for _, v in parts])
    sums = np.stack([np.bincount(back, values[:, i], len(found)).astype(np.int64) for i in range(values.shape[1])], 1)
    made, total = answer(int(rows["stream"].iloc[0]), found, sums)
    out, at = [], 0
    for k, _ in parts:
        own = made[back[at:at + len(k)]]
        out.append(zstandard.ZstdCompressor(level=1).compress(b"".join(_planes(own[:, i].astype(np.uint32)) for i in range(own.shape[1]))))
        at += len(k)
    del parts, keys, found, back, values, sums, made
    release()
    frame = pd.DataFrame({"batch": rows["batch"].to_numpy(), "slice": rows["slice"].to_numpy(), "stream": rows["stream"].to_numpy(), "values": out})
    frame["totals"] = [[0] * totals for _ in out]
    frame.at[frame.index[0], "totals"] = [int(x) for x in total]
    return frame


def several(stream: int, keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, list]:
    """The answer whether a key occurs more than once."""
    return sums > 1, []


def asked(table: DataFrame, ask: Ask, answer: Answer, columns: int, totals: int, count: int | None = None) -> DataFrame:
    """The written answers (batch, slice, stream, values, totals).

    ``ask(row)`` gives streams of (sorted distinct keys, values); ``answer(stream, keys, sums)`` gives, for the keys of
    one slice and the sums of their values over all batches, an array of ``columns`` numbers for each key, and ``totals``
    numbers that are to be summed over all slices (they stand on one row of each).
    """
    count = count or slices(table)
    rows = table.mapInArrow(lambda batches: _asked(batches, ask, count), "batch long, slice int, stream int, keys binary")
    return written(rows.groupBy("slice", "stream").applyInPandas(lambda rows: _answered(rows, answer, totals),
                   "batch long, slice int, stream int, values binary, totals array<bigint>"), "answers")


def joined(table: DataFrame, answers: DataFrame) -> DataFrame:
    """The batches with their answers: an array of (stream, slice, values), at most one for each stream and slice."""
    own = answers.groupBy("batch").agg(F.collect_list(F.struct("stream", "slice", "values")).alias("answers"))
    return table.join(own, "batch", "left")


def values(row: dict, stream: int, columns: int) -> np.ndarray:
    """The answers for one stream of a joined row, in the order of its keys (keys x columns)."""
    own = sorted((a for a in row["answers"] or [] if a["stream"] == stream), key=lambda a: a["slice"])
    parts = []
    for a in own:
        raw = zstandard.ZstdDecompressor().decompress(a["values"])
        n = len(raw) // (4 * columns)
        parts.append(np.stack([_unplanes(raw[4 * n * i:4 * n * (i + 1)], np.uint32) for i in range(columns)], 1))
    return np.concatenate(parts) if parts else np.zeros((0, columns), np.uint32)
