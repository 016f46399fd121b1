"""Token ids of many whole texts at once: distinct chunks are encoded, the rest is looked up.

A byte-level BPE vocabulary of this kind never joins a character that is not white space with white space after it, so a
text can be cut before every run of white space. Texts with a special token's string go to ``tokenizers`` itself.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .words import U, Powers, mix

PIECE = 2_000_000            # bytes of text hashed at once, one text at least
CACHED = 1_000_000           # distinct chunks a worker keeps before it starts anew, some 40 bytes each


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i] to starts[i] + lengths[i] of all i, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = starts - np.append(0, np.cumsum(lengths)[:-1])
    return np.arange(total) + np.repeat(shift, lengths)


def _cuts(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where chunks start: at the start of a text, and where a run of ASCII white space follows anything else.

    White space beyond ASCII may join the run, so nothing is cut after bytes that may end such a character.
    """
    space = (data == 32) | ((data >= 9) & (data <= 13))
    start = np.zeros(len(data) + 1, bool)
    start[1:-1] = space[1:] & ~space[:-1]
    at = np.flatnonzero(start)
    last, before = data[at - 1], data[np.maximum(at - 2, 0)]
    wide = ((before == 0xC2) & ((last == 0x85) | (last == 0xA0))) | (((before == 0x80) | (before == 0x81) | (before == 0x9A)) & (last >= 0x80))
    start[at[wide]] = False
    start[edges[:-1]] = True
    start[len(data)] = False
    return np.flatnonzero(start)


class Encoder:
    """``encode(column)`` gives the ids of all its texts in one array, and how many each text has.

    ``ranks`` is the vocabulary as ranks, read by the faster library; tests hold the ids against ``tokenizers``.
    """
    def __init__(self, vocabulary: str, ranks: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer
        self.slow = Tokenizer.from_file(vocabulary)
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.width = np.zeros(max(table.values()) + 1, np.int64)
        for token, number in table.items():
            self.width[number] = len(token)
        self.special = [t.content.encode() for t in self.slow.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, U)              # sorted hashes of known chunks
        self.start = np.zeros(0, np.int64)       # where each one's ids start in ``ids``
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_binary()).fill_null(b"")
        edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        body = column.buffers()[2]
        data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
        ids, counts, low = [], [], 0
        while low < len(column):
            high = max(low + 1, int(np.searchsorted(edges, edges[low] + PIECE, "right")) - 1)
            own, n = self._piece(data[edges[low]:edges[high]], edges[low:high + 1] - edges[low])
            ids.append(own)
            counts.append(n)
            low = high
        return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _piece(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        if any(s in raw for s in self.special):
            parts = [self._slow(raw[edges[i]:edges[i + 1]]) for i in range(len(edges) - 1)]
            return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(edges) - 1, np.int64)
        start = _cuts(data, edges)
        end = np.append(start[1:], len(data))
        Powers.reach(len(data) + 1)
        total = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * Powers.up[:len(data)], out=total[1:])
        named = mix((total[end] - total[start]) * Powers.down[start] + mix((end - start).astype(U) * U(0xD6E8FEB86659FD93)))
        names, first, back = np.unique(named, return_index=True, return_inverse=True)
        at = self._learned(names, raw, start[first], end[first])
        own, n = self.start[at], self.count[at]
        ids = self.ids[ragged(own[back], n[back])]
        ends = np.append(0, np.cumsum(n[back]))
        texts = ends[np.searchsorted(start, edges)]
        return ids, np.diff(texts)

    def _learned(self, names: np.ndarray, raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Where each of the sorted names is known; chunks that are new are encoded, as one text, and cut again."""
        if len(self.known) + len(names) > CACHED and len(self.known):
            self.forget()
        at = np.minimum(np.searchsorted(self.known, names), max(len(self.known) - 1, 0))
        new = self.known[at] != names if len(self.known) else np.ones(len(names), bool)
        if new.any():
            chunks = [raw[a:b] for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)]
            ids, counts = self._encoded(chunks)
            place = np.append(self.start, len(self.ids) + np.append(0, np.cumsum(counts)[:-1]))
            known = np.append(self.known, names[new])
            order = np.argsort(known, kind="stable")
            self.known, self.start, self.count = known[order], place[order], np.append(self.count, counts)[order]
            self.ids = np.append(self.ids, ids)
            at = np.searchsorted(self.known, names)
        return at

    def _encoded(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks and how many each has.

        Chunks that start with white space and end otherwise may stand one after the other in one text. One that starts
        otherwise does so behind a line end, which is an id of its own; what starts or ends with wide white space goes alone.
        """
        first = np.frombuffer(b"".join([c[:1] for c in chunks]), np.uint8)
        last = np.frombuffer(b"".join([c[-1:] for c in chunks]), np.uint8)
        lead = (first == 32) | ((first >= 9) & (first <= 13))
        alone = (last == 32) | ((last >= 9) & (last <= 13)) | (first >= 128) | (last >= 128)
        for i in np.flatnonzero(alone & ((first >= 128) | (last >= 128))).tolist():
            text = chunks[i].decode()
            alone[i] = text[-1:].isspace() or (not lead[i] and text[:1].isspace())
        out, counts = np.zeros(0, np.uint32), np.zeros(len(chunks), np.int64)
        together = np.flatnonzero(~alone)
        if len(together):
            parts = [chunks[i] if w else b"\n" + chunks[i] for i, w in zip(together.tolist(), lead[together].tolist(), strict=True)]
            out = np.array(self.fast.encode_ordinary(b"".join(parts).decode()), np.uint32)
            ends = np.searchsorted(np.cumsum(self.width[out]), np.cumsum([len(c) for c in parts])) + 1
            counts[together] = np.diff(ends, prepend=0)
            drop = np.append(0, ends[:-1])[~lead[together]]
            out = np.delete(out, drop)
            counts[together[~lead[together]]] -= 1
        if not alone.any():
            return out, counts
        own = {i: np.array(self.fast.encode_ordinary(chunks[i].decode()), np.uint32) for i in np.flatnonzero(alone).tolist()}
        ends, at, all_ = np.cumsum(counts), 0, []
        for i, ids in own.items():
            counts[i] = len(ids)
            all_ += [out[at:ends[i]], ids]
            at = ends[i]
        return np.concatenate([*all_, out[at:]]), counts

    def _slow(self, text: bytes) -> np.ndarray:
        return np.array(self.slow.encode(text.decode(), add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=1)
def encoder_of(vocabulary: str, ranks: str) -> Encoder:
    """The encoder of a worker: the vocabulary is read once, and chunks stay known from task to task."""
    return Encoder(vocabulary, ranks)
