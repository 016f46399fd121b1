"""Token ids of whole documents in Re-Pair compressed files.

Documents are dealt into shards by ranges of their id, so that shards in order hold the documents in order. A shard is
written as blocks of about ``BLOCK`` ids (a longer document is a block of its own), one row each. In a block, frequent
pairs of neighbouring symbols are replaced by new symbols again and again: a round takes the pairs that occur at least as
often as its threshold, which falls from round to round down to ``LEAST``, replaces their occurrences from left to right,
and names them by the numbers after the largest one so far, until a round is no longer worth its rules. Pairs never reach
over the end of a document, so each document is a run of symbols of its own. A block stores its rules, the expansion
length of each rule, its symbols, and for each document its id, its ids and its symbols, so that any range of a document's
ids is found from lengths alone and decoded by expanding the few symbols that cover it.

The end id follows each document, also an empty one or one without text. Documents without an id come first; rows with
one id are ordered by a hash of their texts, equal ones next to each other. An empty table makes no blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirworks.sources.workdir import new_path

from .chunks import encoder_of, ragged

END = 0
BLOCK = 1 << 20              # ids in a block
SHARD_BYTES = 32_000_000     # of text in a shard
LEAST = 4                    # occurrences of a pair that gets a rule
FALL = 4                     # by how much the threshold falls from round to round
WORTH = 0.02                 # the last rounds end when one shortens its block by less than this share
SLOTS = 1 << 18
BLOCKS = ("shard int, block int, base long, n_ids long, doc_ids array<bigint>, tokens array<bigint>, symbols array<bigint>, "
          "rules binary, lengths binary, sequence binary")


class Grammar:
    """Rules (left, right) for the symbols from ``base`` on, and the expansion length of each."""
    def __init__(self, base: int, left: np.ndarray, right: np.ndarray, lengths: np.ndarray):
        self.base, self.left, self.right, self.lengths = base, left, right, lengths

    def size(self, symbols: np.ndarray) -> np.ndarray:
        """How many ids each symbol stands for."""
        out = np.ones(len(symbols), np.int64)
        inner = symbols >= self.base
        out[inner] = self.lengths[symbols[inner] - self.base]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """All symbols at once, one level of rules a step."""
        while True:
            inner = symbols >= self.base
            if not inner.any():
                return symbols
            at = np.cumsum(1 + inner) - 1 - inner
            out = np.empty(len(symbols) + int(inner.sum()), np.uint32)
            out[at[~inner]] = symbols[~inner]
            rule = symbols[inner] - self.base
            out[at[inner]], out[at[inner] + 1] = self.left[rule], self.right[rule]
            symbols = out

    def whole(self, symbols: np.ndarray) -> np.ndarray:
        """The same for many symbols: each rule is expanded once and copied to its places."""
        body = self.expand(np.arange(self.base, self.base + len(self.left), dtype=np.uint32))
        size, inner = self.size(symbols), symbols >= self.base
        out, own = np.repeat(symbols, size), np.repeat(inner, size)
        rule = symbols[inner] - self.base
        out[own] = body[ragged((np.cumsum(self.lengths) - self.lengths)[rule], self.lengths[rule])]
        return out

    def slice(self, symbols: np.ndarray, start: int, length: int) -> np.ndarray:
        """Ids start to start + length of what the symbols stand for; only the symbols that cover them are expanded."""
        ends = np.cumsum(self.size(symbols))
        low, high = np.searchsorted(ends, start, "right"), np.searchsorted(ends, start + length, "left") + 1
        before = int(ends[low - 1]) if low else 0
        return self.expand(symbols[low:high])[start - before:start - before + length]


def compress(ids: np.ndarray, edges: np.ndarray) -> tuple[Grammar, np.ndarray, np.ndarray]:
    """The grammar of a block, its symbols, and where each document starts in them; document i has ids[edges[i]:edges[i + 1]]."""
    seq, edges, base = ids.astype(np.uint32), edges.astype(np.int64), int(ids.max(initial=0)) + 1
    left, right, lengths, threshold = [], [], np.zeros(0, np.int64), None
    while len(seq) > 1:
        key = (seq[:-1].astype(np.uint64) << np.uint64(32)) | seq[1:]
        inside = np.ones(len(key), bool)
        inside[edges[1:-1] - 1] = False
        ordered = np.sort(key[inside])
        cut = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
        count = np.diff(np.append(cut, len(ordered)))
        most = int(count.max(initial=0))
        if most < LEAST:
            break
        threshold = max(LEAST, min(most, threshold or most) // FALL)
        chosen = np.flatnonzero(count >= threshold)
        chosen = chosen[np.argsort(count[chosen], kind="stable")]
        names = ordered[cut[chosen]]
        table = np.full(SLOTS, -1, np.int64)
        table[_slot(names)] = np.arange(len(names))          # of pairs that share a slot, the most frequent stays this round
        rule = table[_slot(key)]
        hit = np.flatnonzero(inside & (rule >= 0) & (names[rule] == key))
        # overlapping occurrences: every second one of a run of neighbours, from the left
        first = np.append(True, np.diff(hit) != 1)
        begin = np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))
        hit = hit[(np.arange(len(hit)) - begin) % 2 == 0]
        used = np.bincount(rule[hit], minlength=len(names))
        hit = hit[used[rule[hit]] >= 2]
        kept = np.flatnonzero(used >= 2)
        if not len(kept):
            if threshold == LEAST:
                break
            continue
        symbol = np.full(len(names), -1, np.int64)
        symbol[kept] = base + len(lengths) + np.arange(len(kept))
        a, b = (names[kept] >> np.uint64(32)).astype(np.int64), (names[kept] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        left.append(a)
        right.append(b)
        size = lambda s: np.where(s >= base, np.append(lengths, 0)[np.minimum(np.maximum(s - base, -1), len(lengths))], 1)  # noqa: E731, B023
        lengths = np.append(lengths, size(a) + size(b))
        seq = seq.copy()
        seq[hit] = symbol[rule[hit]]
        stay = np.ones(len(seq), bool)
        stay[hit + 1] = False
        edges = edges - np.searchsorted(hit + 1, edges)
        seq, before = seq[stay], len(seq)
        if threshold == LEAST and before - len(seq) < WORTH * before:
            break
    join = lambda parts: np.concatenate(parts).astype(np.uint32) if parts else np.zeros(0, np.uint32)
    return Grammar(base, join(left), join(right), lengths), seq, edges


def _slot(names: np.ndarray) -> np.ndarray:
    return ((names * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 18)).astype(np.int64)


def _narrow(x: np.ndarray) -> bytes:
    """Width in bytes, then the numbers, little-endian, as narrow as the largest allows."""
    kind = "<u2" if x.max(initial=0) < 1 << 16 else "<u4"
    return kind[-1:].encode() + x.astype(kind).tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u" + data[:1].decode(), offset=1).astype(np.uint32)


def _block(shard: int, block: int, doc_ids: list, ids: list[np.ndarray], tokens: np.ndarray) -> pa.RecordBatch:
    grammar, seq, edges = compress(np.concatenate(ids), np.append(0, np.cumsum(tokens)))
    row = {"shard": shard, "block": block, "base": grammar.base, "n_ids": int(tokens.sum()), "doc_ids": doc_ids, "tokens": tokens.tolist(),
           "symbols": np.diff(edges).tolist(), "rules": _narrow(np.concatenate([grammar.left, grammar.right])),
           "lengths": _narrow(grammar.lengths), "sequence": _narrow(seq)}
    longs = pa.list_(pa.int64())
    return pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("base", pa.int64()), ("n_ids", pa.int64()),
                                                        ("doc_ids", longs), ("tokens", longs), ("symbols", longs), ("rules", pa.binary()),
                                                        ("lengths", pa.binary()), ("sequence", pa.binary())]))


def _write_shard(batches: Iterator[pa.RecordBatch], vocabulary: str, ranks: str, end: int) -> Iterator[pa.RecordBatch]:
    shard, encoder, block = TaskContext.get().partitionId(), encoder_of(vocabulary, ranks), 0
    docs, ids, tokens, held = [], [], [], 0
    for batch in batches:
        low, column = 0, batch.column(1)
        while low < batch.num_rows:                  # a few megabytes of text at a time
            high, size = low, 0
            while high < batch.num_rows and (high == low or size < 4_000_000):
                size += len(column[high].as_buffer() or b"") if column[high].is_valid else 0
                high += 1
            own, counts = encoder.encode(column.slice(low, high - low))
            ends = np.cumsum(counts)
            for i, (a, b) in enumerate(zip(ends - counts, ends, strict=True)):
                if held and held + b - a + 1 > BLOCK:
                    yield _block(shard, block, docs, ids, np.array(tokens, np.int64))
                    docs, ids, tokens, held, block = [], [], [], 0, block + 1
                docs.append(batch.column(0)[low + i].as_py())
                ids.append(np.append(own[a:b], np.uint32(end)))
                tokens.append(int(b - a) + 1)
                held += int(b - a) + 1
            low = high
    if docs:
        yield _block(shard, block, docs, ids, np.array(tokens, np.int64))


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, ranks: str | None = None, end: int = END) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) as compressed blocks, and give them as read back.

    ``vocabulary`` and ``ranks`` are the paths of one vocabulary's files. A shard takes about ``SHARD_BYTES`` of text.
    """
    if vocabulary is None or ranks is None:
        import public_tokenizers
        vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
        ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    vocabulary, ranks = str(vocabulary), str(ranks)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    # ties go on in the order of where their rows were read, so that many rows with one id and text spread, too
    spread = docs.withColumn("from", F.spark_partition_id()).repartitionByRange(-(-int(size) // SHARD_BYTES) or 1, *order, "from")
    rows = spread.sortWithinPartitions(*order, "from").select("doc_id", "text")
    rows.mapInArrow(lambda batches: _write_shard(batches, vocabulary, ranks, end), BLOCKS).write.parquet(path)
    return read_blocks(docs.sparkSession, path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(path)


def _grammar(row: dict) -> tuple[Grammar, np.ndarray]:
    rules = _wide(row["rules"])
    half = len(rules) // 2
    return Grammar(row["base"], rules[:half], rules[half:], _wide(row["lengths"]).astype(np.int64)), _wide(row["sequence"])


def _digest(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            grammar, seq = _grammar(row)
            tokens = np.array(row["tokens"], np.int64)
            starts = np.cumsum(tokens) - tokens
            ids = grammar.whole(seq).astype("<u4")
            if len(ids) != tokens.sum():
                raise ValueError(f"block {row['block']} of shard {row['shard']} holds {len(ids)} ids, not {tokens.sum()}")
            parts = [ids[a:a + n] for a, n in zip(starts, tokens, strict=True)]
            columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["before"]), pa.array(tokens),
                       pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64())]
            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
            if whole:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(starts, tokens.sum()), pa.int32()), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)


def _placed(blocks: DataFrame) -> DataFrame:
    """Blocks with ``before``, the ids of all blocks before them; shards are summed first, so few rows meet in one task."""
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_shard"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    places = blocks.select("shard", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("_block")).join(shards, "shard")
    return blocks.join(places.select("shard", "block", (F.col("_shard") + F.col("_block")).alias("before")), ["shard", "block"])


def read_tokens(blocks: DataFrame, ids: bool = True) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32 and, with ``ids``, all its ids."""
    shape = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")
    return _placed(blocks).mapInArrow(lambda batches: _digest(batches, ids), shape)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            grammar, seq = _grammar(row)
            ends = np.cumsum(row["symbols"])
            out = []
            for w in row["wanted"]:
                for at, doc in enumerate(row["doc_ids"]):
                    if doc == w["doc_id"]:
                        own = seq[ends[at] - row["symbols"][at]:ends[at]]
                        length = max(0, min(w["length"], row["tokens"][at] - w["from"]))
                        out.append({**w, "ids": grammar.slice(own, w["from"], length).tolist() if length else []})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("from", pa.int64()), ("length", pa.int64()), ("ids", pa.list_(pa.int32()))]))


def token_ranges(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Ids ``from`` to ``from`` + ``length`` of documents (doc_id, from, length), without decoding the rest of their blocks."""
    at = blocks.select("shard", "block", F.explode(F.array_distinct("doc_ids")).alias("doc_id"))
    asked = wanted.select("doc_id", F.col("from").cast("long"), F.col("length").cast("long"))
    asked = at.join(asked, "doc_id").groupBy("shard", "block").agg(F.collect_list(F.struct("doc_id", "from", "length")).alias("wanted"))
    return blocks.join(asked, ["shard", "block"]).mapInArrow(_found, "doc_id long, from long, length long, ids array<int>")


def tokenize_documents(docs: DataFrame) -> DataFrame:
    """Per document, as read back from the files: doc_id, start, n_tokens, ids_crc32."""
    return read_tokens(write_tokens(docs, new_path(docs.sparkSession, "token-ids")), ids=False)
