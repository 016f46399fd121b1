"""Benchmark decontamination by greedy string tiling.

The benchmark's runs of ``TILE`` words are the seeds. One pass over the documents keeps, of each whole text, the words
that a seed covers, and its distinct seeds; a join on the seeds finds the (document, item) pairs that share tokens. For
each pair the longest common run of unmarked words is marked again and again, until none of ``TILE`` words is left; runs
are found by Karp-Rabin numbers, which running sums give for any length, of a length that is narrowed down by halving, and
compared word by word. Passages
that were cut up and put in another order are still covered, tile by tile. A document is contaminated by an item of which
tiles cover at least ``COVERAGE`` of the words.

The benchmark goes through in blocks of at most ``BLOCK_WORDS`` words, and only a block's seeds are broadcast, so its
size is bounded; all documents meet every block. Words fold A-Z. Null and empty texts share nothing; items of fewer than
``TILE`` words cannot be covered and are left out; items and documents meet by row numbers, so those without an id are
found like others and give rows with a null; repeated items or documents give the same row once; ties between runs go to
the first place in the item, then in the document; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirworks.sources.workdir import written

from .exchange import release
from .words import Powers, U, grams, mix, pieces, signed

TILE = 5
COVERAGE = 0.5
BLOCK_WORDS = 2_000_000


@F.arrow_udf(T.StructType().add("words", T.BinaryType()).add("seeds", T.ArrayType(T.LongType())))
def _item(texts: pa.Array) -> pa.Array:
    rows = []
    for low, high, w in pieces(texts):
        for i in range(high - low):
            own = w.hash[w.ptr[i]:w.ptr[i + 1]]
            rows.append({"words": own.tobytes(), "seeds": signed(np.unique(grams(own, TILE))).tolist()})
    return pa.array(rows, pa.struct([("words", pa.binary()), ("seeds", pa.list_(pa.int64()))]))


def _covered(batches: Iterator[pa.RecordBatch], seeds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(doc_id, words, seeds) of texts that hold a seed; 0 parts the runs of covered words."""
    quick = np.zeros(1 << 16, bool)
    quick[(seeds >> U(48)).astype(np.int64)] = True
    for batch in batches:
        ids, kept, found = [], [], []
        for low, high, w in pieces(batch.column(1)):
            runs = grams(w.hash, TILE)
            at = np.flatnonzero(quick[(runs >> U(48)).astype(np.int64)])
            near = np.minimum(np.searchsorted(seeds, runs[at]), len(seeds) - 1)
            at = at[seeds[near] == runs[at]]
            text = np.searchsorted(w.ptr, at, "right") - 1
            at, text = at[at + TILE <= w.ptr[text + 1]], text[at + TILE <= w.ptr[text + 1]]
            for i in np.unique(text):
                own = at[text == i]
                inside = np.zeros(w.ptr[i + 1] - w.ptr[i], bool)
                for k in range(TILE):
                    inside[own - w.ptr[i] + k] = True
                words = np.where(inside, w.hash[w.ptr[i]:w.ptr[i + 1]], U(0))
                words = words[inside | np.append(False, inside[:-1])]
                ids.append(batch.column(0)[low + int(i)])
                kept.append(words.tobytes())
                found.append(signed(np.unique(runs[own])))
        yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(kept, pa.binary()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "words", "seeds"])
        release()


class Runs:
    """The words of a text and Karp-Rabin numbers of its runs: with sums of words times powers of a base, the number of
    a run of any length is one difference, brought to a common power."""
    def __init__(self, words: np.ndarray):
        Powers.reach(len(words) + 1)
        self.words = words
        self.sums = np.zeros(len(words) + 1, U)
        np.cumsum(mix(words) * Powers.up[:len(words)], out=self.sums[1:])

    def numbers(self, n: int) -> np.ndarray:
        """The number of each run of n words, in order."""
        m = len(self.words) - n + 1
        return (self.sums[n:] - self.sums[:m]) * Powers.down[:m] if m > 0 else np.zeros(0, U)


def _common(runs_a: Runs, runs_b: Runs, a: np.ndarray, b: np.ndarray, n: int) -> tuple[int, int] | None:
    """The first place in a, and the first in b, where the same n unmarked words stand; marked words are 0."""
    ga, gb = runs_a.numbers(n), runs_b.numbers(n)
    if not len(ga) or not len(gb):
        return None
    fine_a, fine_b = _whole(a, n), _whole(b, n)
    hits = np.flatnonzero(fine_a & np.isin(ga, gb[fine_b]))
    for i in hits:
        for j in np.flatnonzero(fine_b & (gb == ga[i])):
            if (a[i:i + n] == b[j:j + n]).all():
                return int(i), int(j)
    return None


def _whole(a: np.ndarray, n: int) -> np.ndarray:
    gaps = np.concatenate([[0], np.cumsum(a == 0)])
    return gaps[n:] == gaps[:-n]


def tiles(item: bytes, words: bytes, least: int = TILE) -> tuple[int, int, int]:
    """(covered words of the item, tiles, longest tile) by greedy string tiling."""
    a, b = np.frombuffer(item, U).copy(), np.frombuffer(words, U).copy()
    runs_a, runs_b = Runs(a.copy()), Runs(b.copy())       # of the words as they were: marks only rule runs out
    covered = count = longest = 0
    high = min(len(a), len(b))
    while True:
        size, spot, low, top, n = 0, None, least, high, high     # the whole length first: one passage is the usual case
        while low <= n <= top:
            if (found := _common(runs_a, runs_b, a, b, n)) is None:
                top = n - 1
            else:
                size, spot, low = n, found, n + 1
            n = (low + top + 1) // 2
        if spot is None:
            break
        a[spot[0]:spot[0] + size] = 0
        b[spot[1]:spot[1] + size] = 0
        covered, count, longest, high = covered + size, count + 1, max(longest, size), size
    return covered, count, longest


@F.arrow_udf(T.StructType().add("covered", T.IntegerType()).add("tiles", T.IntegerType()).add("longest", T.IntegerType()))
def _tiled(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    names = ("covered", "tiles", "longest")
    known: dict[tuple[bytes, bytes], dict[str, int]] = {}       # a passage often comes back; emptied when full
    for items, words in batches:
        rows = []
        for pair in zip(items.to_pylist(), words.to_pylist(), strict=True):
            if pair not in known:
                if len(known) >= 1000:
                    known.clear()
                known[pair] = dict(zip(names, tiles(*pair), strict=True))
            rows.append(known[pair])
        yield pa.array(rows, pa.struct([(n, pa.int32()) for n in names]))


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, coverage, tiles, longest): the pairs whose coverage reaches the threshold."""
    spark = docs.sparkSession
    items = written(benchmark.where("text IS NOT NULL").select("item_id", _item("text").alias("x")).select(
        "item_id", "x.words", "x.seeds", (F.octet_length("x.words") / 8).cast("long").alias("n")).where(F.col("n") >= TILE).distinct().withColumn(
        "item_row", F.monotonically_increasing_id()), "tiling-items")
    total = items.agg(F.sum("n")).first()[0] or 0
    blocks, out = -(-total // BLOCK_WORDS), None
    kinds = dict(docs.dtypes)["doc_id"]
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_row"), F.lit(blocks)) == k)
        seeds = np.sort(np.array([r[0] for r in block.select(F.explode("seeds")).distinct().collect()], np.int64).view(U))
        if not len(seeds):
            continue
        kept = written(docs.where("text IS NOT NULL").select("doc_id", "text").mapInArrow(
            lambda batches, seeds=seeds: _covered(batches, seeds), f"doc_id {kinds}, words binary, seeds array<bigint>").withColumn("row", F.monotonically_increasing_id()), "tiling-words")
        shared = kept.select("row", F.explode("seeds").alias("seed")).join(block.select("item_row", F.explode("seeds").alias("seed")), "seed")
        pairs = shared.select("row", "item_row").distinct().join(kept.select("row", "doc_id", "words"), "row")
        pairs = pairs.join(block.select("item_row", "item_id", F.col("words").alias("item"), "n"), "item_row")
        rows = pairs.select("doc_id", "item_id", "n", _tiled("item", "words").alias("t"))
        rows = rows.select("doc_id", "item_id", (F.col("t.covered") / F.col("n")).alias("coverage"), "t.tiles", "t.longest").where(F.col("coverage") >= coverage)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return spark.createDataFrame([], f"doc_id {kinds}, item_id {dict(benchmark.dtypes)['item_id']}, coverage double, tiles int, longest int")
    return out.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("coverage", "tiles", "longest")])
