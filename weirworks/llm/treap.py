"""Ranked lexical search in K2-treaps over the grid of terms and documents.

Documents are indexed in blocks of at most ``BLOCK_TERMS`` terms and ``BLOCK_DOCS`` documents (a longer document is a block
of its own). A block's grid has a row for each of its terms, frequent ones first, and a column for each document; a
point carries the term's impact there. The grid is a quadtree: a cell that holds a point stores which of its four
quadrants do, as bits in level order, and the largest impact inside, as the difference from its parent's. Two cells of a
thousand empty ones cost nothing, and rank over the bits leads from a cell to its quadrants.

A search descends document ranges best first: a range's bound adds up, over the item's terms, weight times the largest
impact of the cell where the term's row path meets the range. Ranges whose bound is below the score of the item's
``k``-th best document so far are never opened, and ranges of one document carry its exact score. A task keeps each
item's best documents over all its blocks; windows that trim before they shuffle put the tasks' lists together.

Terms are runs of ASCII letters and digits and all other characters beyond ASCII; only A-Z folds. They are known by 64-bit
hashes. A null or empty text, of a document or an item, has no terms: it is in the index, but neither found nor counted.
Equal scores go by ascending doc_id, those without an id last; repeated documents are ranked one by one, and so are
repeated items, each row by itself. Empty tables give no rows. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirworks.sources.workdir import written

from .words import U, pieces, signed

TOP = 20
BLOCK_TERMS = 1_500_000
BLOCK_DOCS = 1 << 13
ITEM_TERMS = 100_000         # (item, term) pairs of a block of items; all documents meet every block
RANGES = 64                  # document ranges of a block that all items start from
OPENED = 128                 # ranges opened at once
INDEX = "doc_ids array<bigint>, terms binary, rows binary, counts binary, levels array<int>, cells binary, maxima binary"
FOUND = "item long, doc_id long, score long"


# --- statistics ------------------------------------------------------------------------------------------------------

def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, documents = 0, 0
        for _, _, w in pieces(batch.column(0), letters=True):
            n = w.counts()
            total, documents = total + int(n.sum()), documents + int((n > 0).sum())
        yield pa.RecordBatch.from_arrays([pa.array([documents], pa.int64()), pa.array([total], pa.int64())], ["documents", "terms"])


def statistics(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all terms with repeats."""
    row = docs.select("text").mapInArrow(_lengths, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


# --- the index -------------------------------------------------------------------------------------------------------

def _spread(x: np.ndarray) -> np.ndarray:
    """Put a zero bit before each bit of 32-bit numbers."""
    x = x.astype(U)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << U(shift))) & U(mask)
    return x


def _narrow(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.astype("<u4").tobytes())


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<u4")


class Tree:
    """A K2-treap. Node 0 is the empty cell, node 1 the whole grid; nodes are numbered in level order."""
    def __init__(self, height: int, bits: np.ndarray, values: np.ndarray):
        self.height, self.values = height, values
        self.child = np.where(bits, np.cumsum(bits, dtype=np.int32) + 1, 0).astype(np.int32)

    @staticmethod
    def pack(rows: np.ndarray, columns: np.ndarray, impact: np.ndarray) -> tuple[list[int], bytes, bytes]:
        """(cells on each level, quadrant bits, maxima) of distinct points."""
        height = max(1, int(rows.max(initial=0)).bit_length(), int(columns.max(initial=0)).bit_length())
        code = (_spread(rows) << U(1)) | _spread(columns)
        order = np.argsort(code)
        code, top = code[order], impact[order]
        cells, falls, levels = [], [], [len(code)]
        for _ in range(height):
            above = code >> U(2)
            first = np.flatnonzero(np.append(True, above[1:] != above[:-1]))
            largest = np.maximum.reduceat(top, first)
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(code))))
            quadrants = np.zeros(4 * len(first), bool)
            quadrants[4 * group + (code & U(3)).astype(np.int64)] = True
            cells.append(quadrants)
            falls.append(largest[group] - top)
            code, top = above[first], largest
            levels.append(len(code))
        bits = np.concatenate(cells[::-1])
        return levels[::-1], zstandard.ZstdCompressor(level=1).compress(np.packbits(bits).tobytes()), _narrow(np.concatenate([top, *falls[::-1]]))

    @classmethod
    def unpack(cls, levels: list[int], cells: bytes, maxima: bytes) -> Tree:
        inner = sum(levels[:-1])
        bits = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(cells), np.uint8), count=4 * inner).astype(bool)
        falls = _wide(maxima).astype(np.int64)
        values = np.zeros(len(falls) + 1, np.int64)
        values[1], at, node = falls[0], 0, 1
        for k in range(1, len(levels)):
            size = bits[4 * at:4 * (at + levels[k - 1])].reshape(-1, 4).sum(1)
            start = node + levels[k - 1]
            values[start:start + levels[k]] = np.repeat(values[node:node + levels[k - 1]], size) - falls[start - 1:start - 1 + levels[k]]
            at, node = at + levels[k - 1], start
        return cls(len(levels) - 1, np.concatenate([np.zeros(4, bool), bits]), values)

    def open(self, nodes: np.ndarray, rows: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cells where row paths meet the left and the right half of each range; nodes are rows x ranges."""
        at = 4 * nodes + 2 * ((rows[:, None] >> (self.height - 1 - level)[None, :]) & 1)
        return self.child[at], self.child[at + 1]

    def start(self, rows: np.ndarray, documents: int) -> tuple[int, np.ndarray]:
        """The level on which the columns are ``RANGES`` ranges or a few more, and each row's cells there (rows x ranges)."""
        nodes, level = np.ones((len(rows), 1), np.int64), 0
        while level < self.height and nodes.shape[1] < RANGES:
            both = np.stack(self.open(nodes, rows, np.full(nodes.shape[1], level)), 2).reshape(len(rows), -1)
            level += 1
            nodes = both[:, :max(1, -(-documents >> (self.height - level)))]
        return level, nodes


def _indexed(ids: list, words: np.ndarray, lengths: np.ndarray, documents: int, terms: int) -> pa.RecordBatch | None:
    """A block's row: its terms with their rows and counts of documents, and the tree over its points."""
    names, row = np.unique(words, return_inverse=True)
    if not len(names):
        return None
    column = np.repeat(np.arange(len(lengths)), lengths)
    points, tf = np.unique(row * len(lengths) + column, return_counts=True)
    row, column = points // len(lengths), points % len(lengths)
    counts = np.bincount(row, minlength=len(names))
    place = np.empty(len(names), np.int64)
    place[np.argsort(-counts, kind="stable")] = np.arange(len(names))
    m = 100 - 25 + (25 * lengths * documents) // terms
    impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[column])
    levels, cells, maxima = Tree.pack(place[row], column, impact)
    return pa.RecordBatch.from_arrays(
        [pa.array([ids], pa.list_(pa.int64())), pa.array([names.tobytes()], pa.binary()), pa.array([_narrow(place)], pa.binary()),
         pa.array([_narrow(counts)], pa.binary()), pa.array([levels], pa.list_(pa.int32())), pa.array([cells], pa.binary()), pa.array([maxima], pa.binary())],
        [c.split()[0] for c in INDEX.split(", ")])


def _build(batches: Iterator[pa.RecordBatch], documents: int, terms: int) -> Iterator[pa.RecordBatch]:
    ids, words, lengths, held = [], [], [], 0

    def block():
        made = _indexed(ids, np.concatenate(words), np.array(lengths, np.int64), documents, terms) if words else None
        return [made] if made is not None else []

    for batch in batches:
        for low, _, w in pieces(batch.column(1), letters=True):
            for i, n in enumerate(w.counts().tolist()):
                if ids and (held + n > BLOCK_TERMS or len(ids) >= BLOCK_DOCS):
                    yield from block()
                    ids, words, lengths, held = [], [], [], 0
                ids.append(batch.column(0)[low + i].as_py())
                words.append(w.hash[w.ptr[i]:w.ptr[i + 1]].copy())
                lengths.append(n)
                held += n
    yield from block()


def build_index(docs: DataFrame) -> tuple[DataFrame, int]:
    """The written index of all ``docs`` (doc_id, text), and how many of them have a term."""
    documents, terms = statistics(docs)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(own.mapInArrow(lambda batches: _build(batches, documents, terms), INDEX), "treaps"), documents


# --- the search ------------------------------------------------------------------------------------------------------

@F.arrow_udf(T.StructType().add("terms", T.ArrayType(T.LongType())).add("times", T.ArrayType(T.LongType())))
def _item_terms(texts: pa.Array) -> pa.Array:
    rows = []
    for low, high, w in pieces(texts, letters=True):
        for i in range(high - low):
            terms, times = np.unique(w.hash[w.ptr[i]:w.ptr[i + 1]], return_counts=True)
            rows.append({"terms": signed(terms).tolist(), "times": times.tolist()})
    return pa.array(rows, pa.struct([("terms", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))]))


def _rows_of(block: dict, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each wanted term of a block: where it is in ``wanted``, and where among the block's terms."""
    names = np.frombuffer(block["terms"], U)
    at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
    here = np.flatnonzero(names[at] == wanted)
    return here, at[here]


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i].as_py() if name != "doc_ids" else batch.column(k)[i].values for k, name in enumerate(batch.schema.names)}


def _frequencies(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    for block in _each(batches):
        here, at = _rows_of(block, wanted)
        yield pa.RecordBatch.from_arrays([pa.array(here), pa.array(_wide(block["counts"])[at].astype(np.int64))], ["term", "df"])


def best(tree: Tree, rows: np.ndarray, weights: np.ndarray, level: int, nodes: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """(columns, scores) of all documents that may be among the best ``k``, given that ``k`` others reach ``floor``.

    Ranges are opened best first, ``OPENED`` at once; what is below the k-th best score found is left closed.
    """
    column, levels = np.arange(nodes.shape[1]), np.full(nodes.shape[1], level)
    bound = weights @ tree.values[nodes]
    columns, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    while True:
        open_ = bound >= max(floor, 1)
        column, levels, bound, nodes = column[open_], levels[open_], bound[open_], nodes[:, open_]
        whole = levels == tree.height
        if whole.any():
            columns, scores = np.append(columns, column[whole]), np.append(scores, bound[whole])
            if len(scores) >= k:
                floor = max(floor, int(np.partition(scores, -k)[-k]))
                columns, scores = columns[scores >= floor], scores[scores >= floor]
            stay = ~whole & (bound >= floor)
            column, levels, bound, nodes = column[stay], levels[stay], bound[stay], nodes[:, stay]
        if not len(bound):
            return columns, scores
        first = np.zeros(len(bound), bool)
        first[np.argpartition(-bound, OPENED)[:OPENED] if len(bound) > OPENED else slice(None)] = True
        left, right = tree.open(nodes[:, first], rows, levels[first])
        opened = np.concatenate([left, right], 1)
        column = np.concatenate([column[~first], 2 * column[first], 2 * column[first] + 1])
        levels = np.concatenate([levels[~first], levels[first] + 1, levels[first] + 1])
        bound = np.append(bound[~first], weights @ tree.values[opened])
        nodes = np.concatenate([nodes[:, ~first], opened], 1)


class Items:
    """A block of items: item i has the terms ``ptr[i]`` to ``ptr[i + 1]`` of ``term`` (numbers in ``wanted``)."""
    def __init__(self, rows: list):
        self.number = np.array([r["item"] for r in rows], np.int64)
        self.ptr = np.append(0, np.cumsum([len(r["terms"]) for r in rows])).astype(np.int64)
        terms = np.array([t for r in rows for t in r["terms"]], np.int64).view(U)
        self.times = np.array([t for r in rows for t in r["times"]], np.int64)
        self.wanted, self.term = np.unique(terms, return_inverse=True)

    def weigh(self, documents: int, df: np.ndarray) -> None:
        w = np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)
        self.weights = w[self.term] * self.times


def _search(batches: Iterator[pa.RecordBatch], items: Items, k: int) -> Iterator[pa.RecordBatch]:
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * len(items.number)
    for block in _each(batches):
        here, at = _rows_of(block, items.wanted)
        if not len(here):
            continue
        ids, place = block["doc_ids"], _wide(block["rows"]).astype(np.int64)
        tree = Tree.unpack(block["levels"], block["cells"], block["maxima"])
        rows = np.full(len(items.wanted), -1, np.int64)
        rows[here] = np.arange(len(here))
        level, nodes = tree.start(place[at], len(ids))
        own, none = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
        for i in range(len(items.number)):
            span = slice(items.ptr[i], items.ptr[i + 1])
            term = rows[items.term[span]]
            use = (term >= 0) & (items.weights[span] > 0)
            term = term[use]
            if not len(term):
                continue
            docs, nulls, scores = kept[i]
            floor = int(scores[-1]) if len(scores) >= k else 0
            columns, found = best(tree, place[at][term], items.weights[span][use], level, nodes[term], k, floor)
            if len(columns):
                docs, nulls, scores = np.append(docs, own[columns]), np.append(nulls, none[columns]), np.append(scores, found)
                order = np.lexsort((docs, nulls, -scores))[:k]
                kept[i] = docs[order], nulls[order], scores[order]
    item = np.repeat(items.number, [len(s) for _, _, s in kept])
    docs, nulls, scores = (np.concatenate([x[c] for x in kept]) if kept else np.zeros(0) for c in range(3))
    yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(docs, pa.int64(), mask=nulls.astype(bool)), pa.array(scores, pa.int64())],
                                     ["item", "doc_id", "score"])


def search_index(index: DataFrame, documents: int, items: DataFrame, k: int = TOP) -> DataFrame:
    """The best ``k`` documents of each row of ``items`` (item_id, text): item_id, rank, doc_id, score.

    Items go through in blocks of about ``ITEM_TERMS`` terms, so what is broadcast is bounded whatever their number.
    """
    spark = index.sparkSession
    numbered = written(items.select("item_id", _item_terms("text").alias("t")).select(
        F.monotonically_increasing_id().alias("item"), "item_id", "t.*"), "items")
    total = numbered.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-int(total) // ITEM_TERMS)
    own, parts = numbered.where(F.size("terms") > 0).withColumn("part", F.pmod(F.xxhash64("item"), F.lit(max(blocks, 1)))), []
    for number in range(blocks):
        block = Items(own.where(F.col("part") == number).select("item", "terms", "times").collect())
        if not len(block.number):
            continue
        wanted = block.wanted
        counted = index.select("terms", "counts").mapInArrow(lambda batches, wanted=wanted: _frequencies(batches, wanted), "term long, df long")
        df = np.zeros(len(wanted), np.int64)
        for r in counted.groupBy("term").agg(F.sum("df").alias("df")).collect():
            df[r["term"]] = r["df"]
        block.weigh(documents, df)
        found = index.mapInArrow(lambda batches, block=block: _search(batches, block, k), FOUND)
        parts.append(written(_trimmed(_trimmed(found, k, [F.pmod(F.xxhash64("doc_id", "score"), F.lit(64))]), k, []), "found"))
    if not parts:
        return spark.createDataFrame([], items.select("item_id").schema).selectExpr("item_id", "CAST(NULL AS int) AS rank", "CAST(NULL AS long) AS doc_id", "CAST(NULL AS long) AS score")
    ranked = parts[0]
    for part in parts[1:]:
        ranked = ranked.unionByName(part)
    ranked = ranked.withColumn("rank", F.row_number().over(_order("item")))
    return ranked.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _order(*keys):
    return Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))


def _trimmed(found: DataFrame, k: int, salt: list) -> DataFrame:
    """The best ``k`` rows of each item, or of each salted part of it; the window trims before the shuffle, too."""
    salted = found.withColumn("_salt", salt[0]) if salt else found
    keys = ["item", "_salt"] if salt else ["item"]
    return salted.withColumn("_rank", F.row_number().over(_order(*keys))).where(F.col("_rank") <= k).select("item", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """Index all ``docs`` (doc_id, text) and rank them for each of ``items`` (item_id, text)."""
    index, documents = build_index(docs)
    return search_index(index, documents, items, k)
