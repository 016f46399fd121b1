"""Exact Jaccard self-join on word shingles by partitions of the universe.

A document is the set of its distinct shingles. Equal sets are one class. Sets whose sizes fall in one band, or in the
band below and within reach of it, are cut by one hash into the band's m segments, m more than the shingles in which
two linked sets of the band can differ: by the pigeonhole principle linked sets agree on a whole segment. Each set puts
the number of every segment into the index, and sets that share one are candidates. Segments without a shingle are equal
in any two sets, so a set with more segments that hold one than it can differ by leaves the empty ones out: it agrees with
a linked set on one that is not empty. A few segments are added for this.

Candidates are taken in an order that keeps large groups cheap. First every set of a shared segment is compared with the
best connected class there, and the links found are closed to components; what stays open are pairs of one segment in different
components. A segment whose open pairs cost more than the one-deletion neighbourhoods of its members is not paired: its
members go to a second index of about half as many segments, where each set enters every segment whole and with each
single shingle left out. Linked sets differ by at most one shingle in some segment there, so a whole segment meets a
whole one or a neighbourhood, and accidental matches are far rarer, as these segments are twice as large. The neighbourhoods
are asked for as keys of batches of documents, and only entries that meet another one become rows. Every candidate
is verified on the whole shingle sets. All of it is exact, up to equality of 64-bit shingle numbers.

Null texts and texts without words are empty sets, linked with nothing; fewer words than a shingle make one shingle; a
repeated row is a document with an equal set; ties go to the smallest id; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirworks.operators.joins import fits_broadcast
from weirworks.sources.workdir import discard, written

from .exchange import asked, batched, each_row, joined, release, several, slices, unpack_rows, values
from .graph import components
from .words import U, grams, mix, pieces, signed

RATIO = 1.3       # of the largest to the smallest size of a band
SKETCH = 512      # bits of a parity sketch at least
BATCH = 2_000_000          # bytes of text in a batch of the first index
NEAR_BATCH = 750_000       # and of the second, where a text asks for several times as many keys:
NEAR_SLICES = 8            # its key space is cut into so many times more slices


class Bands:
    """Sizes by band: a band's largest set, its segments, and the smallest set below it that can link into it."""
    def __init__(self, percent: int):
        self.percent = percent

    def of(self, size: int) -> list[int]:
        """The bands that a set takes part in: its own, and the next one if that is within reach."""
        band = int(math.floor(math.log(size) / math.log(RATIO) + 1e-9))
        while self.low(band + 1) <= size:
            band += 1
        while self.low(band) > size:
            band -= 1
        return [band] + [band + 1] * (100 * size >= self.percent * self.low(band + 1))

    @staticmethod
    def low(band: int) -> int:
        return math.ceil(RATIO ** band - 1e-9)

    def differ(self, band: int) -> int:
        """In how many shingles at most linked sets differ, neither larger than the band allows."""
        return 2 * (self.low(band + 1) - 1) * (100 - self.percent) // (100 + self.percent)

    def reach(self, band: int, size: int) -> int:
        """In how many shingles at most a set of this size differs from a linked one of the band."""
        largest = min(self.low(band + 1) - 1, 100 * size // self.percent)
        return (size + largest) * (100 - self.percent) // (100 + self.percent)

    def segments(self, band: int) -> int:
        """More than the differences by the segments that the band's largest sets are likely to leave empty."""
        m = self.differ(band) + 1
        empty = m * math.exp(-(self.low(band + 1) - 1) / m)
        return m + int(empty + 2 * math.sqrt(empty))

    def halves(self, band: int) -> int:
        """Segments of the one-deletion index: two credits each reach the differences plus one."""
        return self.differ(band) // 2 + 1


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """The distinct shingles of a word sequence, sorted."""
    return np.unique(grams(words, min(width, len(words)))) if len(words) else np.zeros(0, U)


def _segment_sums(s: np.ndarray, m: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The segment of each shingle, and each segment's number (0 if it is empty)."""
    at = (mix(s ^ U(seed)) % U(m)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(s + U(seed))[order], dtype=U)])
    cuts = np.searchsorted(at[order], np.arange(m + 1))
    return at, total[cuts[1:]] - total[cuts[:-1]]


def _named(numbers: np.ndarray, band: int, segment: np.ndarray) -> np.ndarray:
    return mix(numbers + mix(segment.astype(U) * U(0x9E3779B97F4A7C15) + U(band + 1)))


def signatures(s: np.ndarray, bands: Bands) -> np.ndarray:
    out = []
    for band in bands.of(len(s)):
        m = bands.segments(band)
        at, sums = _segment_sums(s, m, 1)
        held = np.unique(at)
        kept = held if len(held) > bands.reach(band, len(s)) else np.arange(m)
        out.append(_named(sums[kept], band, kept))
    return np.concatenate(out)


def neighbourhoods(s: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(whole segments, segments with one shingle left out) of the one-deletion index."""
    whole, less = [], []
    for band in bands.of(len(s)):
        m = bands.halves(band)
        at, sums = _segment_sums(s, m, 2)
        whole.append(_named(sums, band, np.arange(m)))
        less.append(_named(sums[at] - mix(s + U(2)), band, at))
    return np.concatenate(whole), np.concatenate(less)


def odd_sketch(s: np.ndarray, percent: int) -> np.ndarray:
    """The parity of the shingles that fall on each bit, as longs: two sets differ in at least as many shingles as their
    sketches differ in bits. A sketch has four bits for each shingle in which linked sets may differ, ``SKETCH`` at least,
    rounded up to a power of two: halves laid over each other make the sketch of half the bits."""
    size = SKETCH
    while size < 8 * len(s) * (100 - percent) // (100 + percent):
        size *= 2
    bits = np.bincount((mix(s ^ U(0x0DD)) & U(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _close(x: str, y: str, n: Column, percent: int) -> Column:
    """Whether two sketches leave it open that their sets, of n shingles together, are linked."""
    k = F.least(F.size(x), F.size(y))
    half = lambda v: F.when(F.size(v) == k, F.col(v)).otherwise(F.zip_with(F.slice(v, F.lit(1), k), F.slice(v, k + 1, k), lambda a, b: a.bitwiseXOR(b)))
    bits = F.aggregate(F.zip_with(half(x), half(y), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, b: total + b)
    return bits * (100 + percent) <= n * (100 - percent)


def _carriers(row: dict, width: int, bands: Bands) -> Iterator[tuple[int, int, int, int, np.ndarray, np.ndarray | None]]:
    """(doc_id, size, two numbers of the set, set, signatures) of a batch's texts; of equal sets only the one with the
    smallest id has signatures."""
    docs = unpack_rows(row["docs"])
    found, least = [], {}
    for low, high, w in pieces(docs.column(1)):
        for i in range(high - low):
            s = shingles(w.hash[w.ptr[i]:w.ptr[i + 1]], width)
            key = (len(s), int(mix(s).sum(dtype=U)), int(mix(s ^ U(0x1234567)).sum(dtype=U)))
            doc = docs.column(0)[low + i].as_py()
            found.append((doc, key, s))
            if len(s) and doc is not None and doc < least.get(key, doc + 1):
                least[key] = doc
    for doc, key, s in found:
        first = doc is not None and least.get(key) == doc
        if first:
            del least[key]
        yield doc, *key, s, signatures(s, bands) if first else None


def _distinct(carriers: list) -> tuple[np.ndarray, np.ndarray]:
    own = [sigs for *_, sigs in carriers if sigs is not None]
    found, count = np.unique(np.concatenate(own) if own else np.zeros(0, U), return_counts=True)
    return found, count.astype(np.uint32)[:, None]


def _ask(width: int, percent: int):
    return lambda row: [_distinct(list(_carriers(row, width, Bands(percent))))]


def _sets(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """doc_id, n, two numbers that name the set; for carriers the signatures that others share, and a sketch if any is."""
    signed_number = lambda x: x - (1 << 64) if x >> 63 else x
    for row in each_row(batches):
        carriers = list(_carriers(row, width, Bands(percent)))
        keys, again = _distinct(carriers)[0], values(row, 0, 1)[:, 0].astype(bool)
        columns: list[list] = [[] for _ in range(6)]
        for doc, n, one, two, s, sigs in carriers:
            shared = sigs[again[np.searchsorted(keys, sigs)]] if sigs is not None else np.zeros(0, U)
            some = len(shared) > 0
            for column, value in zip(columns, (doc, n, signed_number(one), signed_number(two), signed(np.unique(shared)) if some else None, odd_sketch(s, percent) if some else None), strict=True):
                column.append(value)
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n", "one", "two", "sigs", "odd"])


def _near(row: dict, width: int, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, whole segments, segments with one shingle left out) of a batch's texts, each distinct and sorted."""
    docs = unpack_rows(row["docs"])
    for low, high, w in pieces(docs.column(1)):
        for i in range(high - low):
            whole, less = neighbourhoods(shingles(w.hash[w.ptr[i]:w.ptr[i + 1]], width), Bands(percent))
            yield low + i, np.unique(whole), np.unique(less)


def _ask_near(width: int, percent: int):
    def ask(row: dict) -> list[tuple[np.ndarray, np.ndarray]]:
        near = list(_near(row, width, percent))
        whole, less = (np.concatenate([x[k] for x in near] or [np.zeros(0, U)]) for k in (1, 2))
        keys, at = np.unique(np.concatenate([whole, less]), return_inverse=True)
        return [(keys, np.stack([np.bincount(at[:len(whole)], minlength=len(keys)), np.bincount(at, minlength=len(keys))], 1).astype(np.uint32))]
    return ask


def _met(stream: int, keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, list]:
    """Whether a whole segment and another entry have a key."""
    return ((sums[:, 0] > 0) & (sums[:, 1] > 1))[:, None], []


def _entries(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """The entries of the one-deletion index that meet another: sig, node, n, label, whole."""
    for row in each_row(batches):
        docs, near = unpack_rows(row["docs"]), list(_near(row, width, percent))
        keys, met = np.unique(np.concatenate([x for _, *both in near for x in both] or [np.zeros(0, U)])), values(row, 0, 1)[:, 0].astype(bool)
        kept = [(i, [x[met[np.searchsorted(keys, x)]] for x in both]) for i, *both in near]
        sigs = np.concatenate([x for _, both in kept for x in both] or [np.zeros(0, U)])
        at = np.repeat(np.array([i for i, _ in kept], np.int64), [len(a) + len(b) for _, (a, b) in kept])
        whole = np.concatenate([np.repeat([True, False], [len(a), len(b)]) for _, (a, b) in kept] or [np.zeros(0, bool)])
        yield pa.RecordBatch.from_arrays([pa.array(signed(sigs)), *(docs.column(c).take(pa.array(at)) for c in (0, 2, 3)), pa.array(whole, pa.bool_())],
                                         ["sig", "node", "n", "label", "whole"])


def _second_index(open_: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The stored entries of the one-deletion index for classes (node, n, label) that meet others.

    Entries are asked for as keys of batches, so that the many that meet nothing never become rows.
    """
    rows = open_.select(F.col("node").alias("doc_id"), "n", "label")
    rows = texts.join(F.broadcast(rows) if fits_broadcast(rows) else rows, "doc_id").select("doc_id", "text", "n", "label")
    table = batched(rows, NEAR_BATCH)
    answers = asked(table, _ask_near(width, percent), _met, 1, 0, NEAR_SLICES * slices(table))
    out = written(joined(table, answers).select("docs", "answers").mapInArrow(
        lambda b: _entries(b, width, percent), "sig long, node long, n long, label long, whole boolean"), "neighbourhoods")
    discard(table, answers)
    return out


def _packed(column: str, width: int) -> Column:
    @F.arrow_udf("array<bigint>")
    def packed(column: pa.Array) -> pa.Array:
        out = []
        for low, high, w in pieces(column):
            out += [signed(shingles(w.hash[w.ptr[i]:w.ptr[i + 1]], width)) for i in range(high - low)]
        made = pa.array(out, pa.list_(pa.int64()))
        del out
        release()
        return made
    return packed(column)


def _set_rows(texts: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, set) of some documents, from their whole texts. A short list of ids goes to the texts; with a longer one
    both sides are shuffled."""
    wanted = nodes.select(F.col("node").alias("doc_id")).distinct()
    wanted = F.broadcast(wanted) if fits_broadcast(wanted) else wanted
    return texts.join(wanted, "doc_id", "left_semi").select(F.col("doc_id").alias("node"), _packed("text", width).alias("set"))


def _folded(odd: Column) -> Column:
    """A sketch laid over itself down to ``SKETCH`` bits."""
    longs = SKETCH // 64
    part = lambda k: F.aggregate(F.filter(odd, lambda _, i: i % longs == k), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseXOR(b))
    return F.when(F.size(odd) == longs, odd).otherwise(F.array(*[part(k) for k in range(longs)]))


def _plausible(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes whose sketches leave it open that they are linked."""
    side = lambda x: marks.select(F.col("node").alias(x), F.col("n").alias("n" + x), F.col("odd").alias("odd" + x))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(_close("odda", "oddb", F.col("na") + F.col("nb"), percent)).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The stored pairs (a, b) of classes that link: 100 * intersection >= percent * union on the whole sets."""
    sets = written(_set_rows(texts, pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))), width), "shingles")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    both = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).cast("long").alias("same"))
    return both.where((100 + percent) * F.col("same") >= percent * (F.col("na") + F.col("nb"))).select("a", "b")


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90, margin: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id per row of ``docs`` (doc_id, text): the smallest doc_id that links reach.

    ``margin`` is what a row of the one-deletion index costs besides its shingles; it moves work, never results.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = batched(texts, BATCH)
    shared = asked(table, _ask(width, percent), several, 1, 0)
    found = written(joined(table, shared).select("docs", "answers").mapInArrow(
        lambda b: _sets(b, width, percent), "doc_id long, n long, one long, two long, sigs array<bigint>, odd array<bigint>"), "sets")
    discard(table, shared)
    # a stored table, so that the skew join can split a set that very many documents have
    classes = written(found.where("n > 0").groupBy("n", "one", "two").agg(F.min("doc_id").alias("node")), "set-classes")
    members = written(found.select("doc_id", "n", "one", "two").join(classes, ["n", "one", "two"], "left").select(
        "doc_id", "n", F.when(F.col("n") > 0, F.col("node")).otherwise(F.col("doc_id")).alias("node")), "classes")
    firsts = members.where("n > 0 AND doc_id = node").select("node").distinct()
    index = found.where("sigs IS NOT NULL").select(F.col("doc_id").alias("node"), "n", "sigs").join(firsts, "node", "left_semi").select("node", "n", F.explode("sigs").alias("sig")).distinct()
    held = written(index.join(index.groupBy("sig").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sig"), "segments")
    # the centre of a segment is the class that shares most segments with most others: copies link to what they come from
    weight = held.groupBy("node").agg(F.sum("size").alias("weight"))
    centres = held.join(weight, "node").groupBy("sig").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("b"))
    fits = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)
    sizes = held.select(F.col("node").alias("b"), F.col("n").alias("nb")).distinct()
    marks = found.where("odd IS NOT NULL").select(F.col("doc_id").alias("node"), "n", "odd").join(held.select("node").distinct(), "node", "left_semi")
    stars = written(_plausible(held.join(centres, "sig").where("node <> b").select(F.col("node").alias("a"), "n", "b").distinct().join(sizes, "b").where(fits(F.col("n"), F.col("nb"))).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), marks, percent), "stars")
    links = written(_verified(stars, texts, width, percent), "star-links")
    closed = written(components(links), "star-components")
    links = links.unionByName(_open_links(held, closed, stars, marks, texts, width, percent, margin, fits))
    final = components(written(links, "all-links"))
    out = members.join(final, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))


def _tops(rows: DataFrame) -> DataFrame:
    """Segments (sig) with several components: the one with most rows, and how many rows there are and lie outside it."""
    by = rows.groupBy("sig", "label").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("size"))
    return by.groupBy("sig").agg(F.max_by("label", F.struct("k", "label")).alias("top"), F.count(F.lit(1)).alias("labels"), (F.sum("k") - F.max("k")).alias("outside"),
                                 (F.sum("size") / F.sum("k")).alias("mean")).where("labels > 1").drop("labels")


def _cross(rows: DataFrame, percent: int, fits) -> DataFrame:
    """Pairs (a > b) of different components in one segment, one of them a whole segment. Rows of the largest component
    are met by the others only, so a large group that is closed already is not paired with itself; two of the others meet
    once; pairs whose parity sketches show that they differ too much to be linked do not leave the join."""
    side = lambda x, d: d.select("sig", *[F.col(c).alias(c + x) for c in ("node", "n", "label", "whole", "odd", "top")])
    first, *rest = [F.bit_count(F.col("oddx")[k].bitwiseXOR(F.col("oddy")[k])) for k in range(SKETCH // 64)]
    close = sum(rest, first) * (100 + percent) <= (F.col("nx") + F.col("ny")) * (100 - percent)
    met = side("x", rows.where("label <> top")).join(side("y", rows), "sig")
    met = met.where(((F.col("labely") == F.col("topy")) | (F.col("nodex") > F.col("nodey"))) & (F.col("labelx") != F.col("labely")) & (F.col("wholex") | F.col("wholey")) & fits(F.col("nx"), F.col("ny")) & close)
    return met.select(F.greatest("nodex", "nodey").alias("a"), F.least("nodex", "nodey").alias("b")).distinct()


def _open_links(held: DataFrame, closed: DataFrame, stars: DataFrame, marks: DataFrame, texts: DataFrame, width: int, percent: int, margin: int,
                fits) -> DataFrame:
    """Links between classes of one segment that the stars left in different components."""
    # of a segment with two classes, the star was the only pair
    labelled = held.where("size > 2").join(closed, "node", "left").select("sig", "node", "n", F.coalesce("component", "node").alias("label"), F.lit(True).alias("whole"))
    # pairing a segment costs outside x rows, the one-deletion neighbourhoods of its members about 2 x mean + margin a row
    waiting = labelled.join(_tops(labelled).withColumn("dear", F.col("outside") > 2 * F.col("mean") + margin), "sig")
    small = marks.select("node", _folded(F.col("odd")).alias("odd"))
    waiting = written(waiting.join(small, "node"), "open-segments")
    cheap = _cross(waiting.where("NOT dear"), percent, fits)
    again = waiting.where("dear").groupBy("node").agg(F.first("n").alias("n"), F.min("label").alias("label"))
    second = _second_index(again, texts, width, percent)
    rare = _cross(second.join(_tops(second), "sig").join(small, "node"), percent, fits)
    pairs = written(_plausible(cheap.unionByName(rare).distinct().join(stars, ["a", "b"], "left_anti"), marks, percent), "open-pairs")
    return _verified(pairs, texts, width, percent)
