"""First phrase of a rules table that a text contains, by Aho-Corasick automata.

The rules are sorted by (rule_ord, phrase_ord) and cut into blocks of at most about ``BLOCK_CHARS`` characters. Each block
is broadcast; a worker holds the automaton of one block at a time, passes over each text once with it, and takes only the
texts without a match to the next block. Nothing about a text is exploded, joined or shuffled, whatever the number of rules,
so rows need no key and very long texts cost their length.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.workdir import written

BLOCK_CHARS = 1_000_000
ORDER = ["rule_ord", "phrase_ord", "phrase"]


class Book:
    """A block of rules in order: ``rows`` (a record batch) and an automaton over their phrases."""
    def __init__(self, data: bytes):
        import ahocorasick
        self.rows = pa.ipc.open_stream(data).read_all().combine_chunks().to_batches()[0]
        phrases = self.rows.column(self.rows.schema.get_field_index("phrase")).to_pylist()
        self.always = phrases.index("") if "" in phrases else None       # an empty phrase occurs in every text
        first: dict[str, int] = {}
        for number, phrase in enumerate(phrases[:self.always]):          # what comes after it can never be first
            first.setdefault(phrase, number)
        self.words = self._automaton(ahocorasick, first)
        # a phrase that contains an earlier one is never the first that occurs
        kept = {p: n for p, n in first.items() if min(v for _, v in self.words.iter(p)) == n}
        if len(kept) < len(first):
            self.words = self._automaton(ahocorasick, kept)

    @staticmethod
    def _automaton(ahocorasick, phrases: dict[str, int]):
        words = ahocorasick.Automaton()
        for phrase, number in phrases.items():
            words.add_word(phrase, number)
        words.make_automaton()
        return words

    def first(self, text: str) -> int | None:
        """The number of the first rule whose phrase occurs."""
        hit = min((n for _, n in self.words.iter(text)), default=None) if len(self.words) else None
        return self.always if hit is None else hit


_OPEN: dict[str, Book] = {}          # of the worker: at most one


def _book(name: str, load: Callable[[], bytes]) -> Book:
    if name not in _OPEN:
        _OPEN.clear()
        _OPEN[name] = Book(load())
    return _OPEN[name]


def _stream(table: pa.Table) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue()


def rule_blocks(rules: DataFrame, block_chars: int = BLOCK_CHARS) -> list[bytes]:
    """The rules as sorted blocks; phrases are lower-cased, null ones are left out."""
    ranked = rules.where(F.col("phrase").isNotNull()).withColumn("phrase", F.lower("phrase"))
    chars = ranked.agg(F.sum(F.length("phrase") + 1)).first()[0] or 0
    count = -(-int(chars) // block_chars)
    if count <= 1:
        tables = [ranked.toArrow()]
    else:
        # ranges by order; one block at a time passes through the driver
        cut = written(ranked.repartitionByRange(count, *ORDER).withColumn("_block", F.spark_partition_id()), "rules")
        tables = [cut.where(F.col("_block") == k).drop("_block").toArrow() for k in range(count)]
    return [_stream(t.sort_by([(c, "ascending") for c in ORDER])) for t in tables if t.num_rows]


def first_rule(lowered: Column, rules: DataFrame, block_chars: int = BLOCK_CHARS) -> Column:
    """A struct of the rule's columns for each lower-cased text, null where no phrase occurs or the text is null.

    The rules are read when the column is made. Of rules with one place in the order, the smallest phrase counts.
    """
    spark = rules.sparkSession
    blocks = [(hashlib.md5(b).hexdigest(), spark.sparkContext.broadcast(b)) for b in rule_blocks(rules, block_chars)]
    shape = T.StructType([T.StructField(f.name, f.dataType) for f in rules.schema])        # all of it null without a match
    if not blocks:
        return F.lit(None).cast(shape)

    @F.arrow_udf(shape)
    def match(texts: pa.Array) -> pa.Array:
        open_, place, parts, base = [(i, t) for i, t in enumerate(texts.to_pylist()) if t is not None], [None] * len(texts), [], 0
        for name, block in blocks:
            if parts and not open_:
                break
            book, rest = _book(name, lambda block=block: block.value), []
            for i, text in open_:
                hit = book.first(text)
                if hit is None:
                    rest.append((i, text))
                else:
                    place[i] = base + hit
            parts.append(book.rows)
            base, open_ = base + book.rows.num_rows, rest
        rows = pa.Table.from_batches(parts).take(pa.array(place, pa.int64())).combine_chunks()
        columns = [c.combine_chunks() for c in rows.columns]
        return pa.StructArray.from_arrays(columns, fields=[f.with_nullable(True) for f in rows.schema], mask=pa.array([p is None for p in place], pa.bool_()))

    return match(lowered)
