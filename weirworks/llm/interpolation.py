"""Language-model scoring by deleted interpolation.

The model mixes maximum-likelihood estimates of word bigrams and words with the uniform distribution over the training
vocabulary and one unknown word. The mixture weights depend on how often the context word occurs in training (one bucket
for each power of two). They are learned by expectation-maximisation on held-out counts: the tuning fold of the training
documents is scored with its own counts deleted. Final scores use the counts of all training documents.

Counts cover every document and are gathered by the batch exchange: a batch asks for its distinct words and bigrams, adds
its own counts, and gets the counts of the whole corpus back. Nothing but the mixture weights, the totals and the binned
EM statistics (at most buckets x bins x bins) reaches the driver.

Tokens are words, A-Z lower-cased, and one end for each text; a null or empty text is its end alone. Repeated rows are
documents of their own; without training documents all counts are 0 and the scores follow from that; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import asked, batched, each_row, joined, unpack_rows, values
from .sampling import fold
from .words import BASE, U, mix, pieces

START, STOP = U(0x53544152), U(0x454E44)      # numbers of the start of a text and of its end; no word has them
SHORT = ~U(0xFFFF)                            # bigrams are told apart by 48 bits
TRAIN, TUNE, HELD = 0, 1, 2
BINS = 6                                      # bins of the EM statistics for each doubling
FAR = -10_000                                 # the bin of probability 0
CONTEXTS = 40


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token numbers of all texts, the numbers of their contexts, and each text's token count."""
    words, counts = [], []
    for _, _, w in pieces(texts):
        words.append(w.hash)
        counts.append(w.counts())
    words, counts = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((words, U), (counts, np.int64)))
    size = counts + 1
    out = np.empty(len(words) + len(counts), U)
    ends = np.cumsum(size) - 1
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside], out[ends] = words, STOP
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[ends - size + 1] = START
    return out, before, size


def _keys(texts: pa.Array):
    token, before, size = _tokens(texts)
    pair = mix(mix(before * U(BASE)) + token) & SHORT
    return token, before, pair, size


def _ask(row: dict):
    rows = unpack_rows(row["docs"])
    token, before, pair, size = _keys(rows.column(1))
    part = np.repeat(rows.column(2).to_numpy(zero_copy_only=False), size)
    out = []
    for keys in (token, pair):
        found, back = np.unique(keys, return_inverse=True)
        counts = np.stack([np.bincount(back, part != HELD, len(found)), np.bincount(back, part == TUNE, len(found))], 1)
        out.append((found, counts.astype(np.uint32)))
    return out


def _answer(stream: int, keys: np.ndarray, sums: np.ndarray):
    kept = sums[:, 0] - sums[:, 1]
    words = stream == 0
    return sums, [words * sums[:, 0].sum(), words * (sums[:, 0] > 0).sum(), words * kept.sum(), words * (kept > 0).sum()]


def _parts(row: dict):
    """For every token of a joined batch: counts of the bigram, of its context and of the token (train, tuning each)."""
    rows = unpack_rows(row["docs"])
    token, before, pair, size = _keys(rows.column(1))
    words, at = np.unique(token, return_inverse=True)
    pairs, at2 = np.unique(pair, return_inverse=True)
    uni, bi = values(row, 0, 2).astype(np.int64), values(row, 1, 2).astype(np.int64)
    ends = np.searchsorted(words, STOP) if len(words) else 0
    context = uni[np.minimum(np.searchsorted(words, before), len(words) - 1)]
    context[before == START] = uni[ends] if len(uni) else 0          # a text starts as often as it ends
    return rows, size, bi[at2], context, uni[at]


def _bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))) + 1, 0), CONTEXTS - 1).astype(int)


def _ratio(top: np.ndarray, bottom: np.ndarray | float, vocabulary: int) -> np.ndarray:
    """A maximum-likelihood estimate over the uniform probability."""
    return np.divide(top * float(vocabulary + 1), bottom, out=np.zeros(len(top)), where=np.asarray(bottom) > 0)


def _statistics(batches: Iterator[pa.RecordBatch], total: int, vocabulary: int) -> Iterator[pa.RecordBatch]:
    for row in each_row(batches):
        _, _, pair, context, word = _parts(row)
        pair, context, word = (x[:, 0] - x[:, 1] for x in (pair, context, word))
        bins = []
        for r in (_ratio(pair, context, vocabulary), _ratio(word, total, vocabulary)):
            bins.append(np.where(r > 0, np.round(np.log2(np.maximum(r, 1e-300)) * BINS), FAR).astype(np.int64))
        found, count = np.unique(np.stack([_bucket(context), *bins]), axis=1, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int32()), pa.array(found[1], pa.int32()), pa.array(found[2], pa.int32()), pa.array(count, pa.int64())],
                                         ["context", "pair", "word", "n"])


def learn(statistics: list[tuple[int, int, int, int]], rounds: int = 100) -> np.ndarray:
    """Mixture weights (bigram, word, uniform) of each context bucket by EM on binned held-out counts."""
    weights = np.full((CONTEXTS, 3), 1 / 3)
    weights[0] = [0, 0.5, 0.5]
    table = np.array(sorted(statistics), np.int64).reshape(-1, 4)
    for b in range(CONTEXTS):
        own = table[table[:, 0] == b]
        if not len(own):
            near = [x for x in range(b - 1, -1, -1) if (table[:, 0] == x).any()] if b else []
            weights[b] = weights[near[0]] if near and near[0] else weights[b]
            continue
        chance = np.stack([np.where(own[:, k] > FAR, 2.0 ** (own[:, k] / BINS), 0) for k in (1, 2)] + [np.ones(len(own))], 1)
        n = own[:, 3].astype(float)
        for _ in range(rounds):
            share = chance * weights[b]
            share *= (n / share.sum(1))[:, None]
            weights[b] = (share.sum(0) + 1e-3 * (weights[b] > 0)) / (n.sum() + 1e-3 * (weights[b] > 0).sum())   # no weight dies out
    return weights


def _scored(batches: Iterator[pa.RecordBatch], total: int, vocabulary: int, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    for row in each_row(batches):
        docs, size, pair, context, word = _parts(row)
        pair, context, word = pair[:, 0], context[:, 0], word[:, 0]
        w = weights[_bucket(context)]
        chance = w[:, 0] * _ratio(pair, context, vocabulary) + w[:, 1] * _ratio(word, total, vocabulary) + w[:, 2]
        model = np.log10(chance) - np.log10(vocabulary + 1.0)
        base = np.log10((word + 1.0) / (total + vocabulary + 1.0))
        first = np.cumsum(size) - size
        held = docs.column(2).to_numpy(zero_copy_only=False) == HELD
        yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(held), pa.array(size, pa.int64()), pa.array(np.add.reduceat((word > 0).astype(np.int64), first), pa.int64()),
                                          pa.array([total] * len(size), pa.int64()), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(model, first))],
                                         ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score_documents(docs: DataFrame, folds: int = 7, held: int = 2, tuned: int = 5) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per document.

    Documents whose fold is ``held`` are not learned from; those of fold ``tuned`` set the mixture weights.
    """
    own = fold(F.col("doc_id"), folds)
    part = F.when(own == held, HELD).when(own == tuned, TUNE).otherwise(TRAIN)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", part.cast("int").alias("part"))
    # tuning documents have batches of their own, so that EM reads no others
    table = batched(rows.where("part = 1")).withColumn("tuning", F.lit(True)).unionByName(
        batched(rows.where("part <> 1")).withColumn("tuning", F.lit(False)).withColumn("batch", F.col("batch") + (1 << 62)))
    answers = asked(table, _ask, _answer, 2, 4)
    sums = answers.select(*[F.sum(F.element_at("totals", k)).alias(f"t{k}") for k in range(1, 5)]).first()
    total, vocabulary, kept, kept_vocabulary = (int(x or 0) for x in sums)
    tuning = joined(table.where("tuning"), answers.where(F.col("batch") < (1 << 62)))
    statistics = tuning.select("docs", "answers").mapInArrow(lambda b: _statistics(b, kept, kept_vocabulary), "context int, pair int, word int, n long")
    weights = learn([tuple(r) for r in statistics.groupBy("context", "pair", "word").agg(F.sum("n")).collect()])
    return joined(table, answers).select("docs", "answers").mapInArrow(
        lambda b: _scored(b, total, vocabulary, weights),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
