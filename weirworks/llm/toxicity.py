"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of the table rows of its hash and of the hashes of its first four and six bytes. Filters of
the widths ``SPANS`` slide over the whole text, each filter's largest rectified answer is kept, and a linear layer gives
the logit. Training reads every labelled document: they are dealt by a hash into shards of a bounded size, which tasks learn
from on their own for ``MIX`` epochs; then the shards' changes are averaged, each table row over the shards that changed it,
block by block of the table. Only the model (4 MB) is collected and sent out again. The first embedding column starts from
the words' log odds over all shards, so that the filters begin on words that tell the classes apart. A quarter of the
labelled documents is held back: all of it calibrates the score (Platt scaling by Newton steps, whose sums Spark takes) and
gives, for each language with enough labelled rows, the threshold above which a document is rejected; other languages use
the threshold over all. The language picks the threshold only, never the score.

Null and empty texts have no words and score what the bias gives; without labelled rows of both classes every score is 0
and nothing is rejected. Rows that repeat are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirworks.operators.joins import fits_broadcast
from weirworks.sources.workdir import discard, written

from .exchange import each_row, release
from .sampling import fold
from .words import U, Words, pieces

SPANS = (1, 2, 3)
FILTERS = 8                 # of each width
WIDTH = 16
BUCKETS = 1 << 16           # the last three rows are padding
SHARD_BYTES = 16_000_000    # of text that a task learns from between two averages
MIX = 2                     # epochs between two averages
BLOCK = 512                 # table rows that are averaged together
LANGUAGE_ROWS = 40          # held-back rows, and a tenth of them toxic, that a threshold of its own needs
PAD = max(SPANS)            # empty places after each text: a filter that starts on a word, or on the first of them, stays inside


@dataclass
class Model:
    table: np.ndarray
    filters: np.ndarray       # WIDTH x sum(span * FILTERS), the slices of one span beside each other
    shift: np.ndarray
    layer: np.ndarray
    bias: float
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5
    by_language: dict[str, float] = field(default_factory=dict)


def _ids(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(words + padding) x 3 table rows, and where each text begins; every text ends with PAD empty places."""
    kinds = [w.hash, w.prefix(4) ^ U(0x5555), w.prefix(6) ^ U(0xAAAA)]
    at = np.arange(len(w.hash)) + PAD * np.repeat(np.arange(len(w)), w.counts())
    out = np.full((len(w.hash) + PAD * len(w), 3), BUCKETS, np.int32)
    for k, h in enumerate(kinds):
        out[at, k] = (h >> U(40)) % U(BUCKETS)
    return out, w.ptr[:-1] + PAD * np.arange(len(w))


def _answers(table: np.ndarray, filters: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Each filter's answer at every place; only places that ``_places`` counts stay inside their text."""
    x = table[ids[:, 0]] + table[ids[:, 1]] + table[ids[:, 2]]
    flat = x @ filters
    out, done = np.empty((len(ids), FILTERS * len(SPANS)), np.float32), 0
    for k, span in enumerate(SPANS):
        y = flat[:, done:done + FILTERS].copy()
        for j in range(1, span):
            y[:-j] += flat[j:, done + j * FILTERS:done + (j + 1) * FILTERS]
        out[:, k * FILTERS:(k + 1) * FILTERS] = y
        done += span * FILTERS
    return out


def _places(size: np.ndarray) -> np.ndarray:
    """How many places of a text, of words and padding together, filters may start on: its words, or one place."""
    return np.maximum(size - PAD, 1)


def logits(column: pa.Array, model: Model) -> np.ndarray:
    """The uncalibrated answer for each whole text; long texts are read in the pieces that ``words`` gives."""
    out = np.zeros(len(column))
    for low, high, w in pieces(column, letters=True, size=400_000):
        ids, starts = _ids(w)
        spans = np.stack([starts, starts + _places(np.diff(starts, append=len(ids)))], 1).ravel()
        best = np.maximum.reduceat(_answers(model.table, model.filters, ids), spans, axis=0)[::2]
        out[low:high] = np.maximum(best + model.shift, 0) @ model.layer + model.bias
    return out


def scores(column: pa.Array, model: Model) -> np.ndarray:
    """Calibrated score of each whole text."""
    return _calibrated(logits(column, model), model)


def _calibrated(logit: np.ndarray, model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-(model.scale[0] * logit + model.scale[1])))


def train(docs: DataFrame, labels: DataFrame, epochs: int = 14, seed: int = 5) -> Model | None:
    """Fit on all of ``labels`` (doc_id, toxic) and the texts of ``docs`` (doc_id, text, lang)."""
    marked = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select("doc_id", "text", "lang").join(F.broadcast(marked) if fits_broadcast(marked) else marked, "doc_id")
    rows = rows.withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(4)) == 0)
    counts = {(r["held"], r["toxic"]): (r["n"], r["size"] or 0) for r in rows.groupBy("held", "toxic").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()}
    if len({toxic for _, toxic in counts}) < 2:
        return None
    parts = [False] if len(counts) == 4 else [False, True]          # without both classes on both sides, all is fitted and checked
    n, size = ([sum(counts.get((h, c), (0, 0))[k] for h in parts) for c in (0, 1)] for k in (0, 1))
    shard = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(max(1, -(-sum(size) // SHARD_BYTES))))
    shards = written(rows.where(F.col("held").isin(parts)).select(shard.alias("shard"), "doc_id", "toxic", "text").groupBy("shard").applyInArrow(
        _shard, "shard long, toxic binary, counts binary, words binary"), "toxicity-shards")
    model = _fit(shards, n, epochs, seed)
    checks = rows.where("held") if len(counts) == 4 else rows
    checks = written(checks.select("lang", "toxic", _logit(F.col("text"), model).alias("logit")), "toxicity-checks")
    model.scale = _platt(checks)
    found = _thresholds(checks, model)
    model.threshold = found.pop("")
    model.by_language = found
    discard(shards, checks)
    return model


def _shard(rows: pa.Table) -> pa.Table:
    """One row: the classes, word counts and table rows of the words of a shard's texts."""
    rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    counts, words = [], []
    for _, _, w in pieces(rows["text"], letters=True, size=400_000):
        ids = _ids(w)[0]
        counts.append(w.counts().astype("<u4"))
        words.append(ids[ids[:, 0] < BUCKETS].astype("<u2"))
    packed = [rows["toxic"].to_numpy().astype("i1"), np.concatenate(counts), np.concatenate(words)]
    shard = rows["shard"][:1].combine_chunks()
    out = pa.table({"shard": shard, **{name: pa.array([zstandard.compress(x, 1)], pa.binary()) for name, x in zip(("toxic", "counts", "words"), packed, strict=True)}})
    del rows, words, packed
    release()
    return out


class Texts:
    """The texts of a shard, two bytes for each table row: only the texts asked for are padded and widened."""
    def __init__(self, row: dict):
        self.truth, self.counts, words = (np.frombuffer(zstandard.decompress(row[name]), kind).astype(made) for name, kind, made in (
            ("toxic", "i1", float), ("counts", "<u4", np.int64), ("words", "<u2", np.uint16)))
        self.words, self.ends = words.reshape(-1, 3), np.cumsum(self.counts)

    def __len__(self) -> int:
        return len(self.truth)

    def batch(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The table rows of some texts, each followed by PAD empty places, and the texts' sizes with these."""
        sizes = self.counts[which] + PAD
        ids = np.full((sizes.sum(), 3), BUCKETS, np.int32)
        for i, at in zip(which, np.cumsum(sizes) - sizes, strict=True):
            ids[at:at + self.counts[i]] = self.words[self.ends[i] - self.counts[i]:self.ends[i]]
        return ids, sizes


@dataclass
class State:
    """What training changes, and the sums of squared steps that slow it down (of a table row: their mean)."""
    table: np.ndarray
    rest: list[np.ndarray]            # filters, shift, layer, bias
    slow: np.ndarray
    slow_rest: list[np.ndarray]       # of filters, shift and layer


def _blocks(shard: int, weight: int, blocks: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard] * len(blocks), pa.int64()), pa.array([weight] * len(blocks), pa.int64()), pa.array(range(len(blocks)), pa.int32()),
                                       pa.array([zstandard.compress(x.tobytes(), 1) for x in blocks], pa.binary())], ["shard", "weight", "block", "data"])


def _merged(shards: DataFrame, work, merge) -> list[np.ndarray]:
    """Each block of what ``work(texts, shard)`` gives, merged over all shards in their order."""
    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_row(batches):
            texts = Texts(row)
            yield _blocks(row["shard"], len(texts), work(texts, row["shard"]))
            del texts

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("shard")
        out = merge(int(rows["block"].iloc[0]), (np.frombuffer(zstandard.decompress(x), np.float32) for x in rows["data"]), rows["weight"].to_numpy())
        return pd.DataFrame({"block": rows["block"].iloc[:1], "data": [out.astype(np.float64).tobytes()]})
    got = shards.mapInArrow(worked, "shard long, weight long, block int, data binary").groupBy("block").applyInPandas(merged, "block int, data binary").collect()
    return [np.frombuffer(r["data"], np.float64) for r in sorted(got, key=lambda r: r["block"])]


def _seen(texts: Texts, shard: int) -> list[np.ndarray]:
    """How many texts of each class hold each table row."""
    seen = np.zeros((BUCKETS + 1, 2), np.float32)
    for i, y in enumerate(texts.truth):
        seen[np.unique(texts.words[texts.ends[i] - texts.counts[i]:texts.ends[i]]), int(y)] += 1
    return [seen[k:k + BLOCK] for k in range(0, BUCKETS, BLOCK)]


def _total(block: int, parts: Iterator[np.ndarray], weight: np.ndarray) -> np.ndarray:
    return sum(x.astype(np.float64) for x in parts)


def _mean(block: int, parts: Iterator[np.ndarray], weight: np.ndarray) -> np.ndarray:
    """Table rows: over the shards that changed them; the rest (the last block): by the shards' texts."""
    total, by = 0.0, 0.0
    for x, w in zip(parts, weight, strict=True):
        x = x.astype(np.float64)
        if block < BUCKETS // BLOCK:
            x = x.reshape(BLOCK, WIDTH + 1)
            w = x.any(axis=1, keepdims=True).astype(float)
        total, by = total + x * w, by + w
    return (total / np.maximum(by, 1)).ravel()


def _fit(shards: DataFrame, size: list[int], epochs: int, seed: int) -> Model:
    seen = np.concatenate([x.reshape(-1, 2) for x in _merged(shards, _seen, _total)])
    state = _start(seen, size, seed)
    heavy = size[0] / size[1]
    for first in range(0, epochs, MIX):
        def work(texts, shard, run=range(first, min(epochs, first + MIX))):
            new = _learned(state, texts, run, epochs, heavy, [seed, run.start, shard])
            change = np.concatenate([new.table - state.table, (new.slow - state.slow)[:, None]], 1)
            rest = [a - b for a, b in zip(new.rest + new.slow_rest, state.rest + state.slow_rest, strict=True)]
            return [change[k:k + BLOCK] for k in range(0, BUCKETS, BLOCK)] + [np.concatenate([x.ravel() for x in rest]).astype(np.float32)]
        *change, rest = _merged(shards, work, _mean)
        change = np.concatenate(change).reshape(-1, WIDTH + 1).astype(np.float32)
        state.table[:BUCKETS] += change[:, :WIDTH]
        state.slow[:BUCKETS] += change[:, WIDTH]
        for a in state.rest + state.slow_rest:
            a += rest[:a.size].reshape(a.shape).astype(np.float32)
            rest = rest[a.size:]
    filters, shift, layer, bias = state.rest
    return Model(state.table, filters, shift, layer, float(bias[0]))


def _start(seen: np.ndarray, size: list[int], seed: int) -> State:
    rng = np.random.default_rng(seed)
    odds = np.log((seen[:, 1] + 0.5) / (size[1] + 1)) - np.log((seen[:, 0] + 0.5) / (size[0] + 1))
    odds[seen.sum(1) < 3] = 0
    table = rng.normal(0, 0.1, (BUCKETS + 1, WIDTH)).astype(np.float32)
    table[:BUCKETS, 0] = np.clip(odds, -3, 6) / 3
    table[BUCKETS] = 0
    filters = rng.normal(0, 0.2, (WIDTH, sum(SPANS) * FILTERS)).astype(np.float32)
    filters[0] = np.abs(filters[0]) + 0.5
    kinds = FILTERS * len(SPANS)
    rest = [filters, np.full(kinds, -0.5, np.float32), np.full(kinds, 0.1, np.float32), np.full(1, -1.0, np.float32)]
    return State(table, rest, np.full(BUCKETS + 1, 1e-3, np.float32), [np.full_like(a, 1e-3) for a in rest[:3]])


def _learned(state: State, texts: Texts, run: range, epochs: int, heavy: float, seed: list[int]) -> State:
    """The state after some epochs over one shard."""
    rng = np.random.default_rng(seed)
    table, (filters, shift, layer, bias) = state.table.copy(), [a.copy() for a in state.rest]
    grads = [np.repeat(state.slow[:, None], WIDTH, 1), *[a.copy() for a in state.slow_rest]]
    kinds = FILTERS * len(SPANS)
    where = [(k * FILTERS + f, span, sum(SPANS[:k]) * FILTERS + f) for k, span in enumerate(SPANS) for f in range(FILTERS)]
    for epoch in run:
        rate = 0.06 * (1 - 0.8 * epoch / epochs)
        order = rng.permutation(len(texts))
        for batch in np.array_split(order, max(1, len(order) // 32)):
            truth, (ids, sizes) = texts.truth[batch], texts.batch(batch)
            starts = np.cumsum(sizes) - sizes
            answers = _answers(table, filters, ids)
            spots = np.array([answers[a:a + n].argmax(0) + a for a, n in zip(starts, _places(sizes), strict=True)])
            best = answers[spots, np.arange(kinds)] + shift
            pooled = np.maximum(best, 0)
            logit = pooled @ layer + bias
            slope = (1 / (1 + np.exp(-logit)) - truth) * np.where(truth > 0, heavy, 1.0) / len(batch)
            g_layer = slope @ pooled + 1e-4 * layer
            back = (slope[:, None] * layer * (best > 0)).astype(np.float32)
            g_filters, rows, steps = np.zeros_like(filters), [], []
            for kind, span, column in where:
                for j in range(span):
                    at = ids[np.minimum(spots[:, kind] + j, len(ids) - 1)]
                    c = column + j * FILTERS
                    g_filters[:, c] = back[:, kind] @ (table[at[:, 0]] + table[at[:, 1]] + table[at[:, 2]])
                    step = back[:, kind:kind + 1] * filters[:, c]
                    rows += [at[:, 0], at[:, 1], at[:, 2]]
                    steps += [step] * 3
            rows, steps = np.concatenate(rows), np.concatenate(steps)
            own, back_to = np.unique(rows, return_inverse=True)
            g_table = np.zeros((len(own), WIDTH), np.float32)
            np.add.at(g_table, back_to, steps)
            keep = own != BUCKETS
            own, g_table = own[keep], g_table[keep]
            grads[0][own] += g_table ** 2
            table[own] -= rate * g_table / np.sqrt(grads[0][own])
            for k, (a, g) in enumerate(((filters, g_filters), (shift, back.sum(0)), (layer, g_layer)), 1):
                grads[k] += g ** 2
                a -= (rate * g / np.sqrt(grads[k])).astype(np.float32)
            bias -= 0.1 * rate * float(slope.sum()) * 10
    return State(table, [filters, shift, layer, bias], grads[0].mean(axis=1), grads[1:])


def _platt(checks: DataFrame) -> tuple[float, float]:
    """Slope and offset of a logistic fit on (toxic, logit), smoothed targets, damped Newton steps. The sums are taken as
    decimals, so that their order does not matter."""
    total = lambda c: F.sum(c.cast("decimal(38,18)"))
    n1, n0 = checks.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    target, x = F.when(F.col("toxic") > 0, (n1 + 1) / (n1 + 2)).otherwise(1 / (n0 + 2)), F.col("logit")
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), a * x + b))))
        own = checks.select(x, (p - target).alias("g"), F.greatest(p * (1 - p), F.lit(1e-9)).alias("h"))
        gx, g, hxx, hx, h = (float(v) for v in own.agg(*[total(F.expr(e)) for e in ("g * logit", "g", "h * logit * logit", "h * logit", "h")]).first())
        step = np.linalg.solve(np.array([[hxx + 1e-6, hx], [hx, h + 1e-6]]), [gx, g])
        step /= max(1.0, np.abs(step).max())
        a, b = float(a - step[0]), float(b - step[1])
        if np.abs(step).max() < 1e-6:
            break
    return (a, b) if a > 0 else (1.0, 0.0)


def _thresholds(checks: DataFrame, model: Model) -> dict[str, float]:
    """By language with enough rows, and over all under the empty name: just below the lowest score above the best cut by
    F1; the cut at the higher score wins a tie. Counts run on over ranges of scores, so that no group is sorted whole."""
    by = checks.where("lang <> ''").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("hits"))
    own = [r["lang"] for r in by.where((F.col("n") >= LANGUAGE_ROWS) & (F.col("hits") >= LANGUAGE_ROWS / 10)).collect()]
    named = checks.select(F.lit("").alias("name"), "toxic", "logit").unionByName(checks.where(F.col("lang").isin(own)).select(F.col("lang").alias("name"), "toxic", "logit"))
    cells = named.groupBy("name", "logit").agg(F.sum("toxic").alias("hits"), F.count(F.lit(1)).alias("n"))
    cells = written(cells.repartitionByRange("name", F.col("logit").desc()).withColumn("part", F.spark_partition_id()), "toxicity-cuts")
    each = Window.partitionBy("name")
    before = each.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = cells.groupBy("name", "part").agg(F.sum("hits").alias("h"), F.sum("n").alias("m"))
    sums = sums.select("name", "part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in "hm"], F.sum("h").over(each).alias("all"))
    upto = Window.partitionBy("name", "part").orderBy(F.col("logit").desc()).rowsBetween(Window.unboundedPreceding, 0)
    f1 = 2 * (F.col("h") + F.sum("hits").over(upto)) / (F.col("m") + F.sum("n").over(upto) + F.col("all"))
    best = cells.join(F.broadcast(sums), ["name", "part"]).select("name", F.struct(f1.alias("f1"), "logit").alias("cut")).groupBy("name").agg(F.max("cut")["logit"].alias("at"))
    best = {r["name"]: r["at"] for r in best.collect()}
    at = F.lit(None).cast("double")
    for name, value in best.items():
        at = F.when(F.col("name") == name, F.lit(value)).otherwise(at)
    below = {r["name"]: r["low"] for r in cells.where(F.col("logit") < at).groupBy("name").agg(F.max("logit").alias("low")).collect()}
    discard(cells)
    p = {name: float(_calibrated(np.float64(x), model)) for name, x in best.items()}
    low = {name: float(_calibrated(np.float64(x), model)) for name, x in below.items()}
    return {name: p[name] - 0.1 * (p[name] - low.get(name, 0.0)) for name in best}


def _logit(text: Column, model: Model) -> Column:
    @F.arrow_udf("double")
    def answered(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(logits(texts, model))
            release()
    return answered(text)


def score(text: Column, model: Model | None) -> Column:
    """The score of a text column, 0 to 1."""
    if model is None:
        return F.lit(0.0)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(scores(texts, model))
            release()
    return scored(text)


def threshold(lang: Column, model: Model | None) -> Column:
    """The rejection threshold of a language column."""
    if model is None:
        return F.lit(1.0)
    out = F.lit(model.threshold)
    for name, value in model.by_language.items():
        out = F.when(lang == name, F.lit(value)).otherwise(out)
    return out


def with_rejection(docs: DataFrame, model: Model | None, prefix: str = "toxicity_") -> DataFrame:
    """``docs`` with columns score, threshold and rejected, named with a prefix that no column of ``docs`` has."""
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    out = docs.withColumn(prefix + "score", score(F.col("text"), model)).withColumn(prefix + "threshold", threshold(F.col("lang"), model))
    return out.withColumn(prefix + "rejected", (F.col(prefix + "score") >= F.col(prefix + "threshold")) if model else F.lit(False))


def classify_documents(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted, threshold, rejected per document; learns outside the held fold."""
    part = fold(F.col("doc_id"), folds)
    model = train(docs, labels.where(part != held))
    out = with_rejection(docs.select("doc_id", "text", "lang"), model)
    return out.select("doc_id", (part == held).alias("held_out"), F.col("toxicity_score").alias("score"),
                      (F.col("toxicity_score") >= 0.5).cast("int").alias("predicted"), F.col("toxicity_threshold").alias("threshold"),
                      F.col("toxicity_rejected").alias("rejected"))
