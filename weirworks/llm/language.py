"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A text's subwords are all its byte runs of the lengths ``ORDERS``, word edges included, hashed into ``BUCKETS`` rows of
an embedding table. Their average goes through a linear softmax layer. Training fits table and layer on a bounded,
documented sample of labelled texts; a held-back part of it sets the temperature, so that scores are probabilities, and
the rejection threshold: the lowest score from which on ``PRECISION`` of the predictions are right. For prediction the
table and the layer are folded into one small table of class scores, read once for every subword of the whole text.

Null, empty and letterless texts are ``und`` with score 0 and never accepted; ties go to the first language by name;
without any labelled row every text is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sampling import bounded, fold
from .words import pieces

ORDERS = (2, 3, 4)
BUCKETS = 1 << 16
WIDTH = 16
PER_LANGUAGE = 800       # labelled texts of each language that training may see
PRECISION = 0.99
UNKNOWN = "und"
LETTER = r"\p{L}"


@dataclass
class Model:
    names: list[str]
    table: np.ndarray        # BUCKETS x languages: embedding times layer, over the temperature
    bias: np.ndarray
    accept: float


def _buckets(data: np.ndarray) -> list[np.ndarray]:
    """For each order the bucket of the byte run that starts at every position; control bytes count as space."""
    data = np.where(data < 32, np.uint8(32), data).astype(np.uint32)
    out = []
    for n in ORDERS:
        if len(data) < n:
            out.append(np.zeros(0, np.int64))
            continue
        code = data[:len(data) - n + 1].copy()
        for k in range(1, n):
            code |= data[k:len(data) - n + 1 + k] << np.uint32(8 * k)
        code = (code ^ np.uint32(n * 0x01000193)) * np.uint32(2654435761)
        out.append(((code ^ (code >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(16)).astype(np.int64))
    return out


def _features(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text: the distinct buckets and how often each occurs."""
    out = []
    for low, high, w in pieces(column):
        for i in range(high - low):
            ids = np.concatenate(_buckets(w.data[w.edges[i]:w.edges[i + 1]]))
            out.append(np.unique(ids, return_counts=True))
    return out


@F.arrow_udf(T.StructType().add("ids", T.BinaryType()).add("counts", T.BinaryType()))
def _sparse(texts: pa.Array) -> pa.Array:
    both = _features(texts)
    return pa.StructArray.from_arrays([pa.array([i.astype("<i4").tobytes() for i, _ in both], pa.binary()),
                                       pa.array([c.astype("<i4").tobytes() for _, c in both], pa.binary())], ["ids", "counts"])


def train(rows: DataFrame, per_language: int = PER_LANGUAGE, epochs: int = 12, seed: int = 3) -> Model:
    """Fit on ``rows``: doc_id, text, lang; rows without text or language, or without a letter, are left out."""
    usable = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(LETTER)).select("doc_id", "text", "lang")
    sample = bounded(usable, "lang", "doc_id", per_language)
    got = sample.select("lang", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(5)).alias("part"), _sparse("text").alias("x")).select("lang", "part", "x.ids", "x.counts").collect()
    names = sorted({r["lang"] for r in got})
    if not names:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0)
    items = []
    for r in sorted(got, key=lambda r: (r["lang"], r["ids"], r["counts"])):
        n = np.frombuffer(r["counts"], "<i4").astype(np.float32)
        items.append((np.frombuffer(r["ids"], "<i4"), n / max(n.sum(), 1), names.index(r["lang"]), r["part"]))
    fit, held = [x for x in items if x[3]] or items, [x for x in items if not x[3]] or items
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    layer, bias = rng.normal(0, 0.3, (WIDTH, len(names))).astype(np.float32), np.zeros(len(names), np.float32)
    for epoch in range(epochs):
        rate = 2.0 * (1 - epoch / epochs)
        for k in rng.permutation(len(fit)):
            ids, share, y, _ = fit[k]
            mean = share @ table[ids]
            slope = _softmax(mean @ layer + bias)
            slope[y] -= 1
            back = layer @ slope
            layer -= 0.5 * rate * np.outer(mean, slope)
            bias -= 0.05 * rate * slope
            table[ids] -= (rate * 20) * share[:, None] * back
    logits = np.array([(s @ table[i]) @ layer + bias for i, s, _, _ in held])
    truth = np.array([y for _, _, y, _ in held])
    heat = min(np.geomspace(1, 20, 40), key=lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean())
    p = _softmax(logits / heat)
    order = np.argsort(-p.max(1), kind="stable")
    right = np.cumsum((p.argmax(1) == truth)[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(right >= PRECISION)
    accept = float(p.max(1)[order][good[-1]]) if len(good) else 1.0
    return Model(names, np.ascontiguousarray(table @ layer / heat, np.float32), (bias / heat).astype(np.float32), accept)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[ends] - total[starts]


def probabilities(column: pa.Array, model: Model) -> np.ndarray:
    """Class probabilities of each whole text."""
    out = np.zeros((len(column), len(model.names)))
    classes = [np.ascontiguousarray(model.table[:, c]) for c in range(len(model.names))]
    for low, high, w in pieces(column):
        size = np.zeros(high - low)
        for n, ids in zip(ORDERS, _buckets(w.data), strict=True):
            starts = np.minimum(w.edges[:-1], len(ids))
            ends = np.minimum(np.maximum(w.edges[1:] - n + 1, w.edges[:-1]), len(ids))   # runs do not cross texts
            size += ends - starts
            for c, scores in enumerate(classes):
                out[low:high, c] += _sums(scores.take(ids), starts, ends)
        out[low:high] /= np.maximum(size, 1)[:, None]
    return _softmax(out + model.bias)


def predict(text: Column, model: Model) -> Column:
    """struct<lang, score, accepted> of a text column."""
    shape = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])

    @F.arrow_udf("struct<lang: string, score: double, accepted: boolean>")
    def guess(texts: pa.Array) -> pa.Array:
        if not model.names:
            return pa.array([{"lang": UNKNOWN, "score": 0.0, "accepted": False}] * len(texts), shape)
        p = probabilities(texts, model)
        best = p.argmax(1) if len(p) else np.zeros(0, int)
        score = p[np.arange(len(p)), best]
        return pa.StructArray.from_arrays([pa.array(model.names).take(pa.array(best)), pa.array(score), pa.array(score >= model.accept)], fields=list(shape))

    unknown = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    letters = F.coalesce(text.rlike(LETTER), F.lit(False))
    return F.when(letters, guess(text)).otherwise(unknown)


def identify_documents(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted per document; learns from the documents outside the held fold."""
    part = fold(F.col("doc_id"), folds)
    model = train(docs.where(part != held))
    out = docs.select("doc_id", (part == held).alias("held_out"), predict(F.col("text"), model).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score", "p.accepted")
