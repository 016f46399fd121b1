"""Deleted interpolation: counts and the base score exactly, the model as a distribution that beats the base."""

import math
import zlib
from collections import Counter

import numpy as np
from weirworks.llm import interpolation as I


def part(i):
    return zlib.crc32(str(i).encode()) % 7


def test_counts_and_scores(make, prose, odd):
    texts = [(i, " ".join(["big bad wolf"] * (i % 4)) + " " + prose(25, i, 60)) for i in range(250)] + odd
    rows = I.score_documents(make(texts, repeat=(4,))).collect()
    assert len(rows) == len(texts) + 1
    tokens = {i: (t or "").encode().lower().split() + ["end"] for i, t in texts}
    counts = Counter()
    for i, _ in texts + [texts[4]]:
        if part(i) != 2:
            counts.update(tokens[i])
    total, vocabulary = sum(counts.values()), len(counts)
    for r in rows:
        base = sum(math.log10((counts[x] + 1) / (total + vocabulary + 1)) for x in tokens[r.doc_id])
        assert (r.n_tokens, r.train_tokens, r.held_out) == (len(tokens[r.doc_id]), total, part(r.doc_id) == 2)
        assert r.n_known == sum(counts[x] > 0 for x in tokens[r.doc_id]) and math.isclose(r.base_score, base, rel_tol=1e-9)
        assert r.score < 0
    held = [r for r in rows if r.held_out and r.doc_id < 250]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_weights_are_mixtures_and_em_finds_the_source():
    rng = np.random.default_rng(1)
    n = 4000
    pair, word = np.where(rng.random(n) < 0.7, 1000.0, 0.0), np.full(n, 2.0)
    bins = lambda r: np.where(r > 0, np.round(np.log2(np.maximum(r, 1e-9)) * I.BINS), I.FAR).astype(int)
    w = I.learn(list(zip([3] * n, bins(pair).tolist(), bins(word).tolist(), [1] * n, strict=True)))
    assert np.allclose(w.sum(1), 1) and (w >= 0).all() and 0.6 < w[3][0] < 0.8 and w[0][0] == 0


def test_without_training_documents_and_empty(make):
    held = [i for i in range(60) if part(i) == 2][:3]
    rows = I.score_documents(make([(i, "a b") for i in held])).collect()
    assert [(r.train_tokens, r.n_known, r.base_score) for r in rows] == [(0, 0, 0.0)] * 3
    assert I.score_documents(make([(1, "x")]).limit(0)).count() == 0
