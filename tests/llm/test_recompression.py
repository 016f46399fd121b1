"""Removal of repeated windows against counting every window."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from weirworks.llm import recompression as R


def brute(texts):
    words = {i: (t or "").encode().split() for i, t in texts}
    seen = Counter(tuple(w[k:k + 35]) for w in words.values() for k in range(len(w) - 34))
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - 34):
            if seen[tuple(w[k:k + 35])] > 1:
                gone.update(range(k, k + 35))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def result(docs):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in R.without_repeats(docs).collect()}


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", None])
def test_equals_counting(make, prose, odd, letters):
    """Few different words make many runs, ties and shifted repeats; shared passages of 30 to 60 words lie anywhere."""
    rng = random.Random(len(letters or ""))
    some = (lambda n, k: " ".join(rng.choice(letters) for _ in range(n))) if letters else prose
    passages = [some(n, 900 + n) for n in (30, 34, 35, 36, 50, 60, 60)]
    texts = []
    for i in range(90):
        parts = [some(rng.randint(0, 50), i * 10 + k) for k in range(3)]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randrange(4), rng.choice(passages))
        texts.append((i, rng.choice([" ", "\n", "  "]).join(parts)))
    texts += [(95, texts[3][1]), (96, " ".join(["again"] * 80)), (97, some(20, 1) + " Again")] + odd
    assert result(make(texts)) == brute(texts)


def test_repeated_rows_and_empty(make, prose):
    docs = make([(1, prose(50, 1)), (2, prose(50, 2))], repeat=(1,))
    rows = R.without_repeats(docs).collect()
    assert sorted((r.doc_id, r.n_removed) for r in rows) == [(1, 50), (1, 50), (2, 0)]
    assert R.without_repeats(docs.limit(0)).count() == 0


def test_names_agree_inside_equal_sequences():
    rng = np.random.default_rng(3)
    for kinds in (2, 5, 1000):
        for _ in range(60):
            body = rng.integers(1, kinds + 1, 35).astype(np.uint64)
            own = []
            for _ in range(2):
                words = np.concatenate([rng.integers(1, kinds + 1, 9).astype(np.uint64), body, rng.integers(1, kinds + 1, 9).astype(np.uint64)])
                own.append(R.phrases(words, np.array([0, len(words)]))[9 + R.EDGE:9 + R.LAST + 1])
            assert (own[0] == own[1]).all() and (own[0] != R.NONE).any()
