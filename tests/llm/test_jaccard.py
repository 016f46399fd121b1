"""The Jaccard join and its components against all pairs, also where segments collide."""

import random
from itertools import combinations

import numpy as np
import pytest
from weirworks.llm import jaccard as J
from weirworks.llm.graph import components


def shingle_set(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k:k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(texts, width, percent):
    sets = {i: shingle_set(t, width) for i, t in texts}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
    return {i: (len(sets[i]), root(i)) for i in sets}


def edited(text, rng, n):
    words = text.split()
    for _ in range(n):
        k = rng.randrange(len(words))
        words[k:k + 1] = rng.choice([[], ["new%d" % rng.randrange(10 ** 6)], [words[k], "more%d" % rng.randrange(99)]])
    return " ".join(words)


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_equals_all_pairs(make, prose, odd, width, percent):
    rng = random.Random(width)
    texts = []
    for g in range(30):
        base = prose(rng.choice([4, 9, 15, 40, 120, 300]), 1000 + g)
        chain = base
        for k in range(8):
            chain = edited(chain, rng, rng.randint(0, 1 + len(base.split()) // 40))     # chains: the ends need not be linked
            texts.append((g * 8 + k, chain.upper() if k == 3 else chain))
    texts += odd
    rows = J.jaccard_components(make(texts, repeat=(5, 901)), width, percent).collect()
    want = brute(texts, width, percent)
    assert len(rows) == len(texts) + 2
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want


@pytest.mark.parametrize("margin", [64, -10 ** 9])
def test_passages_that_many_share(make, prose, margin):
    """Texts that share most of their words collide in whole segments without being linked; with a low margin every
    open pair goes through the one-deletion index."""
    passage, rng = prose(60, 77), random.Random(5)
    texts = [(i, prose(14, i) + " " + passage) for i in range(100)]
    texts += [(500 + i, edited(t, rng, 1 + i % 2)) for i, t in texts[:60]]
    rows = J.jaccard_components(make(texts), 3, 90, margin).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(texts, 3, 90)


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_signature(percent):
    """The pigeonhole bounds on random sets: whole segments, and whole against one-deletion segments."""
    rng, bands = np.random.default_rng(percent), J.Bands(percent)
    for _ in range(1500):
        n = int(rng.integers(1, 90))
        base = rng.integers(1, 2 ** 63, n).astype(np.uint64)
        change = int(rng.integers(0, max(1, n // 4) + 1))
        other = np.unique(np.concatenate([base[rng.permutation(n)[:max(1, n - int(rng.integers(0, change + 1)))]], rng.integers(1, 2 ** 63, int(rng.integers(0, change + 1))).astype(np.uint64)]))
        base = np.unique(base)
        same = len(np.intersect1d(base, other))
        if 100 * same >= percent * (len(base) + len(other) - same):
            assert len(np.intersect1d(J.signatures(base, bands), J.signatures(other, bands)))
            (wa, la), (wb, lb) = J.neighbourhoods(base, bands), J.neighbourhoods(other, bands)
            assert len(np.intersect1d(wa, np.concatenate([wb, lb]))) or len(np.intersect1d(la, wb))


@pytest.mark.parametrize("percent,width", [(80, 5), (90, 3)])
def test_long_texts_meet_only_where_they_share(make, percent, width):
    """Long sets leave some segments empty; these are equal in all sets of a band, and must not make all pairs candidates."""
    rng, bands = np.random.default_rng(7), J.Bands(percent)
    seen = [set(J.signatures(np.unique(rng.integers(1, 2 ** 63, int(n)).astype(np.uint64)), bands).tolist()) for n in rng.integers(1000, 4000, 40)]
    assert not any(x & y for x, y in combinations(seen, 2))
    texts = [(i, " ".join(f"w{rng.integers(10 ** 9)}" for _ in range(1500))) for i in range(12)]
    texts += [(100 + i, edited(t, random.Random(i), k)) for i, t in texts[:6] for k in (20, 90)][::2]
    rows = J.jaccard_components(make(texts), width, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(texts, width, percent)


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(50)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(90)]
    rows = dict(components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    label = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert rows == {n: v for n, v in label.items() if n in rows} and {n for a, b in edges if a != b for n in (a, b)} == set(rows)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_empty_table(make):
    assert J.jaccard_components(make([(1, "x")]).limit(0)).count() == 0
