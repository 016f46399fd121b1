import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from weirworks.llm import treap

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, k=20):
    """Every document against every item: {item: [(doc, score)]}."""
    counted = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = {}
    for item, text in items:
        scores = []
        for doc, c in counted:
            m = 100 - 25 + (25 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m))
                        for t in terms(text) if c[t])
            if score > 0:
                scores.append((doc, score))
        if scores:
            out[item] = sorted(scores, key=lambda r: (-r[1], r[0] is None, r[0] or 0))[:k]
    return out


def ranked(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.item_id is not None, r.item_id or 0, r.rank)):
        out.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert r.rank == len(out[r.item_id])
    return out


@pytest.mark.parametrize("small", [False, True])
def test_against_every_pair(spark, make, prose, odd, monkeypatch, small):
    if small:                                            # many blocks, few documents in each, ranges opened one by one
        for name, value in {"BLOCK_TERMS": 300, "BLOCK_DOCS": 7, "RANGES": 1, "OPENED": 1, "ITEM_TERMS": 40}.items():
            monkeypatch.setattr(treap, name, value)
    docs = [(i, prose(5 + 3 * (i % 50), i % 90)) for i in range(150)] + odd + [(3, prose(9, 99)), (None, prose(60, 5)), (None, prose(60, 5))]
    rng = random.Random(4)
    items = [(i, " ".join(rng.sample(prose(200, i).split(), 12)) + (" the the The" if i % 2 else "")) for i in range(12)]
    items += [(50, None), (51, ""), (52, "nowhereatall"), (53, "the"), (54, "ÜNÏCODE ünïcode 漢字-one"), (None, "of words one")]
    table = spark.createDataFrame(items, "item_id long, text string")
    assert ranked(treap.rank_documents(make(docs), table)) == brute(docs, items)
    assert ranked(treap.rank_documents(make(docs), table, k=3)) == brute(docs, items, 3)


def test_repeated_items_are_ranked_each(spark, make, prose):
    docs = [(i, prose(20, i)) for i in range(30)]
    items = [(1, "the of and"), (1, "the of and"), (2, "w7 w8")]
    rows = treap.rank_documents(make(docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows if r["item_id"] == 1)
    assert found and set(found.values()) == {2}


def test_empty_tables(spark, make):
    items = spark.createDataFrame([(1, "x")], "item_id long, text string")
    assert treap.rank_documents(make([(1, "x")]).where("doc_id = 2"), items).collect() == []
    assert treap.rank_documents(make([(1, "x")]), items.where("item_id = 2")).collect() == []


def test_tree_holds_points_and_maxima():
    rng = np.random.default_rng(1)
    for rows, columns, n in ((1, 1, 1), (1000, 3, 700), (5, 900, 900), (300, 300, 5000)):
        points = np.unique(rng.integers(0, rows * columns, n))
        row, column, impact = points // columns, points % columns, rng.integers(1, 10 ** 6, len(points))
        tree = treap.Tree.unpack(*treap.Tree.pack(row, column, impact))
        grid = np.zeros((rows, columns), np.int64)
        grid[row, column] = impact
        level, nodes = tree.start(np.arange(rows), columns)
        width = 1 << (tree.height - level)
        for i in range(nodes.shape[1]):
            part = grid[:, i * width:(i + 1) * width]
            assert (tree.values[nodes[:, i]] >= part.max(1)).all()         # a cell's maximum bounds the row's points in it
        while level < tree.height:
            nodes = np.stack(tree.open(nodes, np.arange(rows), np.full(nodes.shape[1], level)), 2).reshape(rows, -1)
            level += 1
        assert (tree.values[nodes][:, :columns] == grid).all()


def test_search_leaves_most_ranges_closed():
    rng = np.random.default_rng(2)
    columns = 4096
    points = np.unique(rng.integers(0, 500, 60_000) * columns + rng.integers(0, columns, 60_000))
    impact = rng.integers(1, 1000, len(points))
    tree = treap.Tree.unpack(*treap.Tree.pack(points // columns, points % columns, impact))
    rows, weights = np.arange(4), np.array([9, 5, 3, 1])
    grid = np.zeros((500, columns), np.int64)
    grid[points // columns, points % columns] = impact
    exact = weights @ grid[:4]
    level, nodes = tree.start(rows, columns)
    opened = []
    plain, tree.open = tree.open, lambda n, *rest: opened.append(n.shape[1]) or plain(n, *rest)
    found, scores = treap.best(tree, rows, weights, level, nodes, 5, 0)
    assert (exact[found] == scores).all() and sorted(scores)[-5:] == sorted(exact)[-5:]
    assert set(np.flatnonzero(exact >= np.sort(exact)[-5])) <= set(found)
    assert sum(opened) < columns
