"""Greedy string tiling against a plain tiling, and what counts as contaminated."""

import random

import numpy as np

from weirworks.llm import tiling as T


def plain(a, b, least):
    """Covered words of a by repeatedly marking the longest common run of unmarked words."""
    a, b, covered = list(a), list(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] != 0:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return covered
        a[i:i + n], b[j:j + n] = [0] * n, [0] * n
        covered += n


def test_tiles_equal_plain_tiling():
    rng = random.Random(2)
    for _ in range(150):
        item = [rng.randint(1, 30) for _ in range(rng.randint(5, 30))]
        cuts = sorted(rng.sample(range(len(item)), 3))
        parts = [item[a:b] for a, b in zip([0, *cuts], [*cuts, len(item)], strict=True)]
        rng.shuffle(parts)
        doc = [x for p in parts for x in [*p, rng.randint(1, 30)]]
        got = T.tiles(np.array(item, np.uint64).tobytes(), np.array(doc, np.uint64).tobytes(), 3)
        assert got[0] == plain(item, doc, 3)


def test_found_also_when_reordered(spark, make, prose, odd):
    items = [(i, prose(40, 5000 + i)) for i in range(12)]
    texts, want = [], set()
    for i in range(60):
        text = prose(80, i)
        if i % 4 == 0:
            item = items[i % 12][1].split()
            if i % 8 == 0:
                item = item[30:] + item[12:30] + item[:12]
            text = text[:50] + " ".join(item).upper() + " " + text[50:]
            want.add((i, i % 12))
        if i % 4 == 1:
            text += " " + " ".join(items[i % 12][1].split()[:14])       # a third of an item is no contamination
        texts.append((i, text))
    bench = spark.createDataFrame(items + [(50, None), (51, ""), (52, "two words"), (0, items[0][1])], "item_id bigint, text string")
    docs = make(texts + odd, repeat=(4,))
    rows = T.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want)
    assert all(r.coverage >= 0.9 for r in rows) and {r.tiles for r in rows if r.doc_id % 8 == 0} != {1}


def test_blocks_and_empty(spark, make, prose, monkeypatch):
    items = [(i, prose(30, 700 + i)) for i in range(9)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = make([(i, prose(10, i) + " " + items[i][1]) for i in range(9)])
    monkeypatch.setattr(T, "BLOCK_WORDS", 70)
    assert {(r.doc_id, r.item_id) for r in T.contaminated(docs, bench).collect()} == {(i, i) for i in range(9)}
    assert T.contaminated(docs.limit(0), bench).count() == 0 and T.contaminated(docs, bench.limit(0)).count() == 0


def test_numbers_of_runs_roll():
    """Equal runs have equal numbers, whatever stands before them; long texts take time in proportion."""
    import time
    rng = np.random.default_rng(5)
    words = rng.integers(1, 2 ** 63, 1000).astype(np.uint64)
    runs = T.Runs(np.concatenate([words, words[100:400], words[:7]]))
    for n in (1, 5, 300):
        numbers = runs.numbers(n)
        assert numbers[100] == numbers[1000] and len(set(numbers[:700].tolist())) == 700
    a = rng.integers(1, 2 ** 63, 100_000).astype(np.uint64)
    b = np.concatenate([rng.integers(1, 2 ** 63, 30_000).astype(np.uint64), a[50_000:90_000], a[:20_000]])
    start = time.time()
    assert T.tiles(a.tobytes(), b.tobytes()) == (60_000, 2, 40_000) and time.time() - start < 20


def test_items_and_documents_without_an_id(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(None, "x " + text), (1, text + " y"), (2, "other words here")], "doc_id long, text string")
    items = spark.createDataFrame([(None, text), (7, text)], "item_id long, text string")
    found = {(r.doc_id, r.item_id, r.coverage) for r in T.contaminated(docs, items).collect()}
    assert found == {(d, i, 1.0) for d in (None, 1) for i in (None, 7)}
