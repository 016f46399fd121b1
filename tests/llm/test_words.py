"""Word numbers against Python's own splitting."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from weirworks.llm.exchange import decode, encode, summed
from weirworks.llm.words import Powers, grams, pieces


def test_words_are_what_split_gives():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aAbé \t\n\x0b|  ") for _ in range(rng.randint(0, 40))) for _ in range(500)] + [None, "", "x" * 5000]
    seen = {}
    for size in (1, 100, 10 ** 6):
        for low, high, w in pieces(pa.array(texts), size=size):
            for i in range(low, high):
                want = (texts[i] or "").encode().lower().split()
                own = w.hash[w.ptr[i - low]:w.ptr[i - low + 1]]
                assert len(own) == len(want)
                for word, number in zip(want, own.tolist(), strict=True):
                    assert seen.setdefault(word, number) == number
    assert len(set(seen.values())) == len(seen)


def test_prefixes_and_letters():
    _, _, w = next(pieces(pa.array(["idiot, IDIOTIC!! x"]), letters=True))
    assert len(w.hash) == 3 and w.prefix(5)[0] == w.prefix(5)[1] == w.hash[0] and w.prefix(9)[2] == w.hash[2]


def test_grams_depend_on_order_and_length():
    a = np.arange(1, 7, dtype=np.uint64)
    assert len(grams(a, 3)) == 4 and len(grams(a, 7)) == 0
    assert grams(a, 2)[0] != grams(a[::-1].copy(), 2)[-1] and grams(a, 1)[0] != a[0]


def test_key_round_trip():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 2 ** 63, 1000).astype(np.uint64) * np.uint64(2))
    values = rng.integers(0, 2 ** 32, (len(keys), 2)).astype(np.uint32)
    got = decode(encode(keys, values))
    assert (got[0] == keys).all() and (got[1] == values).all()
    assert len(decode(encode(keys[:0], values[:0]))[0]) == 0
    both = summed(np.concatenate([keys, keys[:5]]), np.concatenate([values // 2, values[:5] // 2]))
    assert (both[0] == keys).all() and (both[1][:5] == values[:5] // 2 * 2).all()


def test_memory_of_pieces_is_bounded(monkeypatch):
    for side in ("up", "down"):
        monkeypatch.setattr(Powers, side, getattr(Powers, side)[:1 << 10].copy())
    column = pa.array(["some words of a text " * 100] * 4000)          # 8 MB
    tracemalloc.start()
    try:
        words = sum(len(w.hash) for _, _, w in pieces(column))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert words == 4000 * 500 and peak < 60_000_000
