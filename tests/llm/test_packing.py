"""Packing: an exact round trip of all ids, gapless offsets, little padding; ids equal the library's."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from weirworks.llm.bpe import Encoder  # noqa: E402
from weirworks.llm.packing import Windows, _placed, pack  # noqa: E402


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_ids_equal_the_library(tokenizer, prose, odd):
    own = Encoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"))
    texts = [t or "" for _, t in odd] + [prose(200, 1), "a  b \n c\n\nd  ", " lead", "x<|endoftext|>y", "it's I'll so　 z", "tab\there 12345 ...!?", "a  b"]
    for t in texts:
        assert np.frombuffer(own.ids(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_round_trip(tokenizer, make, prose, odd):
    texts = [(i, prose(40 + 60 * (i % 25), i)) for i in range(120)] + odd
    rows = pack(make(texts)).collect()
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    assert set(pieces) == {i for i, _ in texts}
    for i, t in texts:
        ids, at = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in windows.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert sum(r.length for r in rows) / (2048 * len(windows)) > 0.97


def test_repeated_rows_and_empty(make):
    rows = pack(make([(1, "a b c"), (2, None)], repeat=(1,))).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == [(1, 4), (1, 4), (2, 1)]
    assert pack(make([(1, "x")]).limit(0)).count() == 0


def test_windows_stay_bounded():
    windows, used = Windows(0, 100), defaultdict(int)
    for n in [60] * 50 + [30] * 70 + [250, 99, 1, 41] * 9:
        for _, length, window, offset in _placed(windows, n, 8, 4):
            assert offset == used[window] and offset + length <= 100
            used[window] += length
            assert len(windows.open) <= 8
    assert sum(used.values()) == 60 * 50 + 30 * 70 + 391 * 9
