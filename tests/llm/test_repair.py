import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from weirworks.llm import repair
from weirworks.llm.chunks import Encoder

WIDE = ["  a  b\n\n c\t", "é é x  　y", " \n\n x", "a\xa0\n\nb c", "日本 語、 あ", "x" * 10 + "   ", "", "don't we'll  \r\n\n  go",
        "   a  ", "a\x85 \x85\n b", " ’ ‘ ​ z", "\x1c \x1c x", "   lead", " lead  ", "see <|endoftext|> end", " а б  в 🙂  "]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def expected(reference, rows):
    """The contract, one document after the other."""
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*reference.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_encoder_gives_the_ids_of_tokenizers(reference, prose):
    import pyarrow as pa
    texts = [*WIDE, None, *(prose(n, n) for n in (1, 50, 3000))]
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for column in (pa.array(texts), pa.array(texts[1:], pa.large_string()), pa.array(["x", *texts]).slice(1)):
        ids, counts = encoder.encode(column)
        ends = np.cumsum(counts)
        for text, a, b in zip(column.to_pylist(), ends - counts, ends, strict=True):
            assert ids[a:b].tolist() == reference.encode(text or "", add_special_tokens=False).ids, text


def test_grammar_round_trip():
    rng = np.random.default_rng(3)
    for vocabulary in (1, 2, 7, 300):
        tokens = np.append(rng.integers(1, 400, 60), [1, 1, 5000])
        ids = rng.integers(0, vocabulary, tokens.sum()).astype(np.uint32)
        edges = np.append(0, np.cumsum(tokens))
        grammar, seq, cut = repair.compress(ids, edges)
        assert (grammar.expand(seq) == ids).all() and (grammar.whole(seq) == ids).all() and len(seq) <= len(ids)
        assert (grammar.size(seq).cumsum()[cut[1:] - 1] == edges[1:]).all()      # each document has its own symbols
        for a, n in ((0, 1), (17, 200), (len(ids) - 9, 9)):
            assert grammar.slice(seq, a, n).tolist() == ids[a:a + n].tolist()
        assert len(seq) + 3 * len(grammar.left) < len(ids) or vocabulary == 300   # pairs of few symbols repeat


def test_rules_nest_and_repeats_shrink():
    ids = np.tile(np.arange(64, dtype=np.uint32), 200)
    grammar, seq, _ = repair.compress(ids, np.array([0, len(ids)]))
    assert grammar.lengths.max() >= 64 and len(seq) < len(ids) / 40


def test_documents_against_tokenizers(spark, make, reference, prose, odd, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", 2000)               # many blocks, and documents larger than one
    monkeypatch.setattr(repair, "SHARD_BYTES", 20_000)
    rows = [(i, prose(40 + 7 * i, i)) for i in range(80)] + odd + [(7, prose(47 + 42, 7)), (None, "no id")]
    rows = [(i, t) for i, t in rows if i != 7] + [(7, "same text"), (7, "same text")]
    got = [tuple(r) for r in repair.tokenize_documents(make(rows)).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected(reference, rows)


def test_ids_and_ranges(spark, make, reference, prose, tmp_path):
    rows = [(i, prose(200, i)) for i in range(30)] + [(99, None)]
    blocks = repair.write_tokens(make(rows), str(tmp_path / "ids"))
    ids = {i: [*reference.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    assert {r.doc_id: r.ids for r in repair.read_tokens(blocks).collect()} == ids
    wanted = spark.createDataFrame([(3, 10, 25), (29, 0, 10**6), (99, 0, 1), (5, 10**6, 4), (1000, 0, 5)], "doc_id long, from long, length long")
    found = {r.doc_id: r.ids for r in repair.token_ranges(blocks, wanted).collect()}
    assert found == {3: ids[3][10:35], 29: ids[29], 99: [0], 5: []}


def test_empty_table(make):
    assert repair.tokenize_documents(make([(1, "x")]).where("doc_id = 2")).collect() == []
