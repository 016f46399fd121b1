"""The stages of the pipeline on a small planted corpus, each on its own input, and the whole run."""

import random

import pytest

import corpus_pipeline as C
from weirworks.llm.queries import QUERIES


@pytest.fixture(scope="module")
def folder(spark, make, prose, odd, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    rng, texts, labels = random.Random(3), [], []
    items = [(i, prose(40, 9000 + i)) for i in range(5)]
    for i in range(260):
        words = prose(70, i).split()
        if i % 5 == 0:
            for _ in range(7):
                words.insert(rng.randrange(len(words)), rng.choice("idiot moron scum".split()))
        if i % 13 == 1 and i % 5:
            words += items[i % 5][1].split()
        if i % 7 == 2:
            words.insert(4, f"me{i}@mail1.example.com")
        texts.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 5 == 0)))
    texts += [(400 + i, texts[i][1].replace(" the ", " these ", 1)) for i in range(1, 40)]
    docs = make(texts + odd, repeat=(6,))
    docs.write.parquet(str(root / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(root / "labels.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(root / "benchmark.parquet"))
    return str(root)


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages(spark, folder):
    docs = spark.read.parquet(folder + "/documents.parquet")
    clean = C.drop_toxic(spark, docs, folder)
    assert clean.columns == C.COLUMNS
    gone = ids(docs) - ids(clean)
    planted = {i for i in range(260) if i % 5 == 0} | {400 + i for i in range(1, 40) if i % 5 == 0}
    assert len(gone & planted) >= 0.95 * len(planted) and len(gone - planted) <= 6
    once = C.drop_near_copies(spark, docs, folder)
    assert not ids(once) & set(range(401, 440)) and ids(docs) - ids(once) == set(range(401, 440))
    fresh = C.drop_contaminated(spark, docs, folder)
    assert ids(docs) - ids(fresh) == {i for i in range(260) if i % 13 == 1 and i % 5} | {400 + i for i in range(1, 40) if i % 13 == 1 and i % 5}
    kept = C.replace_private(spark, docs, folder)
    assert kept.count() == docs.count() and kept.columns == C.COLUMNS
    for r in kept.collect():
        assert not r.text or not any(f"me{k}@" in r.text for k in range(260))
        assert r.n_chars == len(r.text or "")
    assert ids(C.pack_windows(spark, docs, folder)) == ids(docs)


def test_one_row_of_each_group(spark, make, prose, tmp_path):
    """Repeated rows of the smallest id, rows with a null id, and rows without shingles."""
    a, b, c = (prose(60, 100 + i) for i in range(3))
    rows = [(7, a), (7, a), (7, a), (9, a), (None, a), (None, b), (None, b), (3, c), (5, c.replace(" the ", " these ", 1)), (None, None), (None, ""), (8, ""), (8, "")]
    path = str(tmp_path / "rows.parquet")
    make(rows).repartition(4).write.parquet(path)
    kept = C.drop_near_copies(spark, spark.read.parquet(path), path).collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:40]) for r in kept) == sorted([(7, a[:40]), (0, b[:40]), (3, c[:40]), (0, ""), (0, ""), (8, ""), (8, "")])


def test_run(spark, folder):
    out = C.run(spark, folder)
    assert [n for n, _ in C.STAGES][0] == "toxicity" and {900, 901, 902} <= ids(out)
    assert not ids(out) & {401, 402} and out.columns[:3] == ["doc_id", "start", "length"]


def test_registered():
    import __spark_entry__ as entry
    names = entry.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES} and set(QUERIES) <= set(names)
