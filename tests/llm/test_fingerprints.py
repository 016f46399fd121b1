"""SimHash: the edited text, likeness, the search, and what the plan holds."""

import hashlib
import random

from pyspark.sql import functions as F
from weirworks.llm import fingerprints as S


def test_contract_columns(make, prose, odd):
    texts = sorted([(3 * i, prose(30 + i, i)) for i in range(60)] + [(500, prose(40, 7)), (501, prose(40, 7))] + odd)
    rows = {r.doc_id: r for r in S.fingerprint_documents(make(texts, repeat=(3, 900))).collect()}
    assert len(rows) == len(texts)
    for k, (i, t) in enumerate(texts):
        t, following = t or "", texts[(k + 1) % len(texts)][1] or ""
        n = len(t) // 4
        edited = t[:len(t) - n] + following[:n]
        assert rows[i].n_chars == len(t) and rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= rows[i].near_next <= 1 and len(rows[i].fingerprint) == 16
        if edited == t:
            assert rows[i].near_edited == 1
    assert rows[500].fingerprint == rows[501].fingerprint and rows[900].fingerprint == rows[901].fingerprint
    plain = [rows[3 * i] for i in range(60)]
    assert sum(r.near_edited > r.near_next for r in plain) >= 56
    assert rows[500].n_near == 1


def test_search_is_exact(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(40)]
    marks = list({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(8)})
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    df = spark.createDataFrame([(m,) for m in signed], "simhash bigint")
    for radius in (1, 3):
        want = {(a, b) for a in signed for b in signed if bin((a ^ b) & (2 ** 64 - 1)).count("1") <= radius}
        assert {tuple(r) for r in S.within_radius(df, df, radius).collect()} == want


def test_fingerprint_against_plain_votes(spark):
    text = "a b c d e f g h a b c"
    row = spark.range(1).select(F.lit(text).alias("t")).select(S.terms(F.col("t")).alias("x")).first().x
    votes = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in row) > len(row))
    got = S.fingerprint(spark.createDataFrame([(1, text)], "i int, t string"), ["i"], F.col("t")).first().simhash
    assert got & (2 ** 64 - 1) == votes and len(row) == 9


def test_native_and_empty(make):
    df = S.fingerprint(make([(1, "a b c d")]), ["doc_id"], F.col("text"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert S.fingerprint_documents(make([(1, "x")]).limit(0)).count() == 0
