"""User rules of any number, against the plain rule: the first phrase in order that the text contains."""

import random

import pytest

from weirworks.operators import phrases as P
from weirworks.operators import routing as R

RULES = "rule_ord int, phrase_ord bigint, phrase string, target string, weight double, tags array<string>"


def first(rules, text):
    if text is None:
        return None
    hits = [r for r in rules if r[2] is not None and r[2].lower() in text.lower()]
    return min(hits, key=lambda r: (r[0], r[1], r[2].lower())) if hits else None


def random_rules(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé🙂 ") for _ in range(rng.randrange(1, 7)))
    return [(rng.randrange(n // 2), i, None if i % 50 == 7 else word().upper() if i % 3 else word(), f"t{i}", i / 3, ["x"] * (i % 3)) for i in range(n)]


@pytest.mark.parametrize("chars", [10 ** 6, 60])
def test_against_the_plain_rule(spark, chars):
    rules = random_rules(60, 1)
    rng = random.Random(5)
    texts = [None, "", "nothing", *("".join(rng.choice("abcdé🙂 xyz") for _ in range(rng.randrange(40))) for _ in range(200))]
    rows = [(None if i % 7 == 0 else i % 9, t, "old") for i, t in enumerate(texts)]           # null and repeated keys
    prompts = spark.createDataFrame(rows, "task_id int, text string, target string").repartition(4)
    got = R.match_user_rules(prompts, spark.createDataFrame(rules, RULES), block_chars=chars)
    want = []
    for key, text, _ in rows:
        hit = first(rules, text)
        want.append((key, text, *((hit[2].lower(), *hit[:2], *hit[3:]) if hit else (None,) * 6)))
    rows = [tuple(r) for r in got.select("task_id", "text", "matched_phrase", "rule_ord", "phrase_ord", "target", "weight", "tags").collect()]
    assert sorted(rows, key=str) == sorted(want, key=str)


def test_many_rules_are_cut_into_blocks(spark):
    """100,000 phrases: blocks keep to their bound, and each is only as large as it says."""
    rules = spark.range(100_000).selectExpr("id AS rule_ord", "0 AS phrase_ord", "concat('phrase number ', id, ' end') AS phrase")
    blocks = P.rule_blocks(rules, 500_000)
    assert len(blocks) >= 4
    books = [P.Book(b) for b in blocks]
    sizes = [sum(map(len, b.rows.column(2).to_pylist())) for b in books]
    assert max(sizes) < 1_500_000 and sum(b.rows.num_rows for b in books) == 100_000
    assert [b.rows.column(0)[0].as_py() for b in books] == sorted(b.rows.column(0)[0].as_py() for b in books)
    prompts = spark.createDataFrame([("see phrase number 99999 end, phrase number 70000 end",), ("phrase number 5 en",), (None,)], "text string")
    got = R.match_user_rules(prompts, rules, block_chars=500_000).collect()
    assert [r.rule_ord for r in got] == [70000, None, None]


def test_a_worker_holds_one_block():
    import pyarrow as pa
    data = [P._stream(pa.table({"rule_ord": [n], "phrase_ord": [0], "phrase": [f"p{n}"]})) for n in range(3)]
    for n, block in enumerate(data):
        assert P._book(str(n), lambda block=block: block).first(f"a p{n} b") == 0
        assert len(P._OPEN) == 1


def test_dominated_phrases_leave_the_automaton():
    import pyarrow as pa
    book = P.Book(P._stream(pa.table({"rule_ord": [0, 1, 2, 3, 4], "phrase_ord": [0] * 5, "phrase": ["ab", "xaby", "b", "", "q"]})))
    assert len(book.words) == 2                         # xaby holds ab; what follows the empty phrase is never first
    assert [book.first(t) for t in ("xaby", "b", "q", "")] == [0, 2, 3, 3]


def test_no_shuffle_and_one_scan_of_the_texts(spark, sf_dir):
    prompts = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rules = spark.createDataFrame([(1, 1, "the", "x")], "rule_ord int, phrase_ord int, phrase string, target string")
    plan = R.match_user_rules(prompts, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Scan parquet") == 1 and plan.count("ArrowEvalPython") == 1


def test_empty_rules(spark):
    none = spark.createDataFrame([], RULES)
    row = R.match_user_rules(spark.createDataFrame([("x",)], "text string"), none).first()
    assert row.matched_phrase is None and row.rule_ord is None and row.tags is None
