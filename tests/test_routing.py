"""Routing rules, signals, learner advice and the join forms."""

from pyspark.sql import functions as F

from weirworks import dims
from weirworks.operators import learning as L
from weirworks.operators import routing as R

CASES = [
    ("list files under src", "no_llm", "1"), ("Git Status please", "no_llm", "1"), ("how many lines has this repo", "no_llm", "1"),
    ("write docstring for parse()", "local", "1"), ("a commit message for the last change", "local", "1"),
    ("write a regex for dates", "local", "1"), ("crud endpoint for users", "local", "1"),
    ("debug this crash in the parser", "cloud", "1"), ("architect a queueing system", "cloud", "1"),
    ("find the race condition here", "cloud", "1"), ("give me a hello world", "local", "2"),
    ("novel scheduler across the codebase with a database migration", "cloud", "2"),
]


def prompts(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "task_id bigint, text string")


def test_routes_at_the_default_level(spark):
    got = R.route(prompts(spark, [c[0] for c in CASES])).orderBy("task_id").collect()
    assert [(r.route, r.classification_layer) for r in got] == [(route, layer) for _, route, layer in CASES]


def test_ceilings_follow_the_level_table(spark):
    text = [["architect a queueing system"]]
    by_level = {level: R.route(prompts(spark, text[0]), level).first() for level in range(6)}
    assert [by_level[n].route for n in range(6)] == ["cloud", "cloud", "cloud", "cloud", "cloud", "local"]
    assert by_level[2].suggested_model is None and "exceeds ceiling (3)" in by_level[2].reason
    assert by_level[3].suggested_model == "cloud-sonnet" and by_level[3].reason.endswith("→ cloud")


def test_rule_and_phrase_order(spark):
    rows = R.match_rules(prompts(spark, ["street map", "convert format and show imports", "nothing"])).orderBy("task_id").collect()
    assert [r.matched_phrase for r in rows] == ["tree", "show imports", None]
    assert len(dims.RULES) == 32 and sum(len(r[5]) for r in dims.RULES) == 174


def test_word_edges_are_ascii(spark):
    rows = R.extract_signals(prompts(spark, ["étest", "testé", "test_x", "test"])).orderBy("task_id").collect()
    assert [r.cost_of_wrong for r in rows] == ["trivial", "trivial", "low", "trivial"]


def test_marked_examples_need_a_following_word(spark):
    rows = R.extract_signals(prompts(spark, ["e.g.this", "e.g. this", "pattern:x", "pattern: x", "an example"])).orderBy("task_id").collect()
    assert [r.has_examples for r in rows] == [True, False, True, False, True]


def test_counts_and_caps_of_depth(spark):
    text = "first this, then that, next more, finally done, second, third; if when while unless ensure"
    row = R.extract_signals(prompts(spark, [text])).first()
    assert abs(row.reasoning_depth - 0.75) < 1e-12


def test_score_text_rounds_on_the_exact_value(spark):
    from weirworks.functions.text import to_fixed
    rows = spark.createDataFrame([(0.285,), (0.125,), (1.005,), (0.995,), (12.0,), (16.65,)], "x double")
    got = [tuple(r) for r in rows.select(to_fixed(F.col("x"), 2), to_fixed(F.col("x"), 1)).collect()]
    assert got == [("0.28", "0.3"), ("0.13", "0.1"), ("1.00", "1.0"), ("0.99", "1.0"), ("12.00", "12.0"), ("16.65", "16.6")]


def rules(spark):
    rows = [(0, 0, "zz", "two"), (0, 1, "alpha beta gamma delta", "long"), (1, 0, "q", "one"), (2, 0, "beta", "word"),
            (2, 1, "alpha beta x", "near"), (3, 0, "BETA", "late")]
    return spark.createDataFrame(rows, "rule_ord int, phrase_ord int, phrase string, target string")


def test_user_rules_by_expression_and_by_join(spark):
    texts = ["Alpha Beta Gamma Delta q", "alpha beta x", "fizz buzz", "quiet", "nothing here", "", "beta " * 400 + "zz"]
    want = []
    ordered = sorted(rules(spark).collect(), key=lambda r: (r.rule_ord, r.phrase_ord))
    for t in texts:
        hit = next((r for r in ordered if r.phrase.lower() in t.lower()), None)
        want.append((hit.phrase.lower(), hit.target) if hit else (None, None))
    for chars in (10 ** 6, 1):
        got = R.match_user_rules(prompts(spark, texts), rules(spark), block_chars=chars).orderBy("task_id").collect()
        assert [(r.matched_phrase, r.target) for r in got] == want


def test_commands(spark):
    df = prompts(spark, ["CS ask  what? ", "ask local hi", "/pod:ask x", "cs status", "cs reset", "cs asking", "cs ask"])
    got = df.select(R.parse_command(F.col("text"), "pod").alias("c")).select("c.*").collect()
    assert [tuple(r) for r in got] == [("ask", "what?"), ("ask", "hi"), ("ask", "x"), ("status", ""), ("reset", ""), (None, None), (None, None)]


def test_learner_case(spark):
    rows = [("code_gen", 2, "success")] * 54 + [("code_gen", 2, "escalated")] * 6
    row = L.learner(spark.createDataFrame(rows, "task_type string, level_used int, outcome string")).first()
    assert (row.n, row.adjusted_level, row.sample_size) == (60, 1, 60) and row.confidence_adjustment > 0
    assert row.reason == "code_gen at level 2: 90% success (60 samples)"


def test_learner_guards(spark):
    def advice(n):
        rows = [("text", 1, "success")] * n
        return L.routing_advice(spark.createDataFrame(rows, "task_type string, level_used int, outcome string"))
    few = advice(7).where("task_type = 'text' AND level_used = 3").first()
    assert few.reason == "Insufficient data (7/50 records)" and few.sample_size == 7
    other = advice(60).where("task_type = 'analysis' AND level_used = 3").first()
    assert other.reason == 'Insufficient data for task type "analysis"' and other.sample_size == 0
    cell = advice(60).where("task_type = 'text' AND level_used = 3").first()
    assert cell.reason == "Insufficient data at level 3"


def test_fingerprint_ignores_order_and_case(spark):
    from weirworks.functions.text import fingerprint
    df = prompts(spark, ["Write tests for parser", "parser FOR write, tests!", "other words"])
    a, b, c = [r[0] for r in df.select(fingerprint(F.col("text"))).collect()]
    assert a == b != c

    def plain(text):
        import re
        words = sorted(w for w in re.split(r"\s+", re.sub(r"[^a-z0-9\s]", "", text.lower())) if len(w) > 2)
        h = 0
        for ch in " ".join(words):
            h = (h * 31 + ord(ch)) & 0xFFFFFFFF
        h = abs(h - (1 << 32) if h >= 1 << 31 else h)
        digits = ""
        while h:
            digits, h = "0123456789abcdefghijklmnopqrstuvwxyz"[h % 36] + digits, h // 36
        return digits or "0"
    assert a == plain("Write tests for parser") and c == plain("other words")


def test_empty_and_null_phrases_mean_the_same_on_both_paths(spark):
    rows = [(1, 1, "parse", "a"), (2, 1, "", "b"), (2, 2, None, "c"), (3, 1, "crash", "d")]
    texts = ["parse this", "a crash", "", "none"]
    for kept in (rows, rows[1:3], rows[2:3], [rows[0], rows[3]], []):
        rules = spark.createDataFrame(kept, "rule_ord int, phrase_ord int, phrase string, target string")
        asked = spark.createDataFrame([*enumerate(texts), (9, None)], "task_id bigint, text string")
        few, many = (R.match_user_rules(asked, rules, block_chars=n).select("task_id", "matched_phrase", "rule_ord", "phrase_ord", "target")
                     for n in (10 ** 6, 1))
        got = sorted(map(tuple, few.collect()))
        assert got == sorted(map(tuple, many.collect()))
        if kept is rows:
            assert [r[4] for r in got] == ["a", "b", "b", "b", None]


def test_a_look_ahead_changes_no_match(spark):
    import random
    import re

    from pyspark.sql import functions as F

    from weirworks.functions.text import Words, ahead, key_words
    words = ["fix", "fixes", "go", "json", "if", "a1", "while", "security", "yaml", "csv", "rest", "test", "tests"]
    rng = random.Random(5)
    texts = ["".join(rng.choice([*words, " ", "_", "-", "é", ".", "x", "\n"]) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    rx = re.compile(r"\b(?:" + "|".join(sorted(words, key=len, reverse=True)) + r")\b", re.A)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.w for r in df.select("i", key_words(F.col("t"), Words(*words)).alias("w")).collect()}
    assert got == {i: rx.findall(t) for i, t in enumerate(texts)}
    assert ahead(["ab", "c-e"]) == r"(?=[ac][\-b])" and ahead(["", "b"]) == ""
