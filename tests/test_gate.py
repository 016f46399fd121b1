"""Gate checks, verdicts and settled attempts."""

from pyspark.sql import functions as F

from weirworks import dims
from weirworks.operators import gate as G

GOOD = "def run(a):\n    return a\n" * 5


def judged(spark, text, language="python", options=dims.GateOptions(), **extra):
    df = spark.createDataFrame([(text, language)], "response string, expected_language string")
    for name, value in extra.items():
        df = df.withColumn(name, F.lit(value) if not isinstance(value, list) else F.array(*[F.lit(v) for v in value]))
    return G.quality_gate(df, options).first()


def signals(spark, text, language=None):
    df = spark.createDataFrame([(text, language)], "response string, expected_language string")
    return G.failure_signals(df).first().failure_signals


def test_signals(spark):
    assert signals(spark, "  ok  ") == ["empty_output"]
    assert signals(spark, "I'M NOT ABLE to do this") == ["refusal"]
    assert signals(spark, "maybe this, perhaps that, possibly more") == ["confidence_caveat"]
    assert signals(spark, "to be done: HACK here") == ["placeholder_markers"]
    assert signals(spark, "todo in lower case is fine") == []
    assert signals(spark, "if (a) { b { c {" + " more") == ["incomplete"]
    assert signals(spark, "and so on it goes ...") == ["incomplete"]
    assert signals(spark, "package main\nfunc go(a) { }", "python") == ["wrong_language"]
    assert signals(spark, "package main\nfunc go(a) { }", "cobol") == []
    assert signals(spark, "{\"a\": [1, 2}", "json") == ["syntax_error"]
    assert signals(spark, "{\"a\": [1, 2]} ", "JSON") == []
    assert signals(spark, "x = )))  # three closers", "python") == ["syntax_error"]
    assert signals(spark, "text ]]] }}}\n```js\nfine()\n```", "javascript") == []


def test_a_verdict_is_major_for_two_or_one_critical(spark):
    df = spark.createDataFrame([([],), (["incomplete"],), (["refusal"],), (["incomplete", "syntax_error"],)], "s array<string>")
    assert [r[0] for r in df.select(G.verdict(F.col("s"))).collect()] == ["none", "minor", "major", "major"]


def test_checks(spark):
    assert judged(spark, GOOD).accepted
    row = judged(spark, GOOD + "# TODO later")
    assert row.should_escalate and row.hard_failures[0].reason == "Found placeholder marker: TODO"
    row = judged(spark, GOOD + " could be, it seems, maybe")
    assert row.should_retry and row.soft_failures[0].reason == "Excessive hedging: 3 instances"
    assert judged(spark, GOOD, expected_tokens=1000).soft_failures[0].reason.startswith("Output disproportionately short")
    assert judged(spark, GOOD, expected_tokens=3).soft_failures[0].reason.startswith("Output disproportionately long")
    assert judged(spark, GOOD, expected_tokens=0).accepted
    assert judged(spark, "x" * 12).hard_failures[0].reason == "Output too short: 12 chars (min 20)"
    assert judged(spark, GOOD * 100).hard_failures[0].reason.startswith("Output too long: ")


def test_scope_and_sections(spark):
    text = "see src/app/main.py and ./lib/other.ts, with Setup\n" + GOOD
    assert judged(spark, text, allowed_files=["app/main.py", "x\\lib\\other.ts"]).hard_failures[0].reason == "Files outside scope: ./lib/other.ts"
    assert judged(spark, text, allowed_files=["app/main.py", "other.ts"]).accepted
    assert judged(spark, text, required_sections=["setup", "a)"]).hard_failures[0].reason == "Missing sections: a)"
    assert judged(spark, text, allowed_files=["nope.md"], options=dims.GateOptions(check_scope=False)).checks_total == 6


def test_major_signals_stand_for_one_check(spark):
    row = judged(spark, "no")
    assert (row.checks_passed, row.checks_total, row.should_escalate) == (0, 1, True)
    assert row.checks[0].reason == "Local model failed: empty_output"


def attempts(spark, rows):
    df = spark.createDataFrame(rows, "task_id int, attempt_no int, response string, tokens_used bigint")
    return df.selectExpr("*", "tokens_used * 2 AS duration_ms", "'m' || attempt_no AS model", "'t' AS tool", "CAST(NULL AS STRING) AS expected_language")


SOFT = GOOD + " could be, it seems, maybe"
HARD = GOOD + "# FIXME"


def test_settling(spark):
    rows = [(1, 1, GOOD, 10), (1, 2, GOOD, 5), (2, 1, SOFT, 10), (2, 2, GOOD, 7), (3, 1, SOFT, 10), (3, 2, HARD, 7), (4, 1, HARD, 10),
            (5, 1, None, 0), (6, 1, SOFT, 10), (6, 2, None, 0), (7, 1, SOFT, 10), (8, 1, SOFT, 10), (8, 2, SOFT, 4)]
    got = {r.task_id: r for r in G.resolve_attempts(attempts(spark, rows)).collect()}
    brief = {k: (r.quality_status, r.attempt_count, r.tokens_used, r.output_tokens, r.logged) for k, r in got.items()}
    assert brief == {
        1: ("accepted", 1, 10, 10, True), 2: ("retried_accepted", 2, 17, 7, True), 3: ("escalated", 2, 17, 7, True),
        4: ("escalated", 1, 10, 10, True), 5: ("escalated", 1, None, None, False), 6: ("escalated", 2, None, None, False),
        7: ("escalated", 2, None, None, False), 8: ("escalated", 2, 14, 4, True)}
    assert got[3].failure_reasons == ["Excessive hedging: 3 instances", "Found placeholder marker: FIXME"]
    assert got[8].failure_reasons == ["Excessive hedging: 3 instances"]
    off = {r.task_id: r.quality_status for r in G.resolve_attempts(attempts(spark, rows), allow_retry=False).collect()}
    assert off[2] == "escalated"


def test_payload(spark):
    rows = [(3, 1, SOFT, 10), (3, 2, HARD, 7)]
    row = G.escalation_payload(G.resolve_attempts(attempts(spark, rows))).first()
    assert row.message == "Local model failed after 2 attempts. Reasons: Excessive hedging: 3 instances; Found placeholder marker: FIXME"
    assert row.escalation_message.endswith("instances. Found placeholder marker: FIXME.")


def test_sections_are_searched_only_where_their_letters_stand(spark):
    from weirworks.functions import checks as K
    text = "Over it all; RETURN A here; the Été part, İover"
    sections = ["over", "return a", "été", "Été", "all", "al", ""]
    df = spark.createDataFrame([(text, sections)], "t string, s array<string>")
    missing = df.select(K.missing_sections(F.col("t"), F.col("s"), F.lower("t")).alias("m")).first().m
    plain = df.selectExpr(r"filter(s, x -> NOT rlike(t, concat('(?i)(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))', x, "
                          r"'(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))'))) AS m").first().m
    assert missing == plain and "al" in missing and "over" not in missing


def test_brackets_and_open_blocks_equal_a_walk(spark):
    import random
    from weirworks.functions import checks as K
    rng = random.Random(3)
    texts = ["", "()" * 500, "(" * 9 + ")" * 9, "((x)(y))" * 40 + ")))", "(" * 3, None]
    texts += ["".join(rng.choice("(()) x\u00e9\n"[: rng.choice([4, 8])]) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    texts += ["(" * k + "a" * (k % 3) + ")" * (k + d) for k in range(12) for d in range(-4, 5) if k + d >= 0]

    def walk(text):
        depth = low = 0
        for c in text or "":
            depth += (c == "(") - (c == ")")
            low = min(low, depth)
        return low < -2 or abs(depth) > 2

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").select(
        "id", K.unbalanced(F.col("t"), "(", ")").alias("u"), K.left_open(F.col("t"), "(", ")").alias("o"))
    for r in df.collect():
        t = texts[r.id]
        assert r.u == walk(t), t
        assert r.o == (None if t is None else t.count("(") - t.count(")") > 2), t


def test_signs_with_one_of_several_words(spark):
    from weirworks.functions import checks as K
    rx = K.LANGUAGE_SIGNS["typescript"][0]
    rows = {"a:  boolean": True, "a: string,": True, "b :number": True, "c: strings": False, "string": False, "d: int; number": False}
    got = spark.createDataFrame([(t,) for t in rows], "t string").select("t", rx.found(F.col("t")).alias("f")).collect()
    assert {r.t: r.f for r in got} == rows and set(rx.one_of) == {"string", "number", "boolean"}
