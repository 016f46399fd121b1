"""Running a completion function and the whole light pass."""

import sys

from pyspark import cloudpickle

from weirworks.operators.models import batch_complete
from weirworks.plans.light_pass import LightPassOptions, light_pass
from weirworks.views import view


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def shout(prompt, max_tokens):
    if "boom" in prompt:
        raise ValueError("no answer")
    return prompt.upper(), len(prompt) + (max_tokens or 0)


def test_batch(spark):
    df = spark.createDataFrame([(1, "ab", 5), (2, "boom", 5), (3, "", None)], "id int, prompt string, cap int")
    got = {r.id: (r.response, r.tokens_used, r.ok) for r in batch_complete(df, shout, max_tokens="cap", partitions=2).collect()}
    assert got == {1: ("AB", 7, True), 2: ("Error: no answer", 0, False), 3: ("", 0, True)}


def test_batch_keeps_columns_and_calls_as_many_at_once_as_told(spark):
    def slow(prompt, max_tokens):
        import threading
        import time
        time.sleep(0.01)
        return prompt, sum("ThreadPoolExecutor" in t.name for t in threading.enumerate())

    df = spark.createDataFrame([(i, f"p{i}", 2**60 + 1 if i % 2 else None, ["a", None]) for i in range(40)], "id int, prompt string, cap bigint, allowed array<string>")
    got = batch_complete(df.coalesce(1), slow, max_tokens="cap", concurrency=3, keep=["cap", "allowed"]).collect()
    assert max(r.tokens_used for r in got) == 3 and all(r.ok for r in got)
    assert {(r.id, r.response, r.cap, tuple(r.allowed)) for r in got} == {(i, f"p{i}", 2**60 + 1 if i % 2 else None, ("a", None)) for i in range(40)}


def answer(prompt, max_tokens):
    good = "def run(a):\n    return a\n" * 40
    if "fail" in prompt:
        raise RuntimeError("down")
    if "hedge" in prompt and max_tokens < 1200:
        return "maybe, perhaps, it could be\n" + good, 300
    if "mark" in prompt:
        return good + "# TODO", 300
    return good, 300


def test_light_pass(spark, sf_dir):
    tasks = spark.createDataFrame([(1, "please work on src/a.ts"), (2, "hedge a bit"), (3, "mark it"), (4, "fail now")], "task_id bigint, text string")
    tasks = tasks.selectExpr("*", "'generate_code' AS tool", "'python' AS expected_language")
    files = spark.createDataFrame([("src/a.ts", "const a = () => 1")], "path string, content string")
    log = view(spark, sf_dir, "usage_log").where("tool <> 'generate_code'")
    out = light_pass(tasks, files, log, answer)
    got = {r.task_id: (r.quality_status, r.attempt_count, r.tokens_used) for r in out["results"].collect()}
    assert got == {1: ("accepted", 1, 300), 2: ("retried_accepted", 2, 600), 3: ("escalated", 1, 300), 4: ("escalated", 1, None)}
    assert sorted(r.task_id for r in out["log"].collect()) == [1, 2, 3]
    assert sorted(r.task_id for r in out["escalations"].collect()) == [3, 4]


def test_light_pass_checks_options_and_tells_what_failed(spark, sf_dir):
    tasks = spark.createDataFrame([(1, "please work on src/a.ts", ["src/b.ts"], None, None), (2, "explain run", None, ["Summary"], None),
                                   (3, "any", None, None, ["src/a.ts"])],
                                  "task_id bigint, text string, allowed_files array<string>, required_sections array<string>, file_refs array<string>")
    tasks = tasks.selectExpr("*", "'generate_code' AS tool", "'python' AS expected_language")
    files = spark.createDataFrame([("src/a.ts", "export function go(a) { }\nclass K {}")], "path string, content string")
    log = view(spark, sf_dir, "usage_log").where("tool <> 'generate_code'")
    out = light_pass(tasks, files, log, names_a_file)
    got = {r.task_id: (r.quality_status, r.response) for r in out["results"].collect()}
    assert got == {1: ("escalated", None), 2: ("escalated", None), 3: ("accepted", GOOD)}
    told = {r.task_id: r for r in out["escalations"].collect()}
    assert told[1].task_intent == "please work on src/a.ts" and told[1].failure_reasons == ["Files outside scope: src/c.py"]
    assert [(f.file, f.outline) for f in told[1].file_context] == [("src/a.ts", "typescript, 2 lines. Classes: [K]. Functions: [go]")]
    assert told[2].failure_reasons == ["Missing sections: Summary"] and told[2].file_context == []
    free = light_pass(tasks, files, log, names_a_file, LightPassOptions(gate_enabled=False))["results"].collect()
    assert {r.quality_status for r in free} == {"accepted"} and {r.response for r in free} == {GOOD}


GOOD = "see src/c.py\n" + "def run(a):\n    return a\n" * 40


def names_a_file(prompt, max_tokens):
    return GOOD, 300
