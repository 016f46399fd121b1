"""Tasks and attempts on streams against the batch operators: several micro-batches, any order, late rows, restarts."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from weirworks.operators import gate
from weirworks.plans.tasks import task_join
from weirworks.streaming import attempts as A
from weirworks.streaming import usage as T

START = datetime.datetime(2026, 1, 5, 8)
at = lambda minutes: START + datetime.timedelta(minutes=minutes)


def sides(n=60):
    """Tasks 10 minutes apart; some are answered or logged late or never, two have no prompt, one has two answers."""
    prompts = [(i, at(10 * i), f"prompt {i}") for i in range(n) if i not in (7, 31)]
    answers = [(i, at(10 * i + i % 40), f"answer {i}") for i in range(n) if i % 6 != 5] + [(12, at(121), "again")]
    logs = [(i, at(10 * i + i % 40 + i % 13), i) for i in range(n) if i % 4 != 3]
    return prompts, answers, logs


SHAPES = ("task_id int, asked_at timestamp, text string", "task_id int, answered_at timestamp, response string",
          "task_id int, logged_at timestamp, tokens_used int")


def feeds(spark, folder, batches):
    """Streams that give one file of each side a micro-batch; ``batches`` lists (prompts, answers, logs)."""
    out = []
    for k, shape in enumerate(SHAPES):
        path = f"{folder}/side{k}"
        for batch in batches:
            spark.createDataFrame(batch[k], shape).coalesce(1).write.mode("append").parquet(path)
        out.append(spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(path))
    return out


def test_stream_join_gives_what_the_batch_join_gives(spark, tmp_path):
    whole = sides()
    cut = lambda rows, time, low, high: [r for r in rows if at(low) <= r[time] < at(high)]
    edges = [0, 130, 260, 400, 10_000]
    batches = [tuple(cut(rows, 1, low, high) for rows in whole) for low, high in zip(edges, edges[1:])]
    late = (3, at(34), "late answer")                     # belongs to the first batch, comes with the last: counts as missing
    batches = [tuple([r for r in rows if (r[0], r[1]) != (3, at(33))] for rows in b) for b in batches]
    batches[-1][1].append(late)
    batches.append(([(900, at(5000), "end")], [(901, at(5000), "end")], [(902, at(5000), 0)]))      # moves the watermark over all
    stream = task_join(*feeds(spark, tmp_path, batches), delay="20 minutes")
    T.run_append(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).where("task_id < 900")
    prompts, answers, logs = whole
    tables = (prompts, [r for r in answers if (r[0], r[1]) != (3, at(33))], logs)
    want = task_join(*(spark.createDataFrame(rows, shape) for rows, shape in zip(tables, SHAPES)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert {r.task_state for r in want.collect()} == {"logged", "unlogged", "unanswered", "unprompted"}
    assert not got.where("response = 'late answer'").count()


def test_task_join_leaves_out_rows_that_can_meet_nothing(spark):
    p = spark.createDataFrame([(1, at(0), "a"), (None, at(0), "b"), (2, None, "c")], SHAPES[0])
    c = spark.createDataFrame([(1, at(5), "x"), (1, at(6), "y"), (None, at(0), "z")], SHAPES[1])
    u = spark.createDataFrame([(1, at(5), 9), (None, at(0), 8)], SHAPES[2])
    rows = {(r.task_id, r.task_state, r.response, r.tokens_used) for r in task_join(p, c, u).collect()}
    assert rows == {(1, "logged", "x", 9), (1, "unlogged", "y", None)}


# --- attempts ---------------------------------------------------------------------------------------------------

ATTEMPT = "task_id int, attempt_no int, response string, expected_language string, expected_tokens bigint, tokens_used bigint, duration_ms bigint, model string, tool string, ts timestamp"
TEXTS = ["A complete and careful answer to the question, with all the detail that was asked for in it.",
         "This is done, mostly. TODO finish the rest of it later, when there is time to look at it again.", "I cannot help with that.", "", None,
         "I think maybe it might work, perhaps. It seems that this is how the question is to be answered, all in all."]


def attempts(n, seed):
    """Attempts of n tasks: a second one for most, some without a first."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        for number in (1, 2, 3):
            if rng.random() < (0.93, 0.6, 0.1)[number - 1]:
                rows.append((i, number, rng.choice(TEXTS + TEXTS[-1:] * 4), None, 60, rng.randrange(100), rng.randrange(900), f"m{number}", "t", at(i % 7 + 3 * number)))
    rng.shuffle(rows)
    return rows


def run(spark, folder, batches, first=0):
    path = f"{folder}/in"
    for batch in batches[first:]:
        spark.createDataFrame(batch, ATTEMPT).coalesce(1).write.mode("append").parquet(path)
    stream = A.stream_attempts(spark.readStream.schema(ATTEMPT).option("maxFilesPerTrigger", 1).parquet(path), wait=1800, delay="30 minutes")
    T.run_append(stream, f"{folder}/out", f"{folder}/cp")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def plain(df):
    return sorted(map(str, df.orderBy("task_id").collect()))


@pytest.fixture()
def rocksdb(spark):
    before = spark.conf.get(A.PROVIDER, None)
    yield
    spark.conf.set(A.PROVIDER, before) if before else spark.conf.unset(A.PROVIDER)


def test_attempts_in_any_order_and_after_a_restart(spark, tmp_path, rocksdb):
    rows = attempts(120, 4)
    end = [(1000 + k, 1, TEXTS[0], None, 60, 1, 1, "m", "t", at(2000)) for k in range(2)]
    batches = [rows[:90], rows[90:150], rows[150:], end[:1]]
    run(spark, tmp_path, batches[:2])                      # stops with tasks half done, goes on from the checkpoint
    got = run(spark, tmp_path, batches, 2).where("task_id < 1000")
    want = gate.resolve_attempts(spark.createDataFrame(rows, ATTEMPT)).select(got.columns)
    one_only = {r[0] for r in rows if r[1] == 3} - {r[0] for r in rows if r[1] < 3}       # third attempts count in neither
    assert not one_only & {r.task_id for r in got.collect()}
    assert plain(got) == plain(want)
    assert {r.quality_status for r in want.collect()} == {"accepted", "retried_accepted", "escalated"}


def test_repeated_attempts_do_not_settle_twice(spark, tmp_path, rocksdb):
    ok = (1, 1, TEXTS[0], None, 60, 5, 5, "m", "t", at(0))
    soft = (2, 1, TEXTS[5], None, 60, 5, 5, "m", "t", at(0))
    end = (9, 1, TEXTS[0], None, 60, 5, 5, "m", "t", at(600))
    got = run(spark, tmp_path, [[ok, soft], [ok, soft], [end], [end]])
    assert sorted((r.task_id, r.quality_status, r.attempt_count) for r in got.collect()) == [(1, "accepted", 1), (2, "escalated", 2), (9, "accepted", 1)]
