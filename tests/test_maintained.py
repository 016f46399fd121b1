"""The maintained learner table against the learner over the whole history."""

import random

import pytest
from pyspark.sql import functions as F

from weirworks.operators.learning import learner
from weirworks.streaming import maintained as M

SHAPE = "record string, task_type string, level_used int, outcome string, op string"


def changes(n, seed):
    """Additions, repeated ones, corrections (taken back and added under another id), and retractions before additions."""
    rng, out, live = random.Random(seed), [], {}
    for i in range(n):
        row = (f"r{i}", rng.choice(["code_gen", "text", "analysis"]), rng.randrange(1, 4), rng.choice(["success", "success", "escalated"]))
        out += [(*row, "add")] * rng.choice([1, 1, 1, 2])
        if rng.random() < 0.25:
            out.append((row[0], None, None, None, "retract"))
        else:
            live[row[0]] = row
    out += [(None, "text", 1, "success", "add"), ("x", "text", 1, "success", "other")]
    rng.shuffle(out)
    return out, list(live.values())


def plain(df):
    return sorted(map(str, df.select("task_type", "level_used", "n", "success_rate", "adjusted_level", "reason", "sample_size").collect()))


@pytest.mark.parametrize("seed,batches", [(1, 3), (2, 11)])
def test_any_order_of_batches(spark, tmp_path, monkeypatch, seed, batches):
    monkeypatch.setattr(M, "COMPACT", 3)
    rows, live = changes(400, seed)
    size = -(-len(rows) // batches)
    for k in range(batches):
        part = spark.createDataFrame(rows[k * size:(k + 1) * size], SHAPE)
        M.apply_batch(spark, part, str(tmp_path), k)
        if k % 4 == 1:                                      # a batch that runs again, as after a lost driver
            M.apply_batch(spark, part, str(tmp_path), k)
    want = learner(spark.createDataFrame(live, "record string, task_type string, level_used int, outcome string"))
    assert plain(M.maintained_learner(spark, str(tmp_path))) == plain(want)
    versions = [p.name for p in (tmp_path / "records").iterdir() if p.name.startswith("version=")]
    assert len(versions) <= 4 and len(list((tmp_path / "cells").iterdir())) <= 2


def test_all_taken_back(spark, tmp_path):
    add = spark.createDataFrame([("a", "text", 1, "success", "add")], SHAPE)
    back = spark.createDataFrame([("a", "text", 1, "success", "retract")], SHAPE)
    for k, part in enumerate([add, back, add]):             # what is taken back stays so
        M.apply_batch(spark, part, str(tmp_path), k)
    assert M.cells(spark, str(tmp_path)).count() == 0


def test_a_small_batch_opens_only_its_buckets(spark, tmp_path):
    many = spark.range(5000).selectExpr("concat('r', id) AS record", "'text' AS task_type", "1 AS level_used", "'success' AS outcome", "'add' AS op")
    M.apply_batch(spark, many, str(tmp_path), 0)
    one = spark.createDataFrame([("r7", "text", 1, "success", "retract")], SHAPE)
    bucket = M.as_changes(one).first().bucket
    known = M._read(spark, f"{tmp_path}/records", M.ROW, 1).where(f"bucket IN ({bucket})").select("record", F.input_file_name().alias("file"))
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and {r.file.split("/")[-2] for r in known.collect()} == {f"bucket={bucket}"}
    M.apply_batch(spark, one, str(tmp_path), 1)
    assert M.cells(spark, str(tmp_path)).first().n == 4999


def test_turns_without_a_conversation_id_are_paired(spark):
    from weirworks.plans.conversations import pair_turns
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (1, 0, "user", "c"), (1, 4, "assistant", "d"), (None, 2, "user", "e")]
    got = pair_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {tuple(r) for r in got.collect()} == {(None, 0, "a", "b"), (1, 0, "c", "d")}
