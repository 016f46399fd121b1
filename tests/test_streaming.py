"""Streams: several batches, late rows, repeated batches."""

from pyspark.sql import functions as F

from weirworks.operators import usage as U
from weirworks.streaming import usage as T
from weirworks.views import view


def feed(spark, tmp_path, sf_dir, parts=4):
    """The usage log as files in time order, so that each file is one micro-batch."""
    log = view(spark, sf_dir, "usage_log")
    path = str(tmp_path / "in")
    for i in range(parts):
        log.where((F.col("log_ord") >= i * 250) & (F.col("log_ord") < (i + 1) * 250)).coalesce(1).write.mode("append").parquet(path)
    return log, spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_recent_over_many_batches(spark, tmp_path, sf_dir):
    log, stream = feed(spark, tmp_path, sf_dir)
    T.stream_recent(stream, str(tmp_path / "out"), str(tmp_path / "cp"), 20)
    got = [r.log_ord for r in U.recent(T.newest_version(spark.read.parquet(str(tmp_path / "out"))), 20).collect()]
    assert got == [r.log_ord for r in U.recent(log, 20).collect()]


def test_learner_over_many_batches(spark, tmp_path, sf_dir):
    history = view(spark, sf_dir, "history")
    history.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(history.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    T.run_versions(T.stream_learner(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = T.latest_by(spark.read.parquet(str(tmp_path / "out")), ["task_type", "level_used"])
    want = T.stream_learner(history)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))


def test_daily_timeline_over_many_batches(spark, tmp_path, sf_dir):
    log, stream = feed(spark, tmp_path, sf_dir)
    daily = T.stream_daily_timeline(stream)
    T.run_append(daily, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r.date: (r.tokens, r.overhead, r.tasks) for r in spark.read.schema(daily.schema).parquet(str(tmp_path / "out")).collect()}
    want = {r.date: (r.tokens, r.overhead, r.tasks) for r in U.daily_timeline(log).collect()}
    assert got and got == {d: v for d, v in want.items() if d in got}
    assert len(want) - len(got) <= 1


def test_late_rows_are_dropped_and_repeats_removed(spark, tmp_path):
    schema = ("log_ord bigint, type string, ts timestamp, session_id string, tool string, model string, tokens_used bigint, "
              "cloud_overhead_tokens bigint")
    path = str(tmp_path / "in")

    def put(rows):
        df = spark.createDataFrame([(i, "completion", at, "s", "t", "m", 10, None) for i, at in rows],
                                   "log_ord bigint, type string, at string, session_id string, tool string, model string, tokens_used bigint, cloud_overhead_tokens bigint")
        df.withColumn("ts", F.col("at").cast("timestamp")).select([c.split()[0] for c in schema.split(", ")]).coalesce(1).write.mode("append").parquet(path)

    put([(1, "2024-01-01 10:00:00"), (2, "2024-01-01 11:00:00")])
    put([(2, "2024-01-01 11:00:00"), (3, "2024-01-03 12:00:00")])
    # rows are judged late by the watermark of the batch before, so one more batch comes first
    put([(6, "2024-01-03 13:00:00")])
    put([(4, "2024-01-01 12:00:00"), (5, "2024-01-05 00:00:00")])
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    daily = T.stream_daily_timeline(read())
    T.run_append(daily, str(tmp_path / "days"), str(tmp_path / "cp1"))
    got = {r.date: r.tasks for r in spark.read.schema(daily.schema).parquet(str(tmp_path / "days")).collect()}
    assert got == {"2024-01-01": 3, "2024-01-03": 2}
    once = T.stream_dedup(read())
    T.run_append(once, str(tmp_path / "once"), str(tmp_path / "cp2"))
    kept = sorted(r.log_ord for r in spark.read.schema(once.schema).parquet(str(tmp_path / "once")).collect())
    assert kept == [1, 2, 3, 5, 6]


def test_a_table_of_many_files_is_streamed_whole(spark, tmp_path, sf_dir):
    from catalog.streaming import appended, stream
    spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    want = sorted(r.task_id for r in view(spark, sf_dir, "prompts").select("task_id").collect())
    for folder in (str(tmp_path), sf_dir):
        got = appended(spark, stream(spark, folder, "prompts").select("task_id"), "folder")
        assert sorted(r.task_id for r in got.collect()) == want
