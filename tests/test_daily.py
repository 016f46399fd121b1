"""The log as a data source: round trip, pruned days and kinds, all or nothing."""

import datetime

import pytest
from pyspark.sql import functions as F

from weirworks.sources import daily as D
from weirworks.views import view

FIELDS = ["type", "ts", "session_id", "tool", "model", "tokens_used", "cloud_overhead_tokens", "output_tokens", "duration_ms", "quality_status", "attempt_count", "resolved_locally"]


def plain(df):
    return sorted(map(str, df.select(*FIELDS).collect()))


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("daily") / "log")
    log = view(spark, sf_dir, "usage_log")
    D.append_daily_log(log.where("log_ord % 2 = 0"), path)
    D.append_daily_log(log.where("log_ord % 2 = 1").repartition(3), "file://" + path)
    return log, path


def test_round_trip(spark, stored):
    log, path = stored
    assert plain(D.read_daily_log(spark, path)) == plain(log)


def test_filters_skip_days_and_kinds(spark, stored):
    log, path = stored
    day = datetime.date(2024, 1, 7)
    few = D.read_daily_log(spark, path).where((F.col("day") >= F.lit(day)) & (F.col("day") < F.lit(datetime.date(2024, 1, 9))) & (F.col("kind") == "completion"))
    want = log.where("ts >= '2024-01-07' AND ts < '2024-01-09' AND type = 'completion'")
    assert plain(few) == plain(want) and want.count()
    everything, left = D.read_daily_log(spark, path).rdd.getNumPartitions(), few.rdd.getNumPartitions()
    assert left == 2 and everything > 40                    # one for each day and kind that is read


def test_reader_takes_only_the_filters_it_can_answer(stored):
    from pyspark.sql.datasource import EqualTo, In, IsNotNull, LessThan, StringContains
    reader = D.Reader(stored[1])
    rest = list(reader.pushFilters([LessThan(("day",), datetime.date(2024, 1, 3)), In(("kind",), ("delegation", "x")), IsNotNull(("day",)),
                                    StringContains(("value",), "a"), EqualTo(("value",), "b")]))
    assert [type(f).__name__ for f in rest] == ["IsNotNull", "StringContains", "EqualTo"]
    assert {(p.day, p.kind) for p in reader.partitions()} == {(datetime.date(2024, 1, d), "delegation") for d in (1, 2)}


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(datetime.datetime(2024, 1, 1), "completion", 1)], "ts timestamp, type string, tokens_used long")
    D.append_daily_log(rows, path)
    broken = spark.range(0, 2000, 1, 4).select(
        F.timestamp_seconds("id").alias("ts"), F.lit("delegation").alias("type"),
        F.when(F.col("id") == 1999, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("tokens_used"))
    with pytest.raises(Exception, match="lost"):
        D.append_daily_log(broken, path)
    assert [r.tokens_used for r in D.read_daily_log(spark, path).collect()] == [1]
    assert not list((tmp_path / "log" / "_pending").iterdir())


def test_odd_rows_and_overwrite(spark, tmp_path):
    path = str(tmp_path / "log")
    shape = "ts timestamp, type string, tool string, tokens_used long"
    rows = [(None, None, "no time", 1), (datetime.datetime(2024, 1, 1), "a/b=c", "line\nend", 2), (datetime.datetime(2024, 1, 1), "none of it", "ü🙂", None)]
    D.append_daily_log(spark.createDataFrame(rows, shape), path)
    got = D.read_daily_log(spark, path)
    assert {(r.kind, r.tool, r.tokens_used) for r in got.collect()} == {(None, "no time", 1), ("a/b=c", "line\nend", 2), ("none of it", "ü🙂", None)}
    assert [r.tool for r in got.where("kind = 'a/b=c'").collect()] == ["line\nend"]
    assert [r.tool for r in got.where("day IS NULL").collect()] == ["no time"]
    D.append_daily_log(spark.createDataFrame(rows[1:2], shape), path, overwrite=True)
    assert D.read_daily_log(spark, path).count() == 1
    assert D.read_daily_log(spark, str(tmp_path / "nothing")).count() == 0
