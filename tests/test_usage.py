"""Known totals of the accounting rules."""

import pytest
from pyspark.sql import functions as F

from catalog import QUERIES
from weirworks import dims
from weirworks.functions import cost as C
from weirworks.operators import learning as L
from weirworks.operators import usage as U
from weirworks.operators.reports import token_report

LOG = ("log_ord bigint, type string, ts timestamp, session_id string, tool string, model string, tokens_used bigint, "
       "cloud_overhead_tokens bigint, output_tokens bigint, duration_ms bigint, quality_status string, attempt_count int, resolved_locally boolean")


def log(spark, rows):
    names = [part.split()[0] for part in LOG.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], LOG)


def completions(tokens):
    return [dict(log_ord=i, type="completion", tokens_used=t, tool="t", model="m", duration_ms=100, session_id="s") for i, t in enumerate(tokens)]


def test_break_even(spark):
    df = spark.createDataFrame([(21,), (22,)], "t bigint")
    for rate in (5.0, 8.0, 25.0):
        assert [r[0] for r in df.select(C.breaks_even(F.col("t"), F.lit(rate))).collect()] == [False, True]
    assert df.select(C.cloud_overhead(F.lit(100))).first()[0] == 210


@pytest.mark.parametrize("rate,gross", [(5, 0.02), (8, 0.03), (15, 0.06), (25, 0.10)])
def test_price_tiers(spark, rate, gross):
    row = U.usage_summary(log(spark, completions([50, 100, 200, 300, 400, 500, 750, 1000, 200, 300])), rate).first()
    assert (row.total_local_tokens, row.gross_cost) == (3800, gross)


def test_half_rounds_up_also_below_zero(spark):
    assert spark.range(1).select(C.round2(F.lit(-0.125))).first()[0] == -0.12


def test_delegation_rates(spark):
    kinds = [("accepted", 1, True)] * 35 + [("retried_accepted", 2, True)] * 5 + [("escalated", 2, False)] * 3
    rows = [dict(log_ord=i, type="delegation", tokens_used=10, duration_ms=5, quality_status=q, attempt_count=a, resolved_locally=r)
            for i, (q, a, r) in enumerate(kinds)]
    row = U.delegation_summary(log(spark, rows)).first()
    assert (row.resolution_rate, row.retry_rate, row.avg_attempts) == (40 / 43, 8 / 43, 51 / 43)
    stats = U.dashboard_delegation_stats(log(spark, rows)).first()
    assert (stats.total, stats.retry_rate) == (43, 8 / 43)


def test_empty_log(spark):
    empty = log(spark, [])
    assert tuple(U.delegation_summary(empty).first()) == (0, 0, 0, 0.0, 0.0, 0.0, 0, 0.0)
    assert U.dashboard_summary(empty).first().net_cost == 0.0
    assert [r.n for r in U.quality_breakdown(empty).collect()] == [0, 0, 0]


def test_rows_without_tokens_are_skipped_by_the_dashboard_only(spark):
    rows = completions([100]) + [dict(log_ord=9, type="completion", duration_ms=1, session_id="x")]
    assert U.dashboard_summary(log(spark, rows)).first().local_tasks == 1
    assert U.usage_summary(log(spark, rows)).first().local_tasks == 2


def test_workday(spark):
    day = [(50, 8), (200, 4), (50, 6), (30, 3), (120, 5), (135, 3), (500, 4), (275, 2), (100, 3), (400, 2), (300, 2), (400, 1)]
    total = U.usage_summary(log(spark, completions([t for t, n in day for _ in range(n)]))).first()
    assert (total.local_tasks, total.total_local_tokens) == (43, 7245)


def test_cutoffs_that_no_row_reaches(spark):
    rows = U.threshold_sweep(log(spark, completions([60, 120])), [0, 50, 100, 5000]).orderBy("cutoff").collect()
    assert [(r.cutoff, r.tokens, r.tasks) for r in rows] == [(0, 180, 2), (50, 180, 2), (100, 120, 1), (5000, 0, 0)]
    assert rows[-1].efficiency == 0.0 and rows[-1].net_cost == 0.0
    assert U.threshold_sweep(log(spark, []), [10]).first().tasks == 0


def test_log_read_from_files_fits_the_operators(spark, tmp_path):
    from weirworks.sources import logs
    lines = ['{"type":"completion","tokens_used":12.5,"timestamp":"2026-01-02T00:00:00.000Z","session_id":"a"}'] * 2
    lines += ['{"type":"delegation","tokens_used":7,"timestamp":"2026-01-02T00:00:01.000Z","session_id":"a"}']
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    read = logs.read_usage_log(spark, str(tmp_path))
    assert [r.tokens for r in U.recent(read).collect()] == [7, 13, 13] and [r.net for r in U.feed(read, 1).collect()] == [7 - 90]


def test_days_and_stamps_in_another_zone(spark, tmp_path):
    from weirworks.sources import logs
    rows = spark.sql("SELECT 5L AS tokens_used, 'a' AS session_id, timestamp'2026-01-02 00:00:00Z' AS ts")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        logs.append_completions(rows, str(tmp_path / "log"))
        read = logs.read_usage_log(spark, str(tmp_path / "log"))
        assert read.first().timestamp == "2026-01-02T00:00:00.000Z"
        assert [r.date for r in U.daily_timeline(read).collect()] == ["2026-01-02"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_baselines(spark):
    asked = spark.createDataFrame([(0, "complete", 2), (1, "generate_code", 3), (2, "analyze_file", 2), (3, "other", 9)],
                                  "task_id int, tool string, task_complexity int")
    got = L.output_estimate(asked, log(spark, [])).orderBy("task_id").collect()
    assert [r.estimated_tokens for r in got] == [375, 875, 438, 2500]


def test_sweep_matches_a_filter_per_cutoff(spark):
    base = log(spark, completions([10, 50, 99, 100, 250, 250, 900]))
    got = {r.cutoff: (r.tokens, r.tasks) for r in U.threshold_sweep(base, [50, 100, 300]).collect()}
    assert got == {50: (1649, 6), 100: (1500, 4), 300: (900, 1)}


@pytest.mark.parametrize("values", [[5], [1, 2], [3, 1, 2], [70000, 1, 40000, 2], [7] * 5 + [40000] * 6, list(range(0, 200000, 997))])
def test_upper_median(spark, values):
    df = spark.createDataFrame([(v, 10.0) for v in values], "tokens bigint, estimate double")
    assert token_report(df).first().median_tokens == sorted(values)[len(values) // 2]


def test_accuracy_status_of_empty_texts(spark, tmp_path):
    rows = [(1, "y" * 40, 40), (2, "", 0), (3, "x", 0), (4, None, 0), (5, None, None), (6, "z", 90)]
    spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.status for r in QUERIES["accuracy_status"](spark, str(tmp_path)).collect()}
    assert got == dict.fromkeys([2, 3, 4, 5], "UNDER-ESTIMATED") | {1: "ACCURATE", 6: "OVER-ESTIMATED"}


def test_recent_keeps_log_order(spark):
    got = U.recent(log(spark, completions(range(100, 180))), 50).collect()
    assert [r.log_ord for r in got] == list(range(79, 29, -1))


def test_price_of_model_names(spark):
    df = spark.createDataFrame([("x-OPUS-1",), ("sonnet",), ("haiku-3",), ("other",), (None,)], "m string")
    assert [r[0] for r in df.select(C.price_rate(F.col("m"))).collect()] == [25.0, 15.0, 5.0, dims.DEFAULT_RATE, dims.DEFAULT_RATE]


def test_month_of_twenty_sessions_a_day(spark):
    daily = spark.createDataFrame([("2026-02-17", 6130, 0, 45)], "date string, tokens bigint, overhead bigint, tasks bigint")
    rows = {r.tier: r for r in U.project(daily, scales=[20 / 3]).collect()}
    assert round(rows["haiku"].month_tokens) == 899067
    assert [rows[t].gross_cost for t in ("haiku", "sonnet", "opus")] == [4.50, 13.49, 22.48]


def test_large_outputs_keep_three_quarters(spark):
    row = U.threshold_sweep(log(spark, completions([1_000_000] * 3)), [0]).first()
    assert abs(row.efficiency - 0.74) < 1e-4


def test_unknown_outcomes_are_counted_too(spark):
    rows = [dict(log_ord=i, type="delegation", tokens_used=1, quality_status=q) for i, q in enumerate(["accepted", "odd", None])]
    got = {r.quality_status: r.n for r in U.quality_breakdown(log(spark, rows)).collect()}
    assert got == {"accepted": 1, "retried_accepted": 0, "escalated": 0, "odd": 1, "undefined": 1}
