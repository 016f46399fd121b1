"""Plans: what reaches the scan, what shuffles, what is never there."""

from pyspark.sql import functions as F

from catalog import QUERIES
from weirworks.operators import gate as G
from weirworks.operators import routing as R
from weirworks.operators import usage as U
from weirworks.views import table, view


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_timeline_reads_few_columns_and_filters_early(spark, sf_dir):
    text = plan(U.daily_totals(view(spark, sf_dir, "usage_log")))
    schema = text.split("ReadSchema: ")[1].split("\n")[0]
    assert "props" not in schema and "user_id" not in schema


def test_routing_and_gating_do_not_shuffle(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert "Exchange" not in plan(R.route(docs.select(F.col("doc_id").alias("task_id"), "text")))
    assert "Exchange" not in plan(G.quality_gate(docs.select("doc_id", F.col("text").alias("response"))))


def test_filters_on_results_do_not_repeat_the_work(spark, sf_dir):
    routed = R.route(table(spark, sf_dir, "documents"))
    whole = len(routed._jdf.queryExecution().optimizedPlan().toString())
    some = len(routed.where("route = 'local'")._jdf.queryExecution().optimizedPlan().toString())
    assert some < 1.5 * whole


def test_filters_on_input_reach_the_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert "GreaterThan(doc_id,5)" in plan(R.route(docs).where("doc_id > 5"))


def test_no_cross_joins(spark, sf_dir):
    # streams and model runs have no single plan to look at
    skipped = {n for n in QUERIES if n.startswith("stream_")} | {"light_pass"}
    for name in sorted(set(QUERIES) - skipped):
        text = plan(QUERIES[name](spark, sf_dir))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_triage_classifies_each_prompt_once(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("task_id"), "text")
    answers = docs.select("task_id", F.lit('{"category": "simple", "confidence": 0.9}').alias("response"))
    text = plan(R.route(docs, triage=answers))
    assert text.count("Scan parquet") == 2 and "Union" not in text and "SortMergeJoin" not in text        # prompts and answers
    few = R.route(docs, triage=answers).orderBy("task_id").collect()
    monkeypatch.setattr(R, "fits_broadcast", lambda df: False)
    text = plan(R.route(docs, triage=answers))
    assert text.count("Scan parquet") == 2 and "Union" not in text
    assert R.route(docs, triage=answers).orderBy("task_id").collect() == few


def test_compression_report_shuffles_counts_once(spark, sf_dir):
    text = plan(QUERIES["compression_report"](spark, sf_dir))
    assert text.count("Exchange") <= 2 and "Join" not in text


def test_packing_reads_tasks_once_per_use(spark, sf_dir):
    text = plan(QUERIES["known_files"](spark, sf_dir))
    assert text.count("Scan parquet") <= 4
    text = plan(QUERIES["pack_context"](spark, sf_dir))
    assert text.count("Scan parquet") <= 9 and text.count("Join") <= 6


def test_light_pass_never_broadcasts_answers(spark):
    from weirworks.plans import light_pass as LP
    from weirworks.sources.workdir import written
    ids = spark.range(2000).withColumnRenamed("id", "task_id")
    answers = written(ids.selectExpr("task_id", "repeat('same answer ', 100) AS response", "true AS ok", "1L AS tokens_used", "1L AS duration_ms"), "answers")
    packed = written(ids.selectExpr("task_id", "'t' AS tool", "5L AS estimated_tokens", "repeat('x', 100) AS text"), "asked")
    attempts = LP._attempt(answers, packed, 1, LP.LightPassOptions())
    assert attempts.count() == 2000 and "SortMergeJoin" in plan(attempts) and "BroadcastHashJoin" not in plan(attempts)


def test_answers_that_hold_what_was_asked_are_judged_where_they_lie(spark):
    from weirworks.plans import light_pass as LP
    answers = spark.range(20).selectExpr("nullif(id, 3) AS task_id", "'an answer' AS response", "true AS ok", "1L AS tokens_used", "1L AS duration_ms",
                                         "'t' AS tool", "5L AS estimated_tokens", "'python' AS expected_language")
    packed = answers.selectExpr("task_id", "tool", "estimated_tokens", "expected_language")
    attempts = LP._attempt(answers, packed, 1, LP.LightPassOptions())
    assert attempts.count() == 19 and "Exchange" not in plan(attempts) and "Join" not in plan(attempts)
    joined = LP._attempt(answers.drop("tool", "estimated_tokens", "expected_language"), packed, 1, LP.LightPassOptions())
    assert joined.columns == attempts.columns and joined.orderBy("task_id").collect() == attempts.orderBy("task_id").collect()


def test_estimates_do_not_gather_all_requests_of_a_tool(spark, sf_dir):
    from weirworks.operators.learning import output_estimate
    asked = spark.range(100).selectExpr("id AS task_id", "if(id < 90, 'generate_code', 'complete') AS tool", "2 AS task_complexity")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")       # as where the log is large
    try:
        text = plan(output_estimate(asked, view(spark, sf_dir, "usage_log")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
