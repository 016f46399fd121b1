"""Streaming queries: each runs a stream over everything there is and returns the table it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirworks.plans.tasks import task_join
from weirworks.streaming import attempts as A
from weirworks.streaming import maintained as M
from weirworks.streaming import usage as T
from weirworks.views import VIEWS, shape, table

from .base import query, recorded
from .gate import FIRSTS, SECONDS, SETTLED, SETTLED_COLUMNS, VERDICT, gated
from .routing import DECIDED, route_sql
from .usage import CELLS, advice_sql, LOG_COLUMNS, OK, ROWS, TS, log_lines

HOUR = "INTERVAL 1 HOUR"


def stream_table(spark, sf_dir, base):
    """A supplied table as a file stream; the pattern matches a single file as well as a folder of files."""
    return spark.readStream.schema(table(spark, sf_dir, base).schema).parquet(f"{sf_dir}/{base}[.]parquet")


def stream(spark, sf_dir, name):
    """A supplied table as a file stream, in the shape of a view."""
    return shape(stream_table(spark, sf_dir, VIEWS[name][0]), name)


def appended(spark, streamed, name):
    path, checkpoint = T.paths(spark, name)
    schema = streamed.schema
    T.run_append(streamed, path, checkpoint)
    return spark.read.schema(schema).parquet(path)


def text_of(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


@query("stream_usage_log", f"SELECT {', '.join(c for c in LOG_COLUMNS if c != 'log_ord')}, {TS.format('ts')} AS at FROM usage_log", ["usage_log"])
def _(spark, sf_dir):
    path, _ = T.paths(spark, "log-lines")
    log_lines(spark, sf_dir).select("value").repartition(4).write.text(path)
    rows = appended(spark, T.stream_usage_log(spark, path, files_per_trigger=2), "usage-log")
    return rows.select(*[c for c in LOG_COLUMNS if c != "log_ord"], text_of("ts").alias("at"))


@query("stream_daily_timeline", f"""
WITH b AS (SELECT * FROM usage_log WHERE {OK})
SELECT strftime(ts, '%Y-%m-%d') AS date, CAST(sum(tokens_used) AS BIGINT) AS tokens, CAST(sum({recorded()}) AS BIGINT) AS overhead, count(*) AS tasks
FROM b GROUP BY 1 HAVING CAST(strftime(min(ts), '%Y-%m-%d') AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(ts) FROM b) - {HOUR}""", ["usage_log"])
def _(spark, sf_dir):
    return appended(spark, T.stream_daily_timeline(stream(spark, sf_dir, "usage_log")), "daily")


@query("stream_sessions", f"""
WITH b AS (SELECT * FROM usage_log WHERE {OK}),
n AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM b WINDOW w AS (PARTITION BY session_id ORDER BY ts)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS part FROM n)
SELECT session_id, {TS.format('min(ts)')} AS started, {TS.format('max(ts) + INTERVAL 30 MINUTE')} AS ended, CAST(sum(tokens_used) AS BIGINT) AS tokens,
  CAST(sum({recorded()}) AS BIGINT) AS overhead, count(*) AS tasks, array_to_string(list_sort(list(DISTINCT coalesce(tool, 'unknown'))), ',') AS tools
FROM g GROUP BY session_id, part HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM b) - {HOUR}""", ["usage_log"])
def _(spark, sf_dir):
    out = appended(spark, T.stream_sessions(stream(spark, sf_dir, "usage_log")), "sessions")
    return out.select("session_id", text_of("start").alias("started"), text_of("end").alias("ended"), "tokens", "overhead", "tasks",
                      F.array_join("tools", ",").alias("tools"))


@query("stream_route", route_sql("2"), ["prompts"])
def _(spark, sf_dir):
    return appended(spark, T.stream_route(stream(spark, sf_dir, "prompts")).select("task_id", *DECIDED), "routed")


@query("stream_gate", f"WITH {gated('completions')} SELECT task_id, severity, {VERDICT} FROM gate", ["completions"])
def _(spark, sf_dir):
    judged = T.stream_gate(stream(spark, sf_dir, "completions"))
    return appended(spark, judged.select("task_id", "severity", *VERDICT.split(", ")), "gated")


@query("stream_learner", f"WITH {CELLS} SELECT task_type, level_used, n, s AS successes FROM c", ["history"])
def _(spark, sf_dir):
    path, checkpoint = T.paths(spark, "learner")
    T.run_versions(T.stream_learner(stream(spark, sf_dir, "history")), path, checkpoint, combine=T.merge_latest(["task_type", "level_used"]))
    return T.newest_version(spark.read.parquet(path))


@query("stream_sliding_rates", f"""
WITH d AS (SELECT *, time_bucket(INTERVAL 10 MINUTE, ts) AS slot FROM usage_log WHERE type = 'delegation'),
w AS (SELECT *, slot - unnest(range(0, 6)) * INTERVAL 10 MINUTE AS s FROM d)
SELECT {TS.format('s')} AS started, {TS.format(f's + {HOUR}')} AS ended, count(*) AS total,
  count(*) FILTER (resolved_locally) / CAST(count(*) AS DOUBLE) AS resolution_rate, count(*) FILTER (attempt_count > 1) / CAST(count(*) AS DOUBLE) AS retry_rate
FROM w GROUP BY s HAVING s + {HOUR} <= (SELECT max(ts) FROM d) - {HOUR}""", ["usage_log"])
def _(spark, sf_dir):
    out = appended(spark, T.stream_sliding_rates(stream(spark, sf_dir, "usage_log")), "rates")
    return out.select(text_of("start").alias("started"), text_of("end").alias("ended"), "total", "resolution_rate", "retry_rate")


@query("stream_recent", f"SELECT log_ord, tool, model, tokens, overhead, quality_status FROM ({ROWS} ORDER BY log_ord DESC LIMIT 50)", ["usage_log"])
def _(spark, sf_dir):
    from weirworks.operators.usage import recent
    path, checkpoint = T.paths(spark, "recent")
    T.stream_recent(stream(spark, sf_dir, "usage_log"), path, checkpoint)
    return recent(T.newest_version(spark.read.parquet(path))).select("log_ord", "tool", "model", "tokens", "overhead", "quality_status")


@query("stream_dedup", f"SELECT {', '.join(LOG_COLUMNS)} FROM usage_log", ["usage_log"])
def _(spark, sf_dir):
    log = stream(spark, sf_dir, "usage_log")
    return appended(spark, T.stream_dedup(log.unionByName(log)), "once").select(*LOG_COLUMNS)


# --- tasks over three streams, attempts as state --------------------------------------------------------------------

# every event is a prompt; answers and log rows follow it by minutes that its number tells, some too late, some never
TASK_SIDES = {
    "asked": "SELECT event_id AS task_id, ts AS asked_at, event_type AS kind FROM events",
    "answered": "SELECT event_id AS task_id, ts + (event_id % 41) * INTERVAL '1' MINUTE AS answered_at, user_id AS worker FROM events WHERE event_id % 10 <> 3",
    "logged": "SELECT event_id AS task_id, ts + (event_id % 41 + event_id % 13) * INTERVAL '1' MINUTE AS logged_at, value AS tokens FROM events WHERE event_id % 7 <> 2",
}
OVER = "(SELECT max(ts) FROM events) - INTERVAL '12' HOUR"      # by then every time limit is over, whatever the watermark


@query("stream_task_join", f"""
WITH {", ".join(f"{name} AS ({text})" for name, text in TASK_SIDES.items())},
c AS (SELECT a.*, l.tokens FROM answered a LEFT JOIN logged l ON l.task_id = a.task_id AND l.logged_at BETWEEN a.answered_at AND a.answered_at + INTERVAL '10' MINUTE),
j AS (SELECT coalesce(p.task_id, c.task_id) AS task_id, p.asked_at, c.answered_at, p.kind, c.worker, c.tokens,
  CASE WHEN c.task_id IS NULL THEN 'unanswered' WHEN p.task_id IS NULL THEN 'unprompted' WHEN c.tokens IS NULL THEN 'unlogged' ELSE 'logged' END AS task_state
  FROM asked p FULL JOIN c ON c.task_id = p.task_id AND c.answered_at BETWEEN p.asked_at AND p.asked_at + INTERVAL '30' MINUTE)
SELECT task_id, task_state, kind, worker, tokens FROM j WHERE coalesce(asked_at, answered_at) < {OVER}""")
def _(spark, sf_dir):
    def side(name):
        stream_table(spark, sf_dir, "events").createOrReplaceTempView("events")
        out = spark.sql(TASK_SIDES[name])
        return out.withColumn(f"{name}_at", F.col(f"{name}_at").cast("timestamp"))
    rows = appended(spark, task_join(*map(side, TASK_SIDES)), "tasks")
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    last = spark.sql(f"SELECT CAST({OVER} AS TIMESTAMP) AS t").first()[0]
    return rows.where(F.coalesce("asked_at", "answered_at") < F.lit(last)).select("task_id", "task_state", "kind", "worker", "tokens")


# both attempts of all tasks, a minute apart; the end of the stream has settled all but the last tasks
@query("stream_attempts", f"""WITH {SETTLED} SELECT {', '.join(SETTLED_COLUMNS)}, array_to_string(why, '; ') AS reasons FROM settled
WHERE task_id <= (SELECT max(doc_id) FROM documents) - 100""", ["completions", "retries"])
def _(spark, sf_dir):
    for name in ("completions", "retries"):
        stream(spark, sf_dir, name).createOrReplaceTempView(name)
    both = spark.sql(f"{FIRSTS} UNION ALL {SECONDS}").withColumn("ts", F.timestamp_seconds(F.col("task_id") * 60 + F.col("attempt_no") * 120))
    rows = appended(spark, A.stream_attempts(both, wait=1200), "attempts")
    last = table(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0]
    return rows.where(F.col("task_id") <= last - 100).select(*SETTLED_COLUMNS, F.array_join("failure_reasons", "; ").alias("reasons"))


# --- a maintained table ---------------------------------------------------------------------------------------------

# every record is added, some twice, and every eleventh is taken back, in files that mix all of it
CHANGED = """SELECT task_fingerprint AS record, task_type, level_used, outcome, op FROM (
  SELECT *, explode(CASE WHEN level_used = 3 AND outcome <> 'success' THEN array('retract', 'add') WHEN level_used = 1 THEN array('add', 'add') ELSE array('add') END) AS op FROM history)"""


@query("maintained_learner", f"""WITH kept AS (SELECT * FROM history WHERE NOT (level_used = 3 AND outcome <> 'success')),
{CELLS.replace("FROM history", "FROM kept")}, {advice_sql('c')}""", ["history"])
def _(spark, sf_dir):
    from weirworks.views import view
    view(spark, sf_dir, "history").createOrReplaceTempView("history")
    source, _ = T.paths(spark, "changes")
    path, checkpoint = T.paths(spark, "maintained")
    spark.sql(CHANGED).repartition(6).write.parquet(source)
    changes = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 2).parquet(source)
    M.maintain(changes, path, checkpoint)
    return M.maintained_learner(spark, path)
