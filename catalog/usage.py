"""Usage accounting and learning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirworks import dims
from weirworks.functions import cost as C
from weirworks.functions import text as X
from weirworks.operators import learning as L
from weirworks.operators import ranges as G
from weirworks.operators import usage as U
from weirworks.operators.routing import light_budget, skip_short
from weirworks.sources import daily, logs
from weirworks.sources.workdir import new_path, written
from weirworks.views import table, view

from .base import (blended, case_of, costs, count, dbl, est_tokens, fixed, gross, lit, NONSPACE, on_view, overhead,
                   query, recorded, round2, spent, units)

OK = "type IN ('completion','delegation') AND tokens_used IS NOT NULL"
RATE = dbl(8.0)
DAY = "coalesce(strftime(ts, '%Y-%m-%d'), 'unknown')"
TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"


# --- sources ---------------------------------------------------------------------------

def log_lines(spark, sf_dir):
    """The usage log as JSON lines, with a blank and two malformed lines after every record."""
    log = view(spark, sf_dir, "usage_log").withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    line = F.to_json(F.struct(*[c for c in log.columns if c not in ("ts", "log_ord")]))
    broken = [F.lit(""), F.lit("{ broken json !!!"), F.lit("not json at all")]
    return log.select("log_ord", F.explode(F.array(line, *broken)).alias("value"))


LOG_COLUMNS = ["log_ord", "type", "session_id", "tool", "model", "tokens_used", "cloud_overhead_tokens",
               "output_tokens", "duration_ms", "quality_status", "attempt_count", "resolved_locally"]


@query("read_usage_log", f"SELECT {', '.join(LOG_COLUMNS)}, {TS.format('ts')} AS at FROM usage_log", ["usage_log"])
def _(spark, sf_dir):
    log = logs.parse_lines(log_lines(spark, sf_dir), logs.USAGE_FIELDS)
    return log.select(*LOG_COLUMNS, F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("daily_log", f"""SELECT {', '.join(c for c in LOG_COLUMNS if c != 'log_ord')}, {TS.format('ts')} AS at, strftime(ts, '%Y-%m-%d') AS kept_under
FROM usage_log""", ["usage_log"])
def _(spark, sf_dir):
    """The whole log through the data source of its own: written by day and kind, and read back."""
    path = new_path(spark, "daily-log")
    daily.append_daily_log(view(spark, sf_dir, "usage_log"), path)
    return daily.read_daily_log(spark, path).select(*[c for c in LOG_COLUMNS if c != "log_ord"], F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"),
                                                    F.col("day").cast("string").alias("kept_under"))


@query("daily_log_range", f"""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS records, CAST(sum(tokens_used) AS BIGINT) AS tokens
FROM usage_log WHERE type = 'completion' AND ts >= (SELECT date_trunc('day', max(ts)) FROM usage_log) - INTERVAL '7' DAY GROUP BY 1""", ["usage_log"])
def _(spark, sf_dir):
    """Completions of the last eight days; files of other days and kinds are not opened."""
    path, log = new_path(spark, "daily-log"), view(spark, sf_dir, "usage_log")
    daily.append_daily_log(log, path)
    since = log.agg(F.date_sub(F.to_date(F.max("ts")), 7)).first()[0]
    rows = daily.read_daily_log(spark, path).where((F.col("day") >= F.lit(since)) & (F.col("kind") == "completion"))
    return rows.groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("records"), F.sum("tokens_used").alias("tokens"))


@query("read_delegations", f"SELECT {', '.join(LOG_COLUMNS)} FROM usage_log WHERE type = 'delegation'", ["usage_log"])
def _(spark, sf_dir):
    return logs.delegations(logs.parse_lines(log_lines(spark, sf_dir), logs.USAGE_FIELDS)).select(*LOG_COLUMNS)


@query("read_history", f"SELECT task_fingerprint, task_type, level_used, outcome, {TS.format('ts')} AS at FROM history",
       ["history"])
def _(spark, sf_dir):
    past = view(spark, sf_dir, "history").withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    line = F.to_json(F.struct(*[c for c in past.columns if c != "ts"]))
    lines = past.select(F.explode(F.array(line, F.lit("{\"task_type\": "))).alias("value"))
    rows = logs.parse_lines(lines, logs.HISTORY_FIELDS)
    return rows.select("task_fingerprint", "task_type", "level_used", "outcome",
                       F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("ingest_subagent_events", f"""
SELECT 'local-worker' AS agent, CASE WHEN event_id % 4 = 0 THEN 0 ELSE CAST(floor(value) AS BIGINT) END AS duration_ms,
  CASE WHEN event_id % 3 = 0 THEN 'bash,read_file' ELSE '' END AS tools,
  CASE WHEN user_id % 5 = 0 THEN 'unknown' ELSE 's' || CAST(user_id AS VARCHAR(20)) END AS session_id,
  {TS.format('ts')} AS at
FROM events WHERE event_type IN ('view', 'error')""")
def _(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    raw = ev.select(
        F.when(F.col("event_type").isin("view", "error"), "local-worker").otherwise("other").alias("agent_name"),
        F.when(F.col("event_id") % 4 != 0, F.floor("value")).alias("duration_ms"),
        F.when(F.col("event_id") % 3 == 0, F.array(F.lit("bash"), F.lit("read_file"))).alias("tools_used"),
        F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("s"), F.col("user_id").cast("string"))).alias("session_id"), "ts")
    out = logs.ingest_subagent_events(raw)
    return out.select("agent", "duration_ms", F.array_join("tools_used", ",").alias("tools"), "session_id",
                      F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


# --- summaries -------------------------------------------------------------------------

def summary_sql(by: str = "") -> str:
    done = "type = 'completion'"
    over = f"coalesce(cloud_overhead_tokens, {overhead('coalesce(tokens_used, 0)')})"
    return f"""WITH t AS (SELECT {by + ',' if by else ''} count(*) AS total_tasks, count(*) FILTER ({done}) AS local_tasks,
  CAST(coalesce(sum(duration_ms), 0) AS BIGINT) AS total_duration_ms,
  CAST(coalesce(sum(tokens_used) FILTER ({done}), 0) AS BIGINT) AS total_local_tokens,
  CAST(coalesce(sum({over}) FILTER ({done}), 0) AS BIGINT) AS total_cloud_overhead_tokens,
  count(DISTINCT session_id) AS sessions FROM usage_log {'GROUP BY ' + by if by else ''})
SELECT *, total_local_tokens - total_cloud_overhead_tokens AS net_tokens_saved,
  {costs('total_local_tokens', 'total_cloud_overhead_tokens', RATE)} FROM t"""


on_view("usage_summary", "usage_log", U.usage_summary, summary_sql())
on_view("usage_summary_by_session", "usage_log", lambda log: U.usage_summary(log, by=["session_id"]),
        summary_sql("session_id"))

on_view("tool_frequency", "usage_log",
        lambda log: U.tool_frequency(log.withColumn("tools_used", F.when(
            F.col("type") == "subagent", F.array(F.lit("bash"), F.lit("read_file"))))),
        """SELECT tool, count(*) AS n FROM (SELECT tool FROM usage_log WHERE type = 'completion'
        UNION ALL SELECT unnest(['bash','read_file']) FROM usage_log WHERE type = 'subagent') GROUP BY tool""")

DASHBOARD = f"""d AS (SELECT count(*) AS total_tasks, count(*) FILTER ({OK}) AS local_tasks,
  CAST(coalesce(sum(tokens_used) FILTER ({OK}), 0) AS BIGINT) AS total_local_tokens,
  CAST(coalesce(sum({recorded()}) FILTER ({OK}), 0) AS BIGINT) AS total_cloud_overhead,
  count(DISTINCT session_id) AS sessions FROM usage_log),
dash AS (SELECT *, total_local_tokens - total_cloud_overhead AS net_tokens_saved,
  {costs('total_local_tokens', 'total_cloud_overhead', RATE)} FROM d)"""
on_view("dashboard_summary", "usage_log", U.dashboard_summary, f"WITH {DASHBOARD} SELECT * FROM dash")
on_view("efficiency_kpi", "usage_log", lambda log: U.efficiency_kpi(U.dashboard_summary(log)),
        f"""WITH {DASHBOARD} SELECT *, CASE WHEN total_local_tokens > 0 THEN CAST(floor((total_local_tokens - total_cloud_overhead)
        / CAST(total_local_tokens AS DOUBLE) * {dbl(100.0)} + {dbl(0.5)}) AS BIGINT) ELSE 0 END AS efficiency FROM dash""")

TIMELINE = f"""SELECT {DAY} AS date, CAST(sum(tokens_used) AS BIGINT) AS tokens, CAST(sum({recorded()}) AS BIGINT) AS overhead,
  count(*) AS tasks FROM usage_log WHERE {OK} GROUP BY 1"""
on_view("daily_timeline", "usage_log", U.daily_timeline, TIMELINE + " ORDER BY 1")
for column in ("tool", "model"):
    on_view(f"{column}_counts", "usage_log", lambda log, c=column: U.value_counts(log, c),
            f"SELECT coalesce({column}, 'unknown') AS {column}, count(*) AS n FROM usage_log WHERE {OK} GROUP BY 1")
on_view("tools_by_count", "usage_log", U.tools_by_count,
        f"SELECT coalesce(tool, 'unknown') AS tool, count(*) AS n FROM usage_log WHERE {OK} GROUP BY 1 ORDER BY 2 DESC, 1")

on_view("delegation_summary", "usage_log", U.delegation_summary, """
SELECT count(*) AS total_delegations, count(*) FILTER (resolved_locally) AS resolved_locally,
  count(*) FILTER (NOT resolved_locally) AS escalated,
  count(*) FILTER (resolved_locally) / CAST(count(*) AS DOUBLE) AS resolution_rate,
  count(*) FILTER (attempt_count > 1) / CAST(count(*) AS DOUBLE) AS retry_rate,
  sum(attempt_count) / CAST(count(*) AS DOUBLE) AS avg_attempts,
  CAST(sum(tokens_used) AS BIGINT) AS total_local_tokens, sum(duration_ms) / CAST(count(*) AS DOUBLE) AS avg_duration_ms
FROM usage_log WHERE type = 'delegation'""")
on_view("quality_breakdown", "usage_log", U.quality_breakdown, """
SELECT s.quality_status, count(u.type) AS n FROM (SELECT unnest(['accepted','retried_accepted','escalated']) AS quality_status) s
LEFT JOIN (SELECT * FROM usage_log WHERE type = 'delegation') u ON u.quality_status = s.quality_status GROUP BY 1""")
STATS = f"""x AS (SELECT count(*) FILTER (quality_status = 'accepted') AS accepted,
  count(*) FILTER (quality_status = 'retried_accepted') AS retried_accepted,
  count(*) FILTER (quality_status = 'escalated') AS escalated, sum(coalesce(attempt_count, 1)) AS attempts,
  CAST(coalesce(sum(tokens_used), 0) AS BIGINT) AS total_delegation_tokens
  FROM usage_log WHERE type = 'delegation' AND tokens_used IS NOT NULL),
y AS (SELECT *, accepted + retried_accepted + escalated AS total FROM x),
stats AS (SELECT total, accepted, retried_accepted, escalated, (accepted + retried_accepted) / CAST(total AS DOUBLE) AS resolution_rate,
  (retried_accepted + escalated) / CAST(total AS DOUBLE) AS retry_rate, attempts / CAST(total AS DOUBLE) AS avg_attempts,
  total_delegation_tokens FROM y)"""
on_view("dashboard_delegation_stats", "usage_log", U.dashboard_delegation_stats, f"WITH {STATS} SELECT * FROM stats")
on_view("status_shares", "usage_log", lambda log: U.status_shares(U.dashboard_delegation_stats(log)), f"""WITH {STATS}
SELECT total, accepted / CAST(total AS DOUBLE) * {dbl(100.0)} AS accepted_pct,
  retried_accepted / CAST(total AS DOUBLE) * {dbl(100.0)} AS retried_accepted_pct,
  escalated / CAST(total AS DOUBLE) * {dbl(100.0)} AS escalated_pct,
  CAST(floor(resolution_rate * {dbl(100.0)} + {dbl(0.5)}) AS BIGINT) AS resolution_pct FROM stats""")
SUMS = f"""SELECT CAST(sum(tokens_used) AS BIGINT) AS tokens, count(*) AS n, CAST(sum({recorded()}) AS BIGINT) AS overhead
FROM usage_log WHERE {OK}"""
on_view("savings", "usage_log", U.savings, f"""WITH s AS ({SUMS}) SELECT tokens AS total_local_tokens, n AS local_tasks,
  overhead AS overhead_tokens, {costs('tokens', 'overhead', RATE)} FROM s""")
on_view("status_counts", "usage_log", U.status_counts,
        "SELECT count(*) AS records, CAST(coalesce(sum(tokens_used), 0) AS BIGINT) AS local_tokens FROM usage_log")
on_view("batch_summary", "usage_log", U.batch_summary, """SELECT count(*) AS total_tasks,
  CAST(sum(tokens_used) AS BIGINT) AS total_tokens, CAST(sum(duration_ms) AS BIGINT) AS total_duration_ms FROM usage_log""")

# --- what-if ---------------------------------------------------------------------------

TIERS = "(VALUES ('opus', CAST(25 AS DOUBLE)), ('sonnet', CAST(15 AS DOUBLE)), ('haiku', CAST(5 AS DOUBLE)){}) v(tier, rate)"
on_view("savings_by_price_tier", "usage_log", U.savings_by_price_tier, f"""WITH s AS ({SUMS})
SELECT tokens, overhead, tier, rate, {costs('tokens', 'overhead', 'rate')}
FROM s, {TIERS.format(", ('default', CAST(8 AS DOUBLE))")}""")
CUTOFFS = [0, 50, 100, 200, 300, 500, 750, 1000, 10 ** 12]    # no row reaches the last
on_view("threshold_sweep", "usage_log", lambda log: U.threshold_sweep(log, CUTOFFS), f"""
WITH b AS (SELECT tokens_used, {overhead('tokens_used')} AS o FROM usage_log WHERE {OK}),
s AS (SELECT cutoff, CAST(coalesce(sum(tokens_used), 0) AS BIGINT) AS tokens, CAST(coalesce(sum(o), 0) AS BIGINT) AS overhead,
  count(tokens_used) AS tasks FROM (SELECT CAST(unnest({CUTOFFS}) AS BIGINT) AS cutoff) c LEFT JOIN b ON tokens_used >= cutoff GROUP BY 1),
p AS (SELECT *, {costs('tokens', 'overhead', RATE, rounded=False)} FROM s)
SELECT *, CASE WHEN gross_cost > 0 THEN net_cost / gross_cost ELSE 0 END AS efficiency FROM p""")
OUT = "coalesce(output_tokens, tokens_used)"
on_view("gated_cost", "usage_log", U.gated_cost, f"""
WITH s AS (SELECT CAST(sum(tokens_used) AS BIGINT) AS gated_tokens,
  CAST(sum(CASE WHEN quality_status = 'escalated' THEN 150 ELSE {overhead(OUT)} END) AS BIGINT) AS gated_overhead,
  CAST(sum({OUT}) AS BIGINT) AS ungated_tokens, CAST(sum({overhead(OUT)}) AS BIGINT) AS ungated_overhead,
  count(*) FILTER (quality_status = 'escalated') AS escalated, count(*) AS total
  FROM usage_log WHERE type = 'delegation' AND tokens_used IS NOT NULL)
SELECT *, {gross('gated_tokens', RATE)} - {spent('gated_overhead', RATE)} AS gated_net,
  {gross('ungated_tokens', RATE)} - {spent('ungated_overhead', RATE)} AS ungated_net FROM s""")
MONTH = f"/ CAST(n AS DOUBLE) * scale * {dbl(22.0)}"
on_view("project", "usage_log", lambda log: U.project(U.daily_totals(log), scales=[1.0, 20 / 3]), f"""
WITH days AS ({TIMELINE}), a AS (SELECT sum(tokens) AS t, sum(overhead) AS o, count(*) AS n FROM days),
m AS (SELECT tier, rate, scale, t {MONTH} AS month_tokens, o {MONTH} AS month_overhead
  FROM a, {TIERS.format('')}, (SELECT unnest([{dbl(1.0)}, {dbl(20 / 3)}]) AS scale))
SELECT *, {costs('month_tokens', 'month_overhead', 'rate')} FROM m""")

# --- rows ------------------------------------------------------------------------------

ROWS = f"""SELECT log_ord, {TS.format('ts')} AS at, coalesce(tool, 'unknown') AS tool, coalesce(model, 'unknown') AS model,
  tokens_used AS tokens, {recorded()} AS overhead, coalesce(duration_ms, 0) AS duration_ms,
  CASE WHEN type = 'delegation' THEN quality_status END AS quality_status,
  CASE WHEN type = 'delegation' THEN attempt_count END AS attempt_count FROM usage_log WHERE {OK}"""
on_view("recent", "usage_log",
        lambda log: U.recent(log).withColumn("at", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).drop("ts"),
        ROWS + " ORDER BY log_ord DESC LIMIT 50")


def fmt_tokens_sql(n: str) -> str:
    return case_of([(f"{n} >= 1000000", f"{fixed(f'({n} / {dbl(1e6)})', 1)} || 'M'"),
                    (f"{n} >= 1000", f"{fixed(f'({n} / {dbl(1e3)})', 1)} || 'K'")],
                   f"CAST(CAST(floor({n} + {dbl(0.5)}) AS BIGINT) AS VARCHAR)")


def fmt_duration_sql(ms: str) -> str:
    return case_of([(f"{ms} >= 60000", f"{fixed(f'({ms} / {dbl(60000.0)})', 1)} || 'm'"),
                    (f"{ms} >= 1000", f"{fixed(f'({ms} / {dbl(1000.0)})', 1)} || 's'")], f"CAST({ms} AS VARCHAR) || 'ms'")


on_view("feed", "usage_log", U.feed, f"""WITH r AS ({ROWS} ORDER BY log_ord DESC LIMIT 20)
SELECT log_ord, tool, CASE WHEN length(model) > 20 THEN substr(model, 1, 20) || '...' ELSE model END AS model, quality_status,
  tokens - overhead AS net, {fmt_tokens_sql('tokens')} AS tokens, {fmt_tokens_sql('overhead')} AS overhead,
  CASE WHEN tokens - overhead >= 0 THEN '+' || {fmt_tokens_sql('(tokens - overhead)')} ELSE CAST(tokens - overhead AS VARCHAR) END AS net_shown,
  {fmt_duration_sql('duration_ms')} AS duration FROM r""")

FILED = f"""f AS (SELECT * REPLACE (CAST(floor(tokens_used + {dbl(0.25)} + {dbl(0.5)}) AS BIGINT) AS tokens_used) FROM usage_log)"""


def filed_log(spark, sf_dir, name):
    """The log as files, every token count with a fraction, read back: no log order, only times."""
    path = new_path(spark, name)
    log = view(spark, sf_dir, "usage_log").withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    log = log.withColumn("tokens_used", F.col("tokens_used") + F.lit(0.25))
    log.select(F.to_json(F.struct(*[c for c in log.columns if c not in ("ts", "log_ord")])).alias("value")).write.text(path)
    return logs.read_usage_log(spark, path)


@query("recent_from_files", f"""WITH {FILED} SELECT {TS.format('ts')} AS at FROM f WHERE {OK} ORDER BY ts DESC LIMIT 50""", ["usage_log"])
def _(spark, sf_dir):
    """Times only: the order of rows with one time is a hash of the record."""
    return U.recent(filed_log(spark, sf_dir, "recent-files")).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("usage_summary_from_files", f"""WITH {FILED} SELECT count(*) AS rows_n, CAST(sum(tokens_used) AS BIGINT) AS tokens, count(*) FILTER ({OK}) AS billable FROM f""", ["usage_log"])
def _(spark, sf_dir):
    log = filed_log(spark, sf_dir, "summary-files")
    return log.agg(F.count(F.lit(1)).alias("rows_n"), F.sum("tokens_used").alias("tokens"), F.count(F.when(U._is_billable(), 1)).alias("billable"))


on_view("skip_short", "usage_log", lambda log: skip_short(log).select("log_ord", "tokens_used"),
        "SELECT log_ord, tokens_used FROM usage_log WHERE tokens_used >= 200")


@query("union_records", "SELECT type, count(*) AS n, CAST(sum(tokens_used) AS BIGINT) AS tokens, "
       "CAST(sum(duration_ms) AS BIGINT) AS duration_ms, count(quality_status) AS judged FROM usage_log GROUP BY type", ["usage_log"])
def _(spark, sf_dir):
    log = view(spark, sf_dir, "usage_log")
    of = lambda kind: log.where(F.col("type") == kind)
    both = U.union_records(of("subagent").select("session_id", "duration_ms"),
                           of("completion").select("session_id", "tool", "model", "tokens_used", "duration_ms"),
                           of("delegation").select("session_id", "tool", "tokens_used", "duration_ms", "quality_status"))
    return both.groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tokens_used").alias("tokens"), F.sum("duration_ms").alias("duration_ms"),
        F.count("quality_status").alias("judged"))


# --- scalars ---------------------------------------------------------------------------

on_view("cost_scalars", "usage_log", lambda log: log.select(
    "log_ord", C.cloud_overhead(F.col("tokens_used")).alias("estimated_overhead"),
    C.overhead_of(F.col("cloud_overhead_tokens"), F.col("tokens_used")).alias("overhead"),
    C.gross(F.col("tokens_used"), F.lit(15.0)).alias("gross"),
    C.overhead_cost(C.cloud_overhead(F.col("tokens_used")), F.lit(15.0)).alias("overhead_cost"),
    C.breaks_even(F.col("tokens_used"), F.lit(15.0)).alias("gain"),
    C.two_price_cost(F.col("tokens_used"), F.col("duration_ms"), 3.0, 15.0).alias("two_price")), f"""
SELECT log_ord, {overhead('tokens_used')} AS estimated_overhead, {recorded()} AS overhead, {gross('tokens_used', dbl(15.0))} AS gross,
  {spent(overhead('tokens_used'), dbl(15.0))} AS overhead_cost, tokens_used >= 22 AS gain,
  (tokens_used * {dbl(3.0)} + duration_ms * {dbl(15.0)}) / {dbl(1e6)} AS two_price
FROM usage_log""")

SIZE = "CAST(tokens_used * tokens_used * 7 AS BIGINT)"
NOW = "TIMESTAMP '2024-02-01 00:00:00'"
AGE = f"((epoch_ms({NOW}) - epoch_ms(ts)) / {dbl(1000.0)})"
on_view("number_formats", "usage_log", lambda log: log.select(
    "log_ord", X.fmt_tokens(F.col("tokens_used") * F.col("duration_ms")).alias("tokens"),
    X.fmt_cost((F.col("tokens_used") - 100) / F.lit(100.0)).alias("cost"),
    X.fmt_duration(F.col("duration_ms") * F.col("tokens_used")).alias("duration"),
    X.fmt_size(F.col("tokens_used") * F.col("tokens_used") * 7).alias("size"),
    X.time_ago(F.col("ts"), F.lit("2024-02-01 00:00:00").cast("timestamp")).alias("age")), f"""
SELECT log_ord, {fmt_tokens_sql('(tokens_used * duration_ms)')} AS tokens,
  CASE WHEN tokens_used >= 100 THEN '$' ELSE '-$' END || {fixed(f'abs((tokens_used - 100) / {dbl(100.0)})', 2)} AS cost,
  {fmt_duration_sql('(duration_ms * tokens_used)')} AS duration,
  {case_of([(f'{SIZE} < 1024', f"CAST({SIZE} AS VARCHAR) || 'B'"),
            (f'{SIZE} < 1048576', fixed(f'({SIZE} / {dbl(1024.0)})', 1) + " || 'KB'")],
           fixed(f'({SIZE} / {dbl(1048576.0)})', 1) + " || 'MB'")} AS size,
  {case_of([(f'{AGE} < 60', "'just now'"), (f'{AGE} < 3600', f"CAST(CAST(floor({AGE} / 60) AS BIGINT) AS VARCHAR) || 'm ago'"),
            (f'{AGE} < 86400', f"CAST(CAST(floor({AGE} / 3600) AS BIGINT) AS VARCHAR) || 'h ago'")],
           f"CAST(CAST(floor({AGE} / 86400) AS BIGINT) AS VARCHAR) || 'd ago'")} AS age
FROM usage_log""")

on_view("token_scalars", "documents", lambda d: d.select(
    "doc_id", X.estimate_tokens(F.col("text")).alias("est"), X.tokens_word(F.col("text")).alias("word"),
    X.tokens_char(F.col("text")).alias("chars"), X.tokens_blended(F.col("text")).alias("blended")), f"""
SELECT doc_id, {est_tokens('text')} AS est, CAST(ceil({count(NONSPACE, 'text')} * {dbl(1.3)}) AS BIGINT) AS word,
  CAST(ceil({units('text')} / {dbl(3.5)}) AS BIGINT) AS chars, {blended('text')} AS blended FROM documents""")
on_view("token_scalars_astral", "documents", lambda d: d.withColumn("text", F.expr("text || repeat(chr(169) || '\U0001F600', CAST(doc_id % 9 AS INT))")).select(
    "doc_id", X.estimate_tokens(F.col("text")).alias("est"), X.tokens_blended(F.col("text")).alias("blended")), f"""
WITH t AS (SELECT doc_id, text || repeat(chr(169) || chr(128512), CAST(doc_id % 9 AS INT)) AS text FROM documents)
SELECT doc_id, {est_tokens('text')} AS est, {blended('text')} AS blended FROM t""")

MODEL_ID = ("CASE p_partkey % 5 WHEN 0 THEN 'vendor/Opus-' WHEN 1 THEN 'sonnet-' WHEN 2 THEN 'x/haiku:' "
            "WHEN 3 THEN 'local:' ELSE '' END || p_brand")
on_view("price_rate", "part", lambda p: p.select(
    "p_partkey", C.price_rate(F.expr(MODEL_ID)).alias("rate"), X.short_model(F.expr(MODEL_ID)).alias("short_name")), f"""
SELECT p_partkey, CASE WHEN contains(lower({MODEL_ID}), 'opus') THEN {dbl(25.0)} WHEN contains(lower({MODEL_ID}), 'sonnet') THEN {dbl(15.0)}
  WHEN contains(lower({MODEL_ID}), 'haiku') THEN {dbl(5.0)} ELSE {dbl(8.0)} END AS rate,
  split_part(regexp_extract({MODEL_ID}, '([^/]*)$', 1), ':', 1) AS short_name FROM part""")

# --- learning --------------------------------------------------------------------------

CELLS = """c AS (SELECT task_type, level_used, count(*) AS n, count(*) FILTER (outcome = 'success') AS s FROM history GROUP BY 1, 2)"""


def advice_sql(cells: str) -> str:
    rate = "(s / CAST(n AS DOUBLE))"
    enough = "(total >= 50 AND type_n >= 10 AND n >= 5)"
    return f"""t AS (SELECT *, sum(n) OVER (PARTITION BY task_type) AS type_n, (SELECT count(*) FROM history) AS total FROM {cells})
SELECT task_type, level_used, n, CASE WHEN {enough} THEN {rate} END AS success_rate,
  CASE WHEN {enough} AND {rate} > 0.85 AND level_used > 1 THEN level_used - 1
       WHEN {enough} AND {rate} < 0.5 AND level_used < 5 THEN level_used + 1 END AS adjusted_level,
  CASE WHEN {enough} THEN ({rate} - {dbl(0.5)}) * {dbl(0.4)} ELSE 0 END AS confidence_adjustment,
  CASE WHEN total < 50 THEN 'Insufficient data (' || total || '/50 records)'
       WHEN type_n < 10 THEN 'Insufficient data for task type "' || task_type || '"'
       WHEN n < 5 THEN 'Insufficient data at level ' || level_used
       ELSE task_type || ' at level ' || level_used || ': ' || {fixed(f'({rate} * 100)', 0)} || '% success (' || n || ' samples)' END AS reason,
  CAST(CASE WHEN total < 50 THEN total WHEN type_n < 10 THEN type_n ELSE n END AS BIGINT) AS sample_size FROM t"""


on_view("learner", "history", L.learner, f"WITH {CELLS}, {advice_sql('c')}")
on_view("routing_advice", "history", L.routing_advice, f"""WITH {CELLS},
g AS (SELECT t.task_type, l.level_used, coalesce(n, 0) AS n, coalesce(s, 0) AS s
  FROM (SELECT unnest(['data_transform','analysis','code_mod','text','code_gen']) AS task_type) t
  CROSS JOIN (SELECT CAST(unnest(range(1, 7)) AS INT) AS level_used) l
  LEFT JOIN c ON c.task_type = t.task_type AND c.level_used = l.level_used), {advice_sql('g')}""")

TOOL = "CASE p_partkey % 5 WHEN 0 THEN 'complete' WHEN 1 THEN 'generate_code' WHEN 2 THEN 'analyze_file' WHEN 3 THEN 'batch' END"
BASE = case_of([(f"tool = '{t}' AND lvl = {n}", str(v)) for t, row in dims.BASELINES.items() for n, v in row.items()],
               case_of([(f"lvl = {n}", str(v)) for n, v in dims.BASELINES["complete"].items()], "NULL"))


@query("output_estimate", f"""
WITH r AS (SELECT p_partkey AS task_id, {TOOL} AS tool, p_size % 9 AS task_complexity, least(6, greatest(1, p_size % 9)) AS lvl FROM part),
h AS (SELECT tool, count(*) AS rows_n, count(*) FILTER ({OUT} > 0) AS n, sum({OUT}) FILTER ({OUT} > 0) AS s FROM usage_log
  WHERE type = 'completion' AND tool IS NOT NULL GROUP BY 1),
k AS (SELECT * FROM h WHERE rows_n >= 3 AND n >= 3)
SELECT task_id, r.tool, task_complexity, CASE WHEN n IS NOT NULL THEN CAST(ceil(s / CAST(n AS DOUBLE) * {dbl(1.25)}) AS BIGINT)
  ELSE CAST(ceil(({BASE.replace('tool =', 'r.tool =')}) * {dbl(1.25)}) AS BIGINT) END AS estimated_tokens,
  CASE WHEN n IS NOT NULL THEN 'historical' ELSE 'heuristic' END AS estimate_source,
  CASE WHEN n IS NOT NULL THEN least({dbl(0.9)}, {dbl(0.5)} + n * {dbl(0.05)}) ELSE {dbl(0.4)} END AS estimate_confidence,
  coalesce(n, 0) AS sample_size, CASE WHEN n IS NOT NULL THEN CAST(ceil(s / CAST(n AS DOUBLE) * {dbl(1.25)}) AS BIGINT)
  ELSE CAST(ceil(({BASE.replace('tool =', 'r.tool =')}) * {dbl(1.25)}) AS BIGINT) END <= 600 AS light
FROM r LEFT JOIN k ON k.tool = r.tool""", ["usage_log"])
def _(spark, sf_dir):
    log = view(spark, sf_dir, "usage_log")
    asked = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("task_id"), F.expr(TOOL).alias("tool"),
                                                (F.col("p_size") % 9).alias("task_complexity"))
    return L.output_estimate(asked, log).withColumn("light", light_budget(F.col("estimated_tokens"), 600))


# --- sinks -----------------------------------------------------------------------------

def appended_log(spark, sf_dir, kind, append):
    """Append the records of a kind in two writes and read the log back."""
    path = new_path(spark, f"append-{kind}")
    rows = view(spark, sf_dir, "usage_log").where(F.col("type") == kind).drop("type", "cloud_overhead_tokens")
    append(rows.where("log_ord % 2 = 0"), path)
    append(rows.where("log_ord % 2 = 1"), path)
    append(rows, path, enabled=False)
    return logs.read_usage_log(spark, path)


@query("append_completions", f"SELECT tool, model, session_id, tokens_used, {overhead('tokens_used')} AS cloud_overhead_tokens, duration_ms, "
       f"{TS.format('ts')} AS at FROM usage_log WHERE type = 'completion'", ["usage_log"])
def _(spark, sf_dir):
    log = appended_log(spark, sf_dir, "completion", logs.append_completions)
    return log.select("tool", "model", "session_id", "tokens_used", "cloud_overhead_tokens", "duration_ms",
                      F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("append_delegations", "SELECT tool, tokens_used, output_tokens, quality_status, attempt_count, resolved_locally, session_id "
       "FROM usage_log WHERE type = 'delegation'", ["usage_log"])
def _(spark, sf_dir):
    log = appended_log(spark, sf_dir, "delegation", logs.append_delegations)
    return log.select("tool", "tokens_used", "output_tokens", "quality_status", "attempt_count", "resolved_locally", "session_id")


@query("append_history", "SELECT task_fingerprint, task_type, level_used, outcome FROM history", ["history"])
def _(spark, sf_dir):
    path = new_path(spark, "append-history")
    logs.append_history(view(spark, sf_dir, "history"), path)
    return logs.read_history(spark, path).select("task_fingerprint", "task_type", "level_used", "outcome")


@query("truncate_log", "SELECT count(*) AS before, 0 AS after FROM usage_log", ["usage_log"])
def _(spark, sf_dir):
    path = new_path(spark, "truncate")
    logs.append_completions(view(spark, sf_dir, "usage_log"), path)
    before = logs.read_usage_log(spark, path).count()
    logs.truncate_log(spark, path)
    return logs.read_usage_log(spark, path).agg(F.lit(before).alias("before"), F.count(F.lit(1)).alias("after"))


# --- measures over ranges --------------------------------------------------------------------------------------------

on_view("token_medians", "usage_log", G.token_medians, f"""
WITH r AS (SELECT coalesce(tool, 'unknown') AS tool, strftime(ts, '%Y-%m-%d') AS day, tokens_used FROM usage_log WHERE {OK}),
n AS (SELECT *, row_number() OVER (PARTITION BY tool, day ORDER BY tokens_used) - 1 AS place, count(*) OVER (PARTITION BY tool, day) AS c FROM r)
SELECT tool, day, tokens_used AS median_tokens FROM n WHERE place = c // 2""")


@query("sessions_over", f"""
WITH r AS (SELECT strftime(ts, '%Y-%m-%d') AS day, session_id, tokens_used FROM usage_log WHERE {OK}),
s AS (SELECT unnest([day, substr(day, 1, 7), substr(day, 1, 4), 'all']) AS span, session_id, tokens_used FROM r)
SELECT span, count(*) AS tasks, CAST(sum(tokens_used) AS BIGINT) AS tokens, count(DISTINCT CASE WHEN session_id <> 'unknown' THEN session_id END) AS sessions,
  true AS within_bound FROM s GROUP BY span""", ["usage_log"])
def _(spark, sf_dir):
    """Days, months, years and all of it from the daily table alone, next to the exact count and whether the bound holds."""
    log = view(spark, sf_dir, "usage_log")
    daily = written(G.daily_sessions(log), "daily-sessions")
    spans = [G.sessions_over(daily, span) for span in (*G.SPANS, "all")]
    told = spans[0].unionByName(spans[1]).unionByName(spans[2]).unionByName(spans[3])
    rows = U.billable(log).select(U.day_of(F.col("ts")).alias("day"), F.when(F.col("session_id") != "unknown", F.col("session_id")).alias("s"))
    names = F.array("day", F.substring("day", 1, 7), F.substring("day", 1, 4), F.lit("all"))
    exact = rows.select(F.explode(names).alias("span"), "s").groupBy("span").agg(F.count_distinct("s").alias("exact"))
    return told.join(exact, "span").select("span", "tasks", "tokens", F.col("exact").alias("sessions"), F.col("exact").between(F.col("low"), F.col("high")).alias("within_bound"))
