"""Account for a usage log: savings, timelines, outcome rates, prices.

A usage log has log_ord, type, ts, session_id, tool, model, tokens_used, cloud_overhead_tokens,
output_tokens, duration_ms, quality_status, attempt_count, resolved_locally.  Every summary is one
conditional aggregation with map-side partial sums, so neither a hot tool nor a hot session matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import cost as C
from ..functions import text as X


def _n(flag: Column) -> Column:
    return F.count(F.when(flag, 1))


def _sum(value: Column, flag: Column | None = None) -> Column:
    chosen = value if flag is None else F.when(flag, value)
    return F.coalesce(F.sum(chosen), F.lit(0))


def _overhead() -> Column:
    return C.overhead_of(F.col("cloud_overhead_tokens"), F.col("tokens_used"))


def billable(log: DataFrame) -> DataFrame:
    """Completions and delegations with a token count: the base of the dashboard and of savings."""
    return log.where(F.col("type").isin("completion", "delegation") & F.col("tokens_used").isNotNull())


def _is_billable() -> Column:
    return F.col("type").isin("completion", "delegation") & F.col("tokens_used").isNotNull()


def add_cost(df: DataFrame, rate: Column, tokens: str, overhead: str, rounded: bool = True) -> DataFrame:
    """Gross, overhead and net cost of token totals; rounding, if any, comes last."""
    gross, spent = C.gross(F.col(tokens), rate), C.overhead_cost(F.col(overhead), rate)
    keep = C.round2 if rounded else (lambda c: c)
    return df.withColumns({"gross_cost": keep(gross), "overhead_cost": keep(spent), "net_cost": keep(gross - spent)})


# --- summaries -----------------------------------------------------------------------

def usage_summary(log: DataFrame, rate: float = dims.DEFAULT_RATE, by: list[str] = ()) -> DataFrame:
    """Counts, tokens and cost where only completions are local work; duration covers every row."""
    done = F.col("type") == "completion"
    totals = log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_tasks"),
        _n(done).alias("local_tasks"),
        _sum(F.col("duration_ms")).alias("total_duration_ms"),
        _sum(F.col("tokens_used"), done).alias("total_local_tokens"),
        _sum(C.overhead_of(F.col("cloud_overhead_tokens"), F.coalesce("tokens_used", F.lit(0))), done)
        .alias("total_cloud_overhead_tokens"),
        # rows without a session form one more session
        (F.count_distinct("session_id") + F.coalesce(F.max(F.col("session_id").isNull().cast("int")), F.lit(0)))
        .alias("sessions"))
    totals = totals.withColumn("net_tokens_saved", F.col("total_local_tokens") - F.col("total_cloud_overhead_tokens"))
    return add_cost(totals, F.lit(float(rate)), "total_local_tokens", "total_cloud_overhead_tokens")


def tool_frequency(log: DataFrame) -> DataFrame:
    """Uses per tool: a completion counts its tool once, other rows count each of their ``tools_used``."""
    single = log.where(F.col("type") == "completion").select("tool")
    others = log.where(F.coalesce(F.col("type"), F.lit("subagent")) != "completion")
    used = others.select(F.explode("tools_used").alias("tool"))
    return single.unionByName(used).groupBy("tool").agg(F.count(F.lit(1)).alias("n"))


def dashboard_summary(log: DataFrame, rate: float = dims.DEFAULT_RATE) -> DataFrame:
    """Like the usage summary, but completions and delegations both count when they have tokens."""
    ok = _is_billable()
    totals = log.agg(
        F.count(F.lit(1)).alias("total_tasks"), _n(ok).alias("local_tasks"),
        _sum(F.col("tokens_used"), ok).alias("total_local_tokens"), _sum(_overhead(), ok).alias("total_cloud_overhead"),
        F.count_distinct("session_id").alias("sessions"))
    totals = totals.withColumn("net_tokens_saved", F.col("total_local_tokens") - F.col("total_cloud_overhead"))
    return add_cost(totals, F.lit(float(rate)), "total_local_tokens", "total_cloud_overhead")


def day_of(ts: Column) -> Column:
    """The UTC day, whatever the session's time zone."""
    return F.coalesce(F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd"), F.lit("unknown"))


def daily_totals(log: DataFrame) -> DataFrame:
    return billable(log).groupBy(day_of(F.col("ts")).alias("date")).agg(
        F.sum("tokens_used").alias("tokens"), F.sum(_overhead()).alias("overhead"), F.count(F.lit(1)).alias("tasks"))


def daily_timeline(log: DataFrame) -> DataFrame:
    """Tokens, overhead and tasks per day, oldest first."""
    return daily_totals(log).orderBy("date")


def value_counts(log: DataFrame, column: str) -> DataFrame:
    """Billable tasks per tool or model; a missing name counts as ``unknown``."""
    name = F.coalesce(column, F.lit("unknown")).alias(column)
    return billable(log).groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def tools_by_count(log: DataFrame) -> DataFrame:
    return value_counts(log, "tool").orderBy(F.col("n").desc(), "tool")


def _rate_of(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def delegation_summary(log: DataFrame) -> DataFrame:
    """Outcome counts and averages over delegations; all zero without any."""
    d = log.where(F.col("type") == "delegation").agg(
        F.count(F.lit(1)).alias("total_delegations"),
        _n(F.col("resolved_locally")).alias("resolved_locally"),
        _n(~F.coalesce("resolved_locally", F.lit(False))).alias("escalated"),
        _n(F.col("attempt_count") > 1).alias("_retried"), _sum(F.col("attempt_count")).alias("_attempts"),
        _sum(F.col("tokens_used")).alias("total_local_tokens"), _sum(F.col("duration_ms")).alias("_duration"))
    total = F.col("total_delegations")
    return d.select(
        "total_delegations", "resolved_locally", "escalated",
        _rate_of(F.col("resolved_locally"), total).alias("resolution_rate"),
        _rate_of(F.col("_retried"), total).alias("retry_rate"),
        _rate_of(F.col("_attempts"), total).alias("avg_attempts"),
        "total_local_tokens", _rate_of(F.col("_duration"), total).alias("avg_duration_ms"))


def quality_breakdown(log: DataFrame) -> DataFrame:
    """Delegations per outcome; the three known outcomes are there even when none occurred."""
    seen = log.where(F.col("type") == "delegation").groupBy(
        F.coalesce("quality_status", F.lit("undefined")).alias("quality_status")).agg(F.count(F.lit(1)).alias("n"))
    zeros = F.array(*[F.struct(F.lit(s).alias("quality_status"), F.lit(0).cast("bigint").alias("n"))
                      for s in dims.QUALITY_STATUSES])
    known = log.sparkSession.range(1).select(F.inline(zeros))
    return seen.unionByName(known).groupBy("quality_status").agg(F.sum("n").alias("n"))


def dashboard_delegation_stats(log: DataFrame) -> DataFrame:
    """Outcome rates where a retry is any outcome but acceptance at once."""
    is_status = lambda s: _n(F.col("quality_status") == s).alias(s)
    d = billable(log).where(F.col("type") == "delegation").agg(
        *[is_status(s) for s in dims.QUALITY_STATUSES],
        _sum(F.coalesce("attempt_count", F.lit(1))).alias("_attempts"),
        _sum(F.col("tokens_used")).alias("total_delegation_tokens"))
    d = d.withColumn("total", F.col("accepted") + F.col("retried_accepted") + F.col("escalated"))
    total = F.col("total")
    return d.select(
        "total", *dims.QUALITY_STATUSES,
        _rate_of(F.col("accepted") + F.col("retried_accepted"), total).alias("resolution_rate"),
        _rate_of(F.col("retried_accepted") + F.col("escalated"), total).alias("retry_rate"),
        _rate_of(F.col("_attempts"), total).alias("avg_attempts"), "total_delegation_tokens")


def savings(log: DataFrame, rate: float = dims.DEFAULT_RATE) -> DataFrame:
    totals = billable(log).agg(_sum(F.col("tokens_used")).alias("total_local_tokens"),
                               F.count(F.lit(1)).alias("local_tasks"), _sum(_overhead()).alias("overhead_tokens"))
    return add_cost(totals, F.lit(float(rate)), "total_local_tokens", "overhead_tokens")


def status_counts(log: DataFrame) -> DataFrame:
    """Records in the log and their local tokens, for a one-line status."""
    return log.agg(F.count(F.lit(1)).alias("records"), _sum(F.col("tokens_used")).alias("local_tokens"))


def efficiency_kpi(summary: DataFrame) -> DataFrame:
    """Share of local tokens left after overhead, in whole per cent; expects a dashboard summary."""
    tokens, overhead = F.col("total_local_tokens"), F.col("total_cloud_overhead")
    ratio = F.floor((tokens - overhead) / tokens * F.lit(100.0) + F.lit(0.5)).cast("bigint")
    return summary.withColumn("efficiency", F.when(tokens > 0, ratio).otherwise(0))


def status_shares(stats: DataFrame) -> DataFrame:
    """Per cent of each outcome and of resolution; expects the dashboard's delegation stats."""
    total = F.col("total")
    share = lambda s: F.coalesce(F.try_divide(F.col(s).cast("double"), total.cast("double")) * F.lit(100.0), F.lit(0.0))
    resolved = F.floor(F.col("resolution_rate") * F.lit(100.0) + F.lit(0.5)).cast("bigint")
    return stats.select("total", *[share(s).alias(f"{s}_pct") for s in dims.QUALITY_STATUSES],
                        resolved.alias("resolution_pct"))


def batch_summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count(F.lit(1)).alias("total_tasks"), _sum(F.col("tokens_used")).alias("total_tokens"),
                       _sum(F.col("duration_ms")).alias("total_duration_ms"))


# --- what-if reports -----------------------------------------------------------------

def savings_by_price_tier(log: DataFrame, tiers: list[tuple[str, float]] | None = None) -> DataFrame:
    """One aggregation of the log, then one row per price tier."""
    tiers = tiers or [*dims.PRICE_TIERS, ("default", dims.DEFAULT_RATE)]
    listed = F.array(*[F.struct(F.lit(n).alias("tier"), F.lit(float(r)).alias("rate")) for n, r in tiers])
    totals = billable(log).agg(_sum(F.col("tokens_used")).alias("tokens"), _sum(_overhead()).alias("overhead"))
    return add_cost(totals.select("*", F.inline(listed)), F.col("rate"), "tokens", "overhead")


def threshold_sweep(log: DataFrame, cutoffs: list[int], rate: float = dims.DEFAULT_RATE) -> DataFrame:
    """Efficiency and net cost if only outputs of at least each cut-off were delegated; a cut-off that no row reaches
    has zeros.

    Rows are first summed per band between cut-offs; each band's sums then count for every cut-off at or
    below it, so the log is scanned once and never multiplied.
    """
    cuts = sorted(set(cutoffs))
    listed = F.array(*[F.lit(c).cast("bigint") for c in cuts])
    band = F.size(F.filter(listed, lambda c: F.col("tokens_used") >= c))
    bands = billable(log).withColumn("_band", band).where("_band > 0").groupBy("_band").agg(
        F.sum("tokens_used").alias("tokens"), F.sum(C.cloud_overhead(F.col("tokens_used"))).alias("overhead"),
        F.count(F.lit(1)).alias("tasks"))
    # at most one row for each cut-off: the bands are summed from the highest down in one expression, however many there are
    held = bands.agg(F.collect_list(F.struct("_band", "tokens", "overhead", "tasks")).alias("bands"))
    total = lambda k, p: F.aggregate(F.filter("bands", lambda b: b["_band"] >= k), F.lit(0).cast("bigint"), lambda a, b: a + b[p]).alias(p)
    row = lambda k: F.struct(F.element_at(listed, k).alias("cutoff"), *[total(k, p) for p in ("tokens", "overhead", "tasks")])
    sums = held.select(F.inline(F.transform(F.sequence(F.lit(1), F.lit(len(cuts))), row)))
    priced = add_cost(sums, F.lit(float(rate)), "tokens", "overhead", rounded=False)
    ratio = F.when(F.col("gross_cost") > 0, F.col("net_cost") / F.col("gross_cost")).otherwise(0.0)
    return priced.withColumn("efficiency", ratio)


def gated_cost(log: DataFrame, rate: float = dims.DEFAULT_RATE) -> DataFrame:
    """Delegations priced with the gate (an escalation returns a small payload) and without it."""
    out = F.coalesce("output_tokens", "tokens_used")
    escalated = F.col("quality_status") == "escalated"
    spent = F.when(escalated, dims.ESCALATION_OVERHEAD).otherwise(C.cloud_overhead(out))
    base = log.where((F.col("type") == "delegation") & F.col("tokens_used").isNotNull())
    sums = base.agg(_sum(F.col("tokens_used")).alias("gated_tokens"), _sum(spent).alias("gated_overhead"),
                    _sum(out).alias("ungated_tokens"), _sum(C.cloud_overhead(out)).alias("ungated_overhead"),
                    _n(escalated).alias("escalated"), F.count(F.lit(1)).alias("total"))
    r = F.lit(float(rate))
    net = lambda kind: C.gross(F.col(f"{kind}_tokens"), r) - C.overhead_cost(F.col(f"{kind}_overhead"), r)
    return sums.withColumns({"gated_net": net("gated"), "ungated_net": net("ungated")})


def project(daily: DataFrame, work_days: int = dims.WORK_DAYS, scales: list[float] = (1.0,),
            tiers: list[tuple[str, float]] | None = None) -> DataFrame:
    """Month tokens and cost per tier and scale, from the average day."""
    tiers = tiers or dims.PRICE_TIERS
    cases = F.array(*[F.struct(F.lit(n).alias("tier"), F.lit(float(r)).alias("rate"), F.lit(float(s)).alias("scale"))
                      for n, r in tiers for s in scales])
    days = daily.agg(F.sum("tokens").alias("_t"), F.sum("overhead").alias("_o"), F.count(F.lit(1)).alias("_n"))
    month = lambda c: F.col(c) / F.col("_n") * F.col("scale") * F.lit(float(work_days))
    out = days.select("*", F.inline(cases)).withColumns({"month_tokens": month("_t"), "month_overhead": month("_o")})
    return add_cost(out.drop("_t", "_o", "_n"), F.col("rate"), "month_tokens", "month_overhead")


# --- rows ---------------------------------------------------------------------------

def log_order(log: DataFrame) -> tuple[DataFrame, list[str]]:
    """The log and the columns that order its rows: ``log_ord``, or the time and a hash of the record where it has none,
    as logs read from files do."""
    if "log_ord" in log.columns:
        return log, ["log_ord"]
    return log.withColumn("record", record_key(log)), ["ts", "record"]


def record_key(log: DataFrame) -> Column:
    """A hash of all fields, the same for a record that was appended again."""
    return F.xxhash64(*[F.col(c) for c in sorted(log.columns)])


def newest(log: DataFrame, n: int) -> DataFrame:
    """The last n rows by log order, columns as they are."""
    ordered, order = log_order(log)
    return ordered.orderBy(*[F.col(c).desc_nulls_last() for c in order]).limit(n).select(*log.columns)


def recent(log: DataFrame, n: int = 50) -> DataFrame:
    """The newest billable rows by log order, ties in time by record; a top-k, so no full sort."""
    ordered, order = log_order(billable(log))
    named = ordered.select(
        *dict.fromkeys([*order, "ts"]), F.coalesce("tool", F.lit("unknown")).alias("tool"),
        F.coalesce("model", F.lit("unknown")).alias("model"), F.col("tokens_used").alias("tokens"),
        _overhead().alias("overhead"), F.coalesce("duration_ms", F.lit(0)).alias("duration_ms"),
        F.when(F.col("type") == "delegation", F.col("quality_status")).alias("quality_status"),
        F.when(F.col("type") == "delegation", F.col("attempt_count")).alias("attempt_count"))
    return named.orderBy(*[F.col(c).desc_nulls_last() for c in order]).limit(n)


def feed(log: DataFrame, n: int = 20) -> DataFrame:
    """The newest rows as the activity feed shows them, with the net gain of each."""
    net = F.col("tokens") - F.col("overhead")
    # small negative counts stay below a thousand in print, so only gains use the K and M forms
    shown = F.when(net >= 0, F.concat(F.lit("+"), X.fmt_tokens(net))).otherwise(net.cast("string"))
    model = F.when(F.length("model") > 20, F.concat(F.substring("model", 1, 20), F.lit("..."))).otherwise(F.col("model"))
    order = ["log_ord"] if "log_ord" in log.columns else ["ts", "record"]
    return recent(log, n).select(*order, "tool", model.alias("model"), "quality_status", net.alias("net"),
                                 X.fmt_tokens(F.col("tokens")).alias("tokens"), X.fmt_tokens(F.col("overhead")).alias("overhead"),
                                 shown.alias("net_shown"), X.fmt_duration(F.col("duration_ms")).alias("duration"))


def union_records(subagents: DataFrame, completions: DataFrame, delegations: DataFrame) -> DataFrame:
    """The three record kinds as one log; absent fields are null."""
    tagged = lambda df, kind: df.withColumn("type", F.lit(kind)) if "type" not in df.columns else df
    return (tagged(subagents, "subagent").unionByName(tagged(completions, "completion"), allowMissingColumns=True)
            .unionByName(tagged(delegations, "delegation"), allowMissingColumns=True))


def route_mix(decisions: DataFrame, by: list[str]) -> DataFrame:
    """Decisions per route with the local share and the delegation rate local / (local + cloud)."""
    mix = decisions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[_n(F.col("route") == r).alias(r) for r in ("no_llm", "local", "cloud")])
    pct = lambda part, whole: F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(100.0), F.lit(0.0))
    return mix.withColumns({"local_share": pct(F.col("local"), F.col("n")),
                            "delegation_rate": pct(F.col("local"), F.col("local") + F.col("cloud"))})
