"""Measures that do not add up, kept so that they can be asked for over any range: distinct sessions and medians."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workdir import written
from .usage import billable, day_of

LG_K = 12                    # 4096 registers: a standard error of 1.04 / 64, 1.6 percent
STANDARD_ERROR = 1.04 / 64
DIGIT = 15                   # bits of a value settled in one pass: at most 2 ** 15 rows for a group
SPANS = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}


# --- sessions ----------------------------------------------------------------------------------------------------

def daily_sessions(log: DataFrame) -> DataFrame:
    """One small row per UTC day: tasks, tokens, its sessions exactly, and a sketch of them that merges with other days'.

    Records that name no session (null or ``unknown``) count as tasks but not as a session.
    """
    named = F.when(F.col("session_id") != "unknown", F.col("session_id"))
    return billable(log).groupBy(day_of(F.col("ts")).alias("day")).agg(
        F.count(F.lit(1)).alias("tasks"), F.sum("tokens_used").alias("tokens"), F.count_distinct(named).alias("sessions"),
        F.hll_sketch_agg(named, F.lit(LG_K)).alias("sketch"))


def sessions_over(daily: DataFrame, span: str = "month", since: str | None = None, until: str | None = None) -> DataFrame:
    """Tasks, tokens and estimated sessions per day, month, year or over ``all`` of a range of days, from the daily table
    alone. ``low`` and ``high`` are the estimate's bounds of three standard errors."""
    rows = daily if since is None else daily.where(F.col("day") >= since)
    rows = rows if until is None else rows.where(F.col("day") <= until)
    name = F.lit("all") if span == "all" else F.substring("day", 1, len(SPANS[span]))
    sums = rows.groupBy(name.alias("span")).agg(F.sum("tasks").alias("tasks"), F.sum("tokens").alias("tokens"),
                                                F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("sessions"))
    return sums.withColumns({"low": F.floor(F.col("sessions") / F.lit(1 + 3 * STANDARD_ERROR)), "high": F.ceil(F.col("sessions") / F.lit(1 - 3 * STANDARD_ERROR))})


# --- medians -----------------------------------------------------------------------------------------------------

def grouped_quantile(rows: DataFrame, keys: list[str], value: str, part: tuple[int, int] = (1, 2)) -> DataFrame:
    """The value at place floor(n * part) of each group's ascending values, counted from 0: (1, 2) is the upper median.

    Values are whole numbers. They are first counted per group, and the counts are stored; each pass then settles
    ``DIGIT`` bits of all groups at once from a histogram of the values that are left. Only the smallest and the
    largest value come to the driver, a huge group is never in one task, and a pass sums at most 2 ** ``DIGIT`` rows of
    a group. Null values do not count, a group of nulls has no row; null keys are a group like others. The values must
    lie within 2 ** 63 of each other.
    """
    if not keys:
        return grouped_quantile(rows.withColumn("_all", F.lit(1)), ["_all"], value, part).drop("_all")
    counts = written(rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("bigint").alias("_v")).agg(F.count(F.lit(1)).alias("_n")), "value-counts")
    low, high = counts.agg(F.min("_v"), F.max("_v")).first()
    state = counts.groupBy(*keys).agg(F.sum("_n").alias("_n")).select(
        *keys, F.lit(low).cast("bigint").alias("_low"), F.floor(F.col("_n") * part[0] / F.lit(part[1])).cast("bigint").alias("_rank"))
    if low is not None:
        for k in range(-(-max(1, (high - low).bit_length()) // DIGIT) - 1, -1, -1):
            state = written(_narrowed(counts, state, keys, k * DIGIT), "value-ranges")
    return state.select(*keys, F.col("_low").alias(value))


def _narrowed(counts: DataFrame, state: DataFrame, keys: list[str], shift: int) -> DataFrame:
    named = state.withColumnsRenamed({k: f"_g{i}" for i, k in enumerate(keys)})
    same = [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)]
    left = counts.join(named, same)
    digit = F.expr(f"shiftright(_v - _low, {shift})")
    hist = left.where((F.col("_v") >= F.col("_low")) & (digit < 1 << DIGIT)).groupBy(*keys, "_low", "_rank", digit.alias("_d")).agg(F.sum("_n").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_d").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hit = hist.withColumn("_upto", upto).where((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_n") <= F.col("_rank")))
    return hit.select(*keys, (F.col("_low") + F.expr(f"shiftleft(_d, {shift})")).alias("_low"), (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank"))


def token_medians(log: DataFrame) -> DataFrame:
    """The upper median of tokens per tool and UTC day."""
    rows = billable(log).select(F.coalesce("tool", F.lit("unknown")).alias("tool"), day_of(F.col("ts")).alias("day"), "tokens_used")
    return grouped_quantile(rows, ["tool", "day"], "tokens_used").withColumnRenamed("tokens_used", "median_tokens")


def stream_token_quantiles(log: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Per tool and UTC day of a stream, final once the watermark has passed it: tasks, and the median and the 95th
    percentile of tokens from a KLL sketch, whose ranks are right to about 1.3 percent."""
    days = billable(log).withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), F.coalesce("tool", F.lit("unknown")).alias("tool")).agg(
        F.count(F.lit(1)).alias("tasks"), F.kll_sketch_agg_bigint("tokens_used").alias("_kll"))
    at = lambda q: F.kll_sketch_get_quantile_bigint("_kll", F.lit(q))
    return days.select("tool", day_of(F.col("window.start")).alias("day"), "tasks", at(0.5).alias("median_tokens"), at(0.95).alias("p95_tokens"))
