"""Learn from history: success per task type and level, and expected output size per tool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import signals as S
from ..functions.text import to_fixed
from .joins import fits_broadcast, lookup


def success_cells(history: DataFrame) -> DataFrame:
    """Samples and successes per task type and level."""
    return history.groupBy("task_type", "level_used").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("outcome") == "success", 1)).alias("successes"))


def advise(cells: DataFrame, total: Column, options: dims.LearnerOptions = dims.LearnerOptions()) -> DataFrame:
    """Turn success counts into level and confidence advice, with the guard that held it back if any."""
    n, level = F.col("n"), F.col("level_used")
    per_type = F.sum("n").over(Window.partitionBy("task_type"))
    staged = cells.withColumns({"type_samples": per_type, "total_samples": total})
    enough = ((F.col("total_samples") >= options.min_records) & (F.col("type_samples") >= options.min_type)
              & (n >= options.min_cell))
    staged = staged.withColumns({"_enough": enough, "success_rate": F.when(enough, F.col("successes") / n)})
    rate = F.col("success_rate")
    text = lambda c: c.cast("string")
    reason = (F.when(F.col("total_samples") < options.min_records, F.concat(
                  F.lit(dims.TOO_FEW), text(F.col("total_samples")), F.lit(f"/{options.min_records} records)")))
              .when(F.col("type_samples") < options.min_type, F.concat(
                  F.lit(dims.TOO_FEW_OF_TYPE), F.col("task_type"), F.lit('"')))
              .when(n < options.min_cell, F.concat(F.lit(dims.TOO_FEW_AT_LEVEL), text(level)))
              .otherwise(F.concat(F.col("task_type"), F.lit(dims.AT_LEVEL), text(level), F.lit(": "),
                                  to_fixed(rate * F.lit(100.0), 0), F.lit(dims.SUCCESS), text(n), F.lit(dims.SAMPLES))))
    samples = (F.when(F.col("total_samples") < options.min_records, F.col("total_samples"))
               .when(F.col("type_samples") < options.min_type, F.col("type_samples")).otherwise(n))
    return staged.select(
        "task_type", "level_used", "n", "success_rate",
        F.when(rate.isNotNull() & (rate > 0.85) & (level > 1), level - 1)
        .when(rate.isNotNull() & (rate < 0.5) & (level < 5), level + 1).alias("adjusted_level"),
        F.coalesce((rate - F.lit(0.5)) * F.lit(0.4), F.lit(0.0)).alias("confidence_adjustment"),
        reason.alias("reason"), samples.alias("sample_size"))


def learner(history: DataFrame, options: dims.LearnerOptions = dims.LearnerOptions()) -> DataFrame:
    """Advice per (task type, level) seen in the history."""
    cells = success_cells(history)
    return advise(cells, cells.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar(), options)


def routing_advice(history: DataFrame, options: dims.LearnerOptions = dims.LearnerOptions()) -> DataFrame:
    """Advice for every pair that scoring can produce, seen or not: 5 output types x 6 levels."""
    cells = success_cells(history)
    types = [name for name, _ in S.OUTPUT_TYPE] + ["code_gen"]
    pairs = F.array(*[F.struct(F.lit(t).alias("task_type"), F.lit(level).alias("level_used"))
                      for t in types for level in range(1, 7)])
    grid = history.sparkSession.range(1).select(F.inline(pairs))
    every = grid.join(cells, ["task_type", "level_used"], "left").fillna(0, ["n", "successes"])
    return advise(every, cells.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar(), options)


def output_history(log: DataFrame) -> DataFrame:
    """Mean recorded output per tool where at least three completions and three sizes exist."""
    size = F.coalesce("output_tokens", "tokens_used")
    known = log.where((F.col("type") == "completion") & F.col("tool").isNotNull()).groupBy("tool").agg(
        F.count(F.lit(1)).alias("_rows"), F.count(F.when(size > 0, 1)).alias("sample_size"),
        F.sum(F.when(size > 0, size)).alias("_sum"))
    known = known.where((F.col("_rows") >= 3) & (F.col("sample_size") >= 3))
    return known.select("tool", "sample_size", F.ceil(F.col("_sum") / F.col("sample_size") * F.lit(1.25))
                        .cast("bigint").alias("_mean_tokens"))


def baseline(tool: Column, level: Column) -> Column:
    """Expected output of a tool at a level; unknown tools use the general row, levels are clamped to 1..6."""
    at = F.greatest(F.lit(1), F.least(F.lit(6), level.cast("int")))
    row = lambda name: F.try_element_at(F.array(*[F.lit(v) for v in dims.BASELINES[name].values()]), at)
    out = None
    for name in dims.BASELINES:
        out = F.when(tool == name, row(name)) if out is None else out.when(tool == name, row(name))
    return out.otherwise(row(dims.FALLBACK_TOOL))


def output_estimate(requests: DataFrame, log: DataFrame, tool: str = "tool", level: str = "task_complexity",
                    key: str = "task_id") -> DataFrame:
    """Expected output tokens per request: the tool's recorded mean plus a quarter, else its baseline.

    Few tools have very many requests each, so a short list of tools is broadcast.
    """
    past = output_history(log).withColumnRenamed("tool", tool)
    out = requests.join(F.broadcast(past), tool, "left") if fits_broadcast(past) else lookup(requests, past, tool, spread_by=key)
    guess = F.ceil(baseline(F.col(tool), F.col(level)) * F.lit(1.25)).cast("bigint")
    seen = F.col("_mean_tokens").isNotNull()
    return out.withColumns({
        "estimated_tokens": F.coalesce("_mean_tokens", guess),
        "estimate_source": F.when(seen, "historical").otherwise("heuristic"),
        "estimate_confidence": F.when(seen, F.least(F.lit(0.9), F.lit(0.5) + F.col("sample_size") * F.lit(0.05)))
                                .otherwise(0.4),
        "sample_size": F.coalesce("sample_size", F.lit(0)),
    }).drop("_mean_tokens")
