"""One row for each task: its prompt, its completion and its log row, over tables or streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANSWER_WITHIN = "30 minutes"
LOG_WITHIN = "10 minutes"


def _timed(df: DataFrame, at: str, delay: str | None, key: str, name: str) -> DataFrame:
    """The side's columns under names of their own; on a stream rows are late beyond the delay."""
    own = df.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumnRenamed(key, name)
    return own.withWatermark(at, delay) if delay else own


def task_join(prompts: DataFrame, completions: DataFrame, log: DataFrame, key: str = "task_id", asked: str = "asked_at",
              answered: str = "answered_at", logged: str = "logged_at", answer_within: str = ANSWER_WITHIN,
              log_within: str = LOG_WITHIN, delay: str = "1 hour") -> DataFrame:
    """Each prompt with the completions that follow it in time, and each completion with the log rows that follow it.

    ``task_state`` says ``logged``, ``unlogged`` (a completion that no log row followed in time), ``unanswered`` (a
    prompt that no completion followed in time) or ``unprompted`` (a completion whose prompt is missing or too old).
    A row without a key or a time can meet nothing and is left out. Besides the key, the three sides' columns must
    have different names.

    Over streams the same joins keep state until the watermark has passed what could still match: a match comes out at
    once, an unmatched row when its time is over, and what arrives later than ``delay`` counts as missing. So after the
    watermark a stream has given what the batch join gives. Completions meet log rows first: both sides of the outer
    joins then always have a time, without which a row would stay in the state for good.
    """
    streaming = prompts.isStreaming or completions.isStreaming or log.isStreaming
    wait = delay if streaming else None
    p, c, u = (_timed(df, at, wait, key, name) for df, at, name in (
        (prompts, asked, "_p"), (completions, answered, "_c"), (log, logged, "_u")))
    after = lambda late, early, within: (F.col(late) >= F.col(early)) & (F.col(late) <= F.col(early) + F.expr(f"INTERVAL {within}"))
    told = c.join(u, (F.col("_u") == F.col("_c")) & after(logged, answered, log_within), "left")
    # a side of a stream join has one time with a watermark: the log's time goes on as a plain value
    told = told.withColumn(logged, F.timestamp_micros(F.unix_micros(logged)))
    whole = p.join(told, (F.col("_p") == F.col("_c")) & after(answered, asked, answer_within), "full")
    state = (F.when(F.col("_c").isNull(), "unanswered").when(F.col("_p").isNull(), "unprompted")
             .when(F.col("_u").isNull(), "unlogged").otherwise("logged"))
    return whole.select(F.coalesce("_p", "_c").alias(key), state.alias("task_state"),
                        *[c for c in whole.columns if c not in ("_p", "_c", "_u")])


def task_rows(prompts: DataFrame, completions: DataFrame, log: DataFrame, key: str = "task_id") -> DataFrame:
    """Each prompt with its completions and, where there are any, their log rows, by key alone.

    The three sides' other columns must have different names; select what is needed first, so that texts stay behind.
    Rows without a key meet nothing: prompts and completions without one are left out.
    """
    return prompts.join(completions, key).join(log, key, "left")
