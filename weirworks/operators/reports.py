"""Reports on token sizes of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import cost as C
from ..functions.text import to_fixed, tokens_blended
from ..sources.workdir import written
from .routing import classify, decide

DIGIT = 15      # bits that one pass of the median narrows down


def upper_median(counts: DataFrame, value: str) -> int | None:
    """Element n div 2 of the sorted values of a histogram (value, n); values are non-negative integers.

    Each pass counts the values that share the bits found so far by their next ``DIGIT`` bits, so at most 2**DIGIT rows
    reach the driver, however large the values are. The histogram is read once a pass and should be a stored table.
    """
    hist = counts.select(F.col(value).cast("bigint").alias("v"), "n")
    total, top = hist.agg(F.sum("n"), F.max("v")).first()
    if not total:
        return None
    rank, found, shift = total // 2, 0, max(0, -(-top.bit_length() // DIGIT) - 1) * DIGIT
    while shift >= 0:
        same = F.shiftright(F.col("v"), shift + DIGIT) == found if shift + DIGIT < 63 else F.lit(True)
        for high, n in sorted(tuple(r) for r in hist.where(same).groupBy(F.shiftright("v", shift).alias("high")).agg(F.sum("n")).collect()):
            if rank < n:
                found = high
                break
            rank -= n
        shift -= DIGIT
    return found


def token_report(texts: DataFrame, tokens: str = "tokens", estimate: str = "estimate") -> DataFrame:
    """Spread of content tokens and how close an estimate per row came.

    Rows are first combined per token count, map-side; that table is stored, and the spread and the median come from it.
    """
    ratio = F.col(tokens) / F.col(estimate)
    n = lambda flag: F.count(F.when(flag, 1))
    per_count = written(texts.groupBy(F.col(tokens).alias("t")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(ratio).alias("r"), F.min(ratio).alias("low"), F.max(ratio).alias("high"),
        n((ratio >= 0.8) & (ratio <= 1.2)).alias("accurate"), n(ratio < 0.8).alias("over_estimated"),
        n(ratio > 1.2).alias("under_estimated")), "token-counts")
    spread = per_count.agg(
        F.sum("n").alias("n"), (F.sum(F.col("t") * F.col("n")) / F.sum("n")).alias("_avg"), F.min("t").alias("min_tokens"),
        F.max("t").alias("max_tokens"), (F.sum("r") / F.sum("n")).alias("_ratio"), F.min("low").alias("_low"),
        F.max("high").alias("_high"), *[F.sum(c).alias(c) for c in ("accurate", "over_estimated", "under_estimated")])
    return spread.select(
        "n", to_fixed(F.col("_avg"), 0).alias("avg_tokens"), "min_tokens", "max_tokens",
        F.lit(upper_median(per_count, "t")).cast("bigint").alias("median_tokens"), to_fixed(F.col("_ratio"), 2).alias("avg_ratio"),
        to_fixed(F.col("_low"), 2).alias("min_ratio"), to_fixed(F.col("_high"), 2).alias("max_ratio"),
        "accurate", "over_estimated", "under_estimated")


def accuracy_status(ratio: Column) -> Column:
    """Verdict on a ratio already rounded to two decimals; anything against an estimate of 0 (a ratio of null, inf or nan) is under-estimated."""
    return F.when(ratio.between(0.8, 1.2), "ACCURATE").when(ratio < 0.8, "OVER-ESTIMATED").otherwise("UNDER-ESTIMATED")


def two_price_report(texts: DataFrame, tokens_in: str = "tokens_in", tokens_out: str = "tokens_out") -> DataFrame:
    """Cost of each request, fixed prompt overhead included, on a dear and a cheap model."""
    with_prompt = F.col(tokens_in) + dims.PROMPT_OVERHEAD
    out = texts.withColumns({
        "dear_cost": C.two_price_cost(with_prompt, F.col(tokens_out), dims.INPUT_PRICE, dims.OUTPUT_PRICE),
        "cheap_cost": C.two_price_cost(with_prompt, F.col(tokens_out), dims.CHEAP_INPUT_PRICE, dims.CHEAP_OUTPUT_PRICE)})
    return out.withColumn("saving_pct", (F.lit(1.0) - F.col("cheap_cost") / F.col("dear_cost")) * F.lit(100.0))


def compression_report(before: DataFrame, after: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Tokens of two versions of each text, what was saved, and the total in a row with a null key.

    Sizes of both versions are summed by key and rolled up to the total in one shuffle of counts; a key that one side
    lacks has 0 there.
    """
    size, none = tokens_blended(F.col(text)), F.lit(0).cast("bigint")
    both = before.select(key, size.alias("before"), none.alias("after")).unionByName(after.select(key, none.alias("before"), size.alias("after")))
    rolled = both.rollup(key).agg(F.sum("before").alias("before"), F.sum("after").alias("after"))
    rolled = rolled.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("before", "after")})
    saved = F.col("before") - F.col("after")
    pct = F.when(F.col("before") > 0, saved / F.col("before") * F.lit(100.0)).otherwise(0.0)
    return rolled.withColumns({"saved": saved, "pct": F.floor(pct + F.lit(0.5)).cast("bigint")})


def repeat_cost(texts: DataFrame, key: str, turns: list[int], text: str = "text", price: float = 15.0,
                work_days: int = dims.WORK_DAYS) -> DataFrame:
    """Price of sending a text again on every turn, per session and per month."""
    sized = texts.select(key, tokens_blended(F.col(text)).alias("tokens"))
    out = sized.select("*", F.explode(F.array(*[F.lit(t) for t in turns])).alias("turns"))
    out = out.withColumn("extra_tokens", F.col("tokens") * F.col("turns"))
    out = out.withColumn("extra_cost", F.col("extra_tokens") / F.lit(1e6) * F.lit(float(price)))
    return out.withColumn("monthly_cost", F.col("extra_cost") * F.lit(float(work_days)))


def savings_by_level(prompts: DataFrame, tokens: str = "tokens", text: str = "text",
                     levels: tuple[int, ...] = (0, 1, 2, 3, 4)) -> DataFrame:
    """Tokens kept local at each delegation level; prompts are classified once for all levels."""
    slim = classify(prompts, text).select(
        tokens, "rule_ord", "rule_route", "rule_level", "rule_confidence", "rule_cost_of_wrong", "rule_category",
        "matched_phrase", "score", "score_level", "cost_of_wrong", "output_type")
    each = slim.withColumn("level", F.explode(F.array(*[F.lit(n) for n in levels])))
    routed = decide(each, F.col("level"))
    local = F.col("route") == "local"
    return routed.groupBy("level").agg(
        F.coalesce(F.sum(F.when(local, F.col(tokens))), F.lit(0)).alias("local_tokens"),
        F.count(F.when(local, 1)).alias("local_tasks"), F.count(F.lit(1)).alias("tasks"))
