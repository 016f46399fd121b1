"""Token overhead and price expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims


def round2(x: Column) -> Column:
    """Two decimals, half toward plus infinity."""
    return F.floor(x * F.lit(100.0) + F.lit(0.5)) / F.lit(100.0)


def cloud_overhead(tokens: Column) -> Column:
    return F.lit(dims.CALL_OVERHEAD) + F.ceil(tokens * F.lit(dims.RESULT_FACTOR)).cast("bigint")


def overhead_of(recorded: Column, tokens: Column) -> Column:
    """The recorded overhead, else the estimate."""
    return F.coalesce(recorded, cloud_overhead(tokens))


def gross(tokens: Column, rate: Column) -> Column:
    return tokens / F.lit(1e6) * rate


def overhead_cost(overhead: Column, rate: Column) -> Column:
    return overhead / F.lit(1e6) * (rate / F.lit(float(dims.INPUT_PRICE_DIVISOR)))


def breaks_even(tokens: Column, rate: Column) -> Column:
    return gross(tokens, rate) - overhead_cost(cloud_overhead(tokens), rate) > 0


def two_price_cost(tokens_in: Column, tokens_out: Column, rate_in: float, rate_out: float) -> Column:
    return (tokens_in * F.lit(rate_in) + tokens_out * F.lit(rate_out)) / F.lit(1e6)


def price_rate(model_id: Column, default: float = dims.DEFAULT_RATE) -> Column:
    """Output price per million tokens of the tier named in a model id."""
    lowered = F.lower(F.coalesce(model_id, F.lit("")))
    (name, rate), *rest = dims.PRICE_TIERS
    out = F.when(F.contains(lowered, F.lit(name)), rate)
    for name, rate in rest:
        out = out.when(F.contains(lowered, F.lit(name)), rate)
    return out.otherwise(F.lit(default))
