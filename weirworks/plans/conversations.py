"""Route, gate and price each user turn and its answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import cost as C
from ..functions.text import estimate_tokens
from ..operators.gate import quality_gate
from ..operators.routing import DECISION, route
from ..operators.usage import route_mix

TURNS = 10_000


def pair_turns(conversations: DataFrame) -> DataFrame:
    """Each user turn with the next turn there is, when that is the assistant's; turn numbers may have gaps.

    The order comes from slim columns, and texts join by (conversation, turn). A conversation is ordered in ranges of
    ``TURNS`` turn numbers, so one with very many turns is no group of its own: what follows the last turn of a range is
    the first turn of the next range that has any. Turns without a conv_id are one conversation.
    """
    slim = conversations.select("conv_id", "turn", "role").withColumn("_part", F.floor(F.col("turn") / TURNS))
    inside = Window.partitionBy("conv_id", "_part").orderBy("turn")
    first = slim.groupBy("conv_id", "_part").agg(F.min(F.struct("turn", "role")).alias("_first"))
    after = first.select("conv_id", "_part", F.lead("_first").over(Window.partitionBy("conv_id").orderBy("_part")).alias("_after"))
    asked = slim.withColumn("_next", F.lead(F.struct("turn", "role")).over(inside)).where("role = 'user'")
    asked = _same(asked, after, ["conv_id", "_part"]).withColumn("_next", F.coalesce("_next", "_after")).where("_next.role = 'assistant'")
    pairs = asked.select("conv_id", "turn", F.col("_next.turn").alias("_answer"))
    texts = conversations.select("conv_id", "turn", "text")
    out = _same(pairs, texts.withColumnRenamed("text", "prompt"), ["conv_id", "turn"])
    told = texts.select("conv_id", F.col("turn").alias("_answer"), F.col("text").alias("response"))
    return _same(out, told, ["conv_id", "_answer"]).select("conv_id", "turn", "prompt", "response")


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An equi-join in which null keys are equal, too."""
    named = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    return left.join(named, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]).drop(*(f"_r_{k}" for k in keys))


def judged_pairs(conversations: DataFrame, level: int = dims.DEFAULT_LEVEL,
                 options: dims.GateOptions = dims.GateOptions()) -> DataFrame:
    """Routing decision, gate verdict, tokens and overhead of every answered user turn."""
    pairs = pair_turns(conversations)
    routed = route(pairs, level, text="prompt")
    gated = quality_gate(routed, options)
    tokens = estimate_tokens(F.col("response"))
    return gated.withColumn("tokens", tokens).withColumn("overhead", C.cloud_overhead(F.col("tokens"))).select(
        "conv_id", "turn", *DECISION_COLUMNS, "severity", "accepted", "should_retry", "should_escalate",
        "checks_passed", "checks_total", "tokens", "overhead")


DECISION_COLUMNS = ["cost_of_wrong" if c == "decision_cost_of_wrong" else c for c in DECISION]


def conversation_report(conversations: DataFrame, level: int = dims.DEFAULT_LEVEL, rate: float = dims.DEFAULT_RATE,
                        options: dims.GateOptions = dims.GateOptions()) -> DataFrame:
    """Per route: answered turns, gate outcomes, tokens, overhead and net cost."""
    judged = judged_pairs(conversations, level, options)
    n = lambda flag: F.count(F.when(flag, 1))
    sums = judged.groupBy("route").agg(
        F.count(F.lit(1)).alias("pairs"), n(F.col("accepted")).alias("accepted"), n(F.col("should_retry")).alias("to_retry"),
        n(F.col("should_escalate")).alias("to_escalate"), F.sum("tokens").alias("tokens"),
        F.sum("overhead").alias("overhead"))
    net = C.gross(F.col("tokens"), F.lit(float(rate))) - C.overhead_cost(F.col("overhead"), F.lit(float(rate)))
    return sums.withColumn("net_cost", C.round2(net))


def conversation_mix(conversations: DataFrame, level: int = dims.DEFAULT_LEVEL) -> DataFrame:
    """Local share and delegation rate over all answered turns."""
    return route_mix(route(pair_turns(conversations), level, text="prompt"), ["delegation_level"])
