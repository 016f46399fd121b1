"""Connected components by rounds of Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirworks.sources.workdir import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b): the smallest node that links reach.

    Stars are drawn again and again: each node's larger neighbours move to its smallest neighbour, then each node's
    neighbours that are not larger do, until every component is one star. Each round is a written table; a node with
    many neighbours sends one smallest value, so nothing but its own rows meets it.
    """
    state = written(edges.where("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct(), "links")
    while True:
        both = state.unionByName(state.select(F.col("high").alias("low"), F.col("low").alias("high")))
        # stored, so that the skew join can split a node with very many neighbours
        least = written(both.groupBy("low").agg(F.min("high").alias("near")).select("low", F.least("low", "near").alias("to")), "links-least")
        large = both.where("high > low").join(least, "low").select(F.col("to").alias("low"), "high")
        large = written(large.where("low <> high").distinct(), "links-large")
        # small star: each node's smaller neighbours, and the node itself, move to the smallest of them
        down = large.groupBy("high").agg(F.min("low").alias("to"))
        moved = large.join(down, "high").select(F.col("to").alias("a"), F.col("low").alias("b")).unionByName(down.select(F.col("to").alias("a"), F.col("high").alias("b")))
        after = written(moved.where("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct(), "links")
        if _mark(state) == _mark(after):
            break
        state = after
    pairs = after.select(F.col("high").alias("node"), F.col("low").alias("component"))
    return pairs.unionByName(after.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """What tells two sets of edges apart: their number, and two sums over hashes."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("low", "high")), F.sum(F.hash("low", "high").cast("long"))).first())
