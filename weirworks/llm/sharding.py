"""Balanced label propagation: linked documents move towards their neighbours' shards under capacity quotas.

Documents with the same link key are neighbours. Every document starts on a shard drawn from a hash. In each round a
link key's documents vote for the shard that most of them are on, a histogram of wanted moves (shards x shards) sets
how many may go where without overfilling a shard, and that share of them moves, whole keys together. A key with more
documents than half a shard is cut into parts that propagate apart, so it ends up on few shards instead of blocking all.
At the end each shard's surplus, unlinked documents first, is dealt to the shards with room: row counts differ by at
most one, however the links lie. Only the histogram and the shard counts reach the driver.

Nulls, ties and empty input: a null link key links with nothing; rows that repeat are rows of their own; ties go by
hash; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirworks.sources.workdir import written

BLOCK_ROWS = 20_000  # rows that one task ranks together


def _share(*cols) -> F.Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 20)) / F.lit(float(1 << 20))


def _admitted(wanted: np.ndarray, load: np.ndarray, quota: np.ndarray) -> np.ndarray:
    """The share of wanted moves from shard i to j that may go, so that no shard grows over its quota."""
    go = wanted.astype(float)
    for _ in range(64):
        into = go.sum(0)
        over = load + into - go.sum(1) - np.maximum(quota, load)
        if (over <= 0.5).all():
            break
        go *= np.where(over > 0, np.maximum(0, 1 - over / np.maximum(into, 1e-9)), 1.0)
    return np.divide(go, wanted, out=np.zeros_like(go), where=wanted > 0)


def assign(rows: DataFrame, link: str, shards: int, rounds: int = 8, seed: int = 7) -> DataFrame:
    """``rows`` with columns ``shard`` and ``slot`` (gapless from 0 in each shard); counts differ by at most one.

    ``link`` names the column whose equal values tie rows together. Work columns carry the prefix ``__``.
    """
    spark = rows.sparkSession
    base = written(rows.withColumn("__node", F.monotonically_increasing_id()), "shard-rows")
    total = base.count()
    if not total:
        return base.drop("__node").withColumns({"shard": F.lit(None).cast("int"), "slot": F.lit(None).cast("long")})
    quota = np.array([total // shards + (s < total % shards) for s in range(shards)], float)
    part_rows = max(1, total // shards // 2)
    keys = (base.where(F.col(link).isNotNull()).groupBy(F.col(link).alias("__link")).count().where("count > 1")
            .select("__link", F.ceil(F.col("count") / part_rows).alias("__parts"), F.ceil(F.col("count") / BLOCK_ROWS).alias("__blocks")))
    tied = base.select("__node", F.col(link).alias("__link")).join(keys, "__link", "left")
    start = written(tied.select(
        "__node", F.when(F.col("__parts").isNotNull(), F.xxhash64("__link", F.pmod(F.xxhash64("__node", F.lit(seed)), F.col("__parts")))).alias("__hub"),
        F.coalesce("__blocks", F.lit(1)).alias("__blocks"), F.pmod(F.xxhash64("__node"), F.lit(shards)).cast("int").alias("shard")), "shard-start")
    linked, alone = start.where("__hub IS NOT NULL"), start.where("__hub IS NULL")
    for turn in range(rounds):
        load = np.zeros(shards)
        for r in linked.groupBy("shard").count().collect():                 # at most shards rows
            load[r[0]] = r[1]
        full = [F.lit(bool(x)) for x in load >= quota]
        votes = linked.groupBy("__hub", "shard").count().withColumn("__open", ~F.element_at(F.array(*full), F.col("shard") + 1))
        order = F.struct("count", F.xxhash64("__hub", "shard"))
        want = votes.groupBy("__hub").agg(F.max_by("shard", order).alias("__top"), F.max_by("shard", F.when(F.col("__open"), order)).alias("__spare"))
        # rows on the key's main shard stay; the others go there or, when it is full, to the best shard with room
        top_full = F.element_at(F.array(*full), F.col("__top") + 1)
        want = want.select("__hub", "__top", F.when(top_full, F.col("__spare")).otherwise(F.col("__top")).alias("__want"))
        wished = linked.join(want, "__hub").withColumn("__moves", F.coalesce((F.col("shard") != F.col("__want")) & (F.col("shard") != F.col("__top")), F.lit(False)))
        counted = wished.where("__moves").groupBy("shard", "__want").count().collect()                # at most shards x shards rows
        if not counted:
            break
        moves = np.zeros((shards, shards))
        for r in counted:
            moves[r[0], r[1]] = r[2]
        chance = _admitted(moves, load, quota)
        if (chance * moves).sum() < 1:
            break
        table = F.array(*[F.lit(float(x)) for x in chance.ravel()])
        goes = _share("__hub", F.lit(seed + turn)) < F.element_at(table, F.col("shard") * shards + F.col("__want") + 1)
        linked = written(wished.select("__node", "__hub", "__blocks", F.when(F.col("__moves") & goes, F.col("__want"))
                                       .otherwise(F.col("shard")).alias("shard")), "shard-round")
    state = linked.unionByName(alone)
    placed = _even_out(state, quota.astype(int), total)
    return base.join(placed, "__node").drop("__node")


def _even_out(state: DataFrame, quota: np.ndarray, total: int) -> DataFrame:
    """Rank the rows of each shard, linked ones first, and deal what exceeds the quota to the shards with room."""
    shards = len(quota)
    blocks = -(-total // shards // BLOCK_ROWS)
    kind = F.col("__hub").isNull().cast("int")
    block = F.when(F.col("__hub").isNull(), F.pmod(F.xxhash64("__node", F.lit(1)), F.lit(blocks))).otherwise(
        F.pmod(F.xxhash64("__hub", F.pmod(F.xxhash64("__node", F.lit(2)), F.col("__blocks"))), F.lit(blocks)))
    at = state.withColumns({"__kind": kind, "__block": block})
    place = ["shard", "__kind", "__block"]
    sizes = at.groupBy(*place).count()
    ahead = Window.partitionBy("shard").orderBy("__kind", "__block").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*place, F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("__before"))
    counts = np.zeros(shards, int)
    for r in state.groupBy("shard").count().collect():                      # at most shards rows
        counts[r[0]] = r[1]
    surplus, room = np.maximum(counts - quota, 0), np.maximum(quota - counts, 0)
    first, starts = np.cumsum(surplus) - surplus, np.cumsum(room) - room
    own = Window.partitionBy(*place).orderBy("__hub", "__node")
    ranked = at.withColumn("__own", F.row_number().over(own) - 1).join(before, place)
    look = lambda values, i: F.element_at(F.array(*[F.lit(int(x)) for x in values]), i + 1)
    rank = F.col("__before") + F.col("__own")
    spare = rank - look(quota, F.col("shard")) + look(first, F.col("shard"))
    ranked = ranked.select("__node", "shard", rank.alias("__rank"), F.when(rank >= look(quota, F.col("shard")), spare).alias("__spare"))
    target = F.lit(0)
    for s in range(shards):
        if room[s]:
            target = F.when(F.col("__spare") >= int(starts[s]), F.lit(s)).otherwise(target)
    ranked = ranked.withColumn("__to", F.when(F.col("__spare").isNotNull(), target))
    return ranked.select("__node", F.coalesce("__to", "shard").cast("int").alias("shard"), F.when(
        F.col("__to").isNotNull(), look(counts, F.col("__to")) + F.col("__spare") - look(starts, F.col("__to"))).otherwise(F.col("__rank")).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 40, rounds: int = 8) -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes of the text plus 16), text_crc32, law, shard, slot, grown_shard.

    Equal texts are linked. The law is ``rows``: shard counts differ by at most one, and ``grown_shard`` is null. A
    null text has no bytes (size 16, checksum 0) and is linked with nothing; the empty text is a text like others.
    """
    slim = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
                       F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
                       F.unhex(F.sha2("text", 256)).alias("__text"))
    out = assign(slim, "__text", shards, rounds)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
