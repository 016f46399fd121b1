"""Equi-joins whose null keys stay spread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NULL_SALTS = 4096
BROADCAST_ROWS = 100_000


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Count at most ``max_rows`` + 1 rows to decide whether a side may be broadcast."""
    return df.limit(max_rows + 1).count() <= max_rows


def lookup(left: DataFrame, right: DataFrame, key: str, spread_by: str) -> DataFrame:
    """Left join to a ``right`` that is unique by ``key``; both sides are read once and no job runs meanwhile.

    Rows without a key match nothing, so a hash of ``spread_by`` (stable when a task is run again) deals them to many
    partitions. A frequent key is left to the adaptive skew join, which splits its left rows, or to a broadcast of a
    right side whose size has been seen.
    """
    salt = lambda free: F.when(F.col(key).isNull(), free).otherwise(F.lit(-1)).cast("bigint")
    spread = left.withColumn("_salt", salt(F.pmod(F.xxhash64(spread_by), F.lit(NULL_SALTS))))
    return spread.join(right.withColumn("_salt", salt(F.lit(-2))), [key, "_salt"], "left").drop("_salt")
