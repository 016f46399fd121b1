"""Bounded samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo the number of folds."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds))


def bounded(rows: DataFrame, label: str, key: str, per_label: int, seed: int = 11) -> DataFrame:
    """About ``per_label`` rows of each label at most, chosen by a hash of the key: the same rows in every run.

    ``__weight`` says how many rows of its label each one stands for. Only the count of each label is collected.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    rate = F.lit(None).cast("double")
    for value, n in counts.items():
        rate = F.when(F.col(label).eqNullSafe(F.lit(value)), F.lit(min(1.0, per_label / n))).otherwise(rate)
    drawn = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.withColumn("__rate", rate).where(drawn < F.col("__rate")).withColumn("__weight", F.lit(1.0) / F.col("__rate")).drop("__rate")
