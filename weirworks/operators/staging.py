"""Computing dear columns exactly once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later filters use as values instead of repeating their expressions.

    The optimizer moves a filter below a projection by writing the projected expressions into it again, which
    would run every regex several times.  It does not do so below a one-row generator, while filters on the
    input's own columns still pass it and reach the scan.
    """
    kept = [F.col(c) for c in df.columns if c not in columns]
    made = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    return df.select(*kept, F.inline_outer(made))
