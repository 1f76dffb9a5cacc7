"""Explode for arrays that are expensive to compute."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def explode_rows(df: DataFrame, array: str, position: str, value: str) -> DataFrame:
    """One row per element of a computed array, with its 0-based position.

    A plain explode makes the optimizer push a "not empty" test down to the scan, which
    spells out the whole computation of the array again, several times over.  The outer
    form has no such test; the row it adds for an empty array is dropped afterwards.
    """
    others = [c for c in df.columns if c != array]
    return df.select(*others, F.posexplode_outer(array).alias(position, value)).where(
        F.col(position).isNotNull()
    )
