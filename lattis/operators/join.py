"""Joins. Spark picks the algorithm by the sides' sizes; hint names one ("MERGE", "SHUFFLE_HASH", "BROADCAST")."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: The largest side, by the optimizer's estimate, that a BROADCAST hint holds for; larger ones are joined as Spark sees fit.
BROADCAST_BYTES = 64 << 20


def hinted(df: DataFrame, hint: str | None) -> DataFrame:
    if hint == "BROADCAST" and int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > BROADCAST_BYTES:
        return df
    return df.hint(hint) if hint else df


def cross_join(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.crossJoin(right)


def equi_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], residual: Column | None = None, hint: str | None = None) -> DataFrame:
    """Inner join on pairs of column names, and a condition that isn't an equality."""
    on = None
    for a, b in keys:
        one = F.col(a) == F.col(b)
        on = one if on is None else on & one
    if residual is not None:
        on = residual if on is None else on & residual
    return left.join(hinted(right, hint), on, "inner")


def theta_join(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Inner join on any condition. Without an equality Spark compares all pairs, broadcasting a side if it is small."""
    return left.join(right, on, "inner")


def semi_join(left: DataFrame, right: DataFrame, on: Column, hint: str | None = None) -> DataFrame:
    """Rows of left that have a partner; left's columns only."""
    return left.join(hinted(right, hint), on, "left_semi")
