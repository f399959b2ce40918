"""Filters, projections, sorting and limits."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COMPARE = {
    "=": Column.__eq__,
    "<>": Column.__ne__,
    "<": Column.__lt__,
    ">": Column.__gt__,
    "<=": Column.__le__,
    ">=": Column.__ge__,
}


def compare(left: Column, op: str, right: Column) -> Column:
    return _COMPARE[op](left, right)


def conjunction(conditions: list[Column]) -> Column:
    return reduce(and_, conditions) if conditions else F.lit(True)


def filter_rows(df: DataFrame, conditions: list[Column]) -> DataFrame:
    """Rows for which all conditions hold; they reach the scan as pushed filters."""
    return df.filter(conjunction(conditions)) if conditions else df


def project(df: DataFrame, columns: list) -> DataFrame:
    return df.select(*columns)


def _keys(order: list[tuple[str, bool]]) -> list[Column]:
    return [F.col(f"`{c}`").desc() if down else F.col(f"`{c}`").asc() for c, down in order]


def order_by(df: DataFrame, order: list[tuple[str, bool]]) -> DataFrame:
    """order: (column, True for descending). Strings go by their bytes."""
    return df.orderBy(*_keys(order)) if order else df


def limit(df: DataFrame, n: int | None) -> DataFrame:
    return df if n is None else df.limit(n)


def top_k(df: DataFrame, order: list[tuple[str, bool]], k: int) -> DataFrame:
    """A sort with a limit right on it: Spark keeps k rows a task (TakeOrderedAndProject)."""
    return df.orderBy(*_keys(order)).limit(k)
