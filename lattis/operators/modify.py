"""UPDATE and DELETE as transformations of a table's rows, and the check for duplicate keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattis.functions.arithmetic import assigned
from lattis.types import SqlType


@dataclass(frozen=True)
class Change:
    """SET column = value | source | source op value."""

    column: str
    type: SqlType
    source: str | None = None
    source_type: SqlType | None = None
    op: str | None = None
    value: object = None

    def column_(self) -> Column:
        return assigned(self)


def update_rows(df: DataFrame, where: Column, changes: list[Change]) -> DataFrame:
    """All rows; those for which where holds with their new values. Every new value is made from the old row."""
    new = {c.column: F.when(where, c.column_()).otherwise(F.col(c.column)) for c in changes}
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def delete_rows(df: DataFrame, where: Column) -> DataFrame:
    return df.filter(~where)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has: a unique index over keys can stand if there is none."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
