"""Aggregates, grouping, and the order in which groups come out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Aggregate:
    """func over a column (None: COUNT(*)), with its output name and what it gives over no rows."""

    func: str
    column: str | None
    name: str
    zero: object = 0

    def column_(self) -> Column:
        col = F.lit(1) if self.column is None else F.col(f"`{self.column}`")
        return {"COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[self.func](col).alias(self.name)


def global_aggregate(df: DataFrame, aggregates: list[Aggregate]) -> DataFrame:
    """One row, also over no rows: COUNT gives 0 and the others their zero, never null."""
    out = df.agg(*[a.column_() for a in aggregates])
    return out.select(*[F.coalesce(F.col(f"`{a.name}`"), F.lit(a.zero).cast(out.schema[a.name].dataType)).alias(a.name) for a in aggregates])


def group_by(df: DataFrame, keys: list[str], aggregates: list[Aggregate], having: list[tuple[str, str, object]] | None = None) -> DataFrame:
    """Groups with their aggregates; having: (name of an aggregate, comparison, value)."""
    from lattis.operators.relational import compare

    out = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*[a.column_() for a in aggregates])
    for name, op, value in having or []:
        out = out.filter(compare(F.col(f"`{name}`"), op, F.lit(value)))
    return out


def descending(col: Column, kind: str) -> Column:
    """A value that ascends where col descends. A string goes by the complement of its bytes, and an end that comes after
    them all, as a string comes after those that it begins."""
    if kind in ("int", "bigint"):
        return -col.cast("decimal(20,0)")
    if kind in ("float", "double"):
        return -col.cast("double")
    if kind == "string":
        return F.concat(F.translate(F.hex(F.encode(col, "UTF-8")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
    return -F.unix_micros(col.cast("timestamp"))


def group_order(df: DataFrame, order: list[tuple[str, bool]]) -> tuple[Column, bool]:
    """Groups ordered by columns that they aren't grouped by come in the order of their first rows in the sorted input.

    Returns an aggregate by which to order df's groups, and whether descending. A group's first row is its smallest
    sort tuple: min of the tuple if all keys ascend, max if all descend; in a mix, those that descend are turned round.
    """
    down = {d for _, d in order}
    keys = [F.col(f"`{c}`") for c, _ in order]
    if len(down) == 1:
        return (F.max if down == {True} else F.min)(keys[0] if len(keys) == 1 else F.struct(*keys)), down == {True}
    kinds = dict(df.dtypes)
    return F.min(F.struct(*[descending(F.col(f"`{c}`"), kinds[c]) if d else F.col(f"`{c}`") for c, d in order])), False
