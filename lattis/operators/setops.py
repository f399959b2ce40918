"""UNION."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattis.errors import ValueCountMismatch
from lattis.types import SqlType, unify


def union_distinct(branches: list[tuple[DataFrame, list[SqlType]]]) -> tuple[DataFrame, list[SqlType]]:
    """The distinct rows of all branches, under the first one's names. INT goes to FLOAT where a branch has FLOAT and
    CHAR lengths to the longest; other mixes and differing numbers of columns are errors (Spark itself would take
    INT with CHAR). Duplicates go before the shuffle as well as after it."""
    first, types = branches[0]
    for _, more in branches[1:]:
        if len(more) != len(types):
            raise ValueCountMismatch("UNION of different numbers of columns")
        types = [unify(a, b) for a, b in zip(types, more, strict=True)]
    out = None
    for df, _ in branches:
        cast = df.select(*[F.col(f"`{c}`").cast(t.spark).alias(n) for c, t, n in zip(df.columns, types, first.columns, strict=True)])
        out = cast if out is None else out.union(cast)
    return out.distinct(), types
