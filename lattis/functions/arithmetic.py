"""The arithmetic of UPDATE ... SET."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def assigned(change) -> Column:
    """The new value of an operators.Change, in its column's type.

    INT: + - * raise on overflow, / truncates toward zero. FLOAT works in 32 bits. A zero divisor is an error.
    """
    to = change.type.spark
    if change.source is None:
        return F.lit(change.value).cast(to)
    source = F.col(f"`{change.source}`")
    if change.op is None:
        return source.cast(to)
    if change.source_type.kind in ("INT", "BIGINT") and isinstance(change.value, int):
        value = F.lit(change.value).cast(change.source_type.spark)
        if change.op == "/":
            # ANSI div raises on zero; the result is a BIGINT
            return F.expr(f"`{change.source}` div {change.value}").cast(to)
        return {"+": source + value, "-": source - value, "*": source * value}[change.op].cast(to)
    a, b = source.cast("float"), F.lit(float(change.value)).cast("float")
    out = {"+": a + b, "-": a - b, "*": a * b, "/": a / b}[change.op]
    return out.cast("float").cast(to)
