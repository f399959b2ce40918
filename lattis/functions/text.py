"""How values are written in results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def float_text(col: Column) -> Column:
    """A FLOAT with six digits after the point."""
    return F.format_string("%.6f", col.cast("double"))
