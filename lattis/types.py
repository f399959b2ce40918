"""The dialect's column types and literals, and what they are in Spark."""

from __future__ import annotations

import struct
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattis.errors import IncompatibleType, StringTooLong


@dataclass(frozen=True)
class SqlType:
    """kind is INT, FLOAT or CHAR; length is in bytes and counts for CHAR only. DataFrames also have BIGINT, DOUBLE, DATETIME
    (without a zone), TIMESTAMP, DATE, and OPAQUE for columns that can only be selected."""

    kind: str
    length: int = 4

    @property
    def spark(self) -> T.DataType:
        return {"INT": T.IntegerType(), "FLOAT": T.FloatType(), "CHAR": T.StringType(), "BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "DATETIME": T.TimestampNTZType(), "TIMESTAMP": T.TimestampType(), "DATE": T.DateType()}[self.kind]

    @property
    def numeric(self) -> bool:
        return self.kind in ("INT", "BIGINT", "FLOAT", "DOUBLE")

    @property
    def zero(self):
        """What an aggregate over no rows gives; null where the dialect itself has no such type."""
        return {"INT": 0, "BIGINT": 0, "FLOAT": 0.0, "DOUBLE": 0.0, "CHAR": ""}.get(self.kind)

    def shown(self) -> str:
        return "STRING" if self.kind == "CHAR" else self.kind


INT, FLOAT = SqlType("INT"), SqlType("FLOAT")
BIGINT, DOUBLE = SqlType("BIGINT", 8), SqlType("DOUBLE", 8)


@dataclass(frozen=True)
class Lit:
    value: object
    kind: str  # INT, FLOAT, CHAR or BOOL


def float32(value) -> float:
    """The 32-bit number next to value: what a FLOAT column holds, compares and keeps unique."""
    try:
        return struct.unpack("f", struct.pack("f", value))[0]
    except OverflowError:
        raise IncompatibleType(f"{value} is out of FLOAT's range") from None


def coerce(lit: Lit, to: SqlType):
    """A literal's value for a column: INT goes to FLOAT, FLOAT is rounded to 32 bits, other mismatches and strings over
    the length are errors."""
    if lit.kind == "CHAR" and to.kind == "CHAR":
        if len(str(lit.value).encode()) > to.length:
            raise StringTooLong(f"'{lit.value}' is longer than {to.length} bytes")
        return lit.value
    if lit.kind == "INT" and to.kind in ("INT", "BIGINT"):
        return lit.value
    if lit.kind in ("INT", "FLOAT") and to.kind in ("FLOAT", "DOUBLE"):
        return float32(lit.value) if to.kind == "FLOAT" else float(lit.value)
    if lit.kind == "CHAR" and to.kind in ("DATETIME", "TIMESTAMP", "DATE"):
        try:
            datetime.fromisoformat(str(lit.value))
        except ValueError:
            raise IncompatibleType(f"'{lit.value}' is no date") from None
        return lit.value
    raise IncompatibleType(f"{lit.kind} for {to.kind}")


def literal(value, kind: SqlType) -> Column:
    """A literal of the column's own type, so that a FLOAT column is compared in 32 bits."""
    return F.lit(value).cast(kind.spark)


def comparable(a: SqlType, b: SqlType) -> bool:
    return a.kind == b.kind != "OPAQUE"


def unify(a: SqlType, b: SqlType) -> SqlType:
    """The type of a UNION's column."""
    if a.kind == b.kind:
        return a if a.length >= b.length else b
    order = ["INT", "BIGINT", "FLOAT", "DOUBLE"]
    if a.numeric and b.numeric:
        return a if order.index(a.kind) > order.index(b.kind) else b
    raise IncompatibleType(f"UNION of {a.kind} and {b.kind}")
