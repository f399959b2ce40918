"""CSV files as rows of a table's types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattis.types import SqlType


def read_csv(spark: SparkSession, path: str, columns: dict[str, SqlType]) -> DataFrame:
    """The rows of a file whose first line is a header, whatever it says. Blank lines are skipped; quotes may hold
    commas. A wrong number of fields, a number that isn't one, an empty number or a string over its column's bytes
    raise when the rows are read; an empty string is an empty string."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns] + [T.StructField("_more", T.StringType())])
    raw = spark.read.csv(path, schema=T.StructType(schema.fields[:-1]), header=True, enforceSchema=True, mode="FAILFAST", escape='"')
    out = []
    for c, t in columns.items():
        text = F.coalesce(F.col(f"`{c}`"), F.lit(""))
        if t.kind == "CHAR":
            fits = F.octet_length(text) <= t.length
            value = F.when(fits, text).otherwise(F.raise_error(F.concat(F.lit(f"too long for {c}: "), text)))
        else:
            value = F.trim(text).cast(t.spark)  # ANSI: raises on text that is no number
        out.append(value.alias(c))
    return raw.select(*out)
