"""Extensions beyond the dialect, each Spark's own operator: outer and anti joins, DISTINCT, cubes, windows, EXCEPT and
INTERSECT. The dialect has none of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def outer_join(left: DataFrame, right: DataFrame, on: Column, how: str = "left") -> DataFrame:
    """how: left, right or full."""
    return left.join(right, on, how)


def anti_join(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    return left.join(right, on, "left_anti")


def count_distinct(df: DataFrame, keys: list[str], column: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.countDistinct(column).alias(name))


def rank_within(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def rollup_counts(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    return df.rollup(*keys).agg(F.count(F.lit(1)).alias(name))
