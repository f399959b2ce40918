"""The DataFrame front door: the dialect's checks and operators over any DataFrames, with their own types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattis.plans import dialect as d
from lattis.plans.build import Builder, Query
from lattis.plans.explain import explain
from lattis.types import BIGINT, DOUBLE, FLOAT, INT, SqlType

_KINDS = {"int": INT, "bigint": BIGINT, "float": FLOAT, "double": DOUBLE, "string": SqlType("CHAR", 1 << 30), "timestamp_ntz": SqlType("DATETIME", 8), "timestamp": SqlType("TIMESTAMP", 8), "date": SqlType("DATE")}


class Frames:
    """Tables by name. Timestamps and dates compare with strings; columns of other types that the dialect has no word for (arrays,
    decimals) can be selected, and no more than that."""

    def __init__(self, tables: dict[str, DataFrame], hint: str | None = None, indexes: dict[str, list[list[str]]] | None = None):
        self.tables, self.hint, self.indexes = tables, hint, indexes or {}

    @staticmethod
    def read(spark: SparkSession, folder: str, *names: str, **how) -> Frames:
        return Frames({n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}, **how)

    def columns(self, table: str) -> dict[str, SqlType]:
        from lattis.errors import TableNotFound

        if table not in self.tables:
            raise TableNotFound(table)
        return {c: _KINDS.get(t, SqlType("OPAQUE")) for c, t in self.tables[table].dtypes}

    def rows(self, table: str) -> DataFrame:
        return self.tables[table]

    def query(self, text: str) -> Query:
        q = d.parse(text)
        if not isinstance(q, d.Select):
            raise d.SyntaxFault("only queries run on frames")
        return Builder(self, self.hint).select(q)

    def sql(self, text: str) -> DataFrame:
        """A SELECT of the dialect as a DataFrame."""
        return self.query(text).named()

    def explain(self, text: str) -> list[str]:
        q = d.parse(text)
        return explain(q.query if isinstance(q, d.Explain) else q, Builder(self, self.hint), lambda t: self.indexes.get(t, []))
