"""Names and types: what a statement may refer to, and what it may compare, group and order by."""

from __future__ import annotations

from dataclasses import dataclass

from lattis.errors import AmbiguousColumn, ColumnNotFound, EngineError, IncompatibleType
from lattis.plans.dialect import Agg, Col, Cond
from lattis.types import BIGINT, DOUBLE, Lit, SqlType, coerce, comparable, float32


@dataclass
class Source:
    """A table of a FROM clause: its visible name, its base table, its columns, and their names in the plan."""

    alias: str
    table: str
    columns: dict[str, SqlType]
    prefix: str

    def internal(self, column: str) -> str:
        return f"{self.prefix}_{column}"


class Scope:
    def __init__(self, sources: list[Source]):
        names = [s.alias for s in sources]
        if len(set(names)) < len(names):
            raise AmbiguousColumn(f"a table name is used twice: {names}")
        self.sources = sources

    def find(self, col: Col) -> tuple[Source, SqlType]:
        hits = [s for s in self.sources if (col.table is None or s.alias == col.table) and col.name in s.columns]
        if not hits:
            raise ColumnNotFound(str(col))
        if len(hits) > 1:
            raise AmbiguousColumn(str(col))
        return hits[0], hits[0].columns[col.name]

    def qualify(self, col: Col) -> Col:
        return Col(self.find(col)[0].alias, col.name)

    def condition(self, c: Cond) -> Cond:
        """c with qualified columns and its literal in the column's type; an error if its sides don't fit."""
        _, kind = self.find(c.left)
        if isinstance(c.right, Lit):
            return Cond(self.qualify(c.left), c.op, Lit(coerce(c.right, kind), c.right.kind))
        _, other = self.find(c.right)
        if not comparable(kind, other):
            raise IncompatibleType(f"{c.left} and {c.right}")
        return Cond(self.qualify(c.left), c.op, self.qualify(c.right))

    def aggregate(self, agg: Agg) -> SqlType:
        """The type of an aggregate's result."""
        if agg.col is None:
            return BIGINT
        _, kind = self.find(agg.col)
        if agg.func in ("SUM", "AVG") and not kind.numeric:
            raise IncompatibleType(f"{agg.func} of {kind.kind}")
        return {"COUNT": BIGINT, "AVG": DOUBLE, "SUM": BIGINT if kind.kind in ("INT", "BIGINT") else DOUBLE}.get(agg.func, kind)


def having_value(lit: Lit, kind: SqlType):
    """HAVING compares INT and FLOAT with each other; MIN and MAX of a FLOAT are 32-bit numbers, as it is."""
    if kind.numeric and lit.kind in ("INT", "FLOAT"):
        return float32(lit.value) if kind.kind == "FLOAT" else lit.value
    return coerce(lit, kind)


def grouped(items, group: list[Col], scope: Scope) -> None:
    keys = {scope.qualify(g) for g in group}
    for item in items:
        if isinstance(item.value, Col) and scope.qualify(item.value) not in keys:
            raise EngineError(f"{item.value} is neither grouped nor aggregated")
