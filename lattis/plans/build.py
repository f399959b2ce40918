"""A checked SELECT as a DataFrame: the only place that puts queries together."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattis.errors import ColumnNotFound, EngineError
from lattis.operators import Aggregate, compare, conjunction, cross_join, filter_rows, global_aggregate, group_order, hinted, limit, order_by, semi_join, theta_join, top_k, union_distinct
from lattis.plans.checks import Scope, Source, grouped, having_value
from lattis.plans.dialect import Agg, Col, Cond, Derived, Item, Ref, Select
from lattis.types import Lit, SqlType, literal


@dataclass
class Query:
    """df's columns are named c0, c1, ..; captions (which may repeat) and types go with them. reads: (table, conditions
    on it alone) of every base table, for predicate locks."""

    df: DataFrame
    captions: list[str]
    types: list[SqlType]
    reads: list[tuple[str, list[Cond]]] = field(default_factory=list)

    def named(self) -> DataFrame:
        """df under its captions, numbered where they repeat."""
        seen: dict[str, int] = {}
        out = []
        for c, name in zip(self.df.columns, self.captions, strict=True):
            seen[name] = seen.get(name, 0) + 1
            out.append(F.col(c).alias(name if seen[name] == 1 else f"{name}_{seen[name]}"))
        return self.df.select(*out)


class Builder:
    """catalog has columns(table) -> {name: SqlType} and rows(table) -> DataFrame with those columns."""

    def __init__(self, catalog, hint: str | None = None):
        self.catalog, self.hint = catalog, hint

    def source(self, ref: Ref, k: int) -> tuple[Source, DataFrame]:
        s = Source(ref.alias, ref.name, self.catalog.columns(ref.name), f"r{k}")
        df = self.catalog.rows(ref.name)
        return s, df.select(*[F.col(f"`{c}`").alias(s.internal(c)) for c in s.columns])

    def column(self, scope: Scope, col: Col) -> Column:
        return F.col(scope.find(col)[0].internal(col.name))

    def predicate(self, scope: Scope, c: Cond) -> Column:
        """c has gone through scope.condition()."""
        left, kind = self.column(scope, c.left), scope.find(c.left)[1]
        right = literal(c.right.value, kind) if isinstance(c.right, Lit) else self.column(scope, c.right)
        return compare(left, c.op, right)

    def derived(self, ref: Derived, k: int) -> tuple[Source, DataFrame, list]:
        parts = [self.select(b) for b in ref.branches]
        names = parts[0].captions
        if len(set(names)) < len(names):
            raise EngineError("a UNION's columns need names of their own")
        frames = [(p.df.toDF(*[f"c{i}" for i in range(len(p.captions))]), p.types) for p in parts]
        df, types = union_distinct(frames)
        s = Source(ref.alias, "", dict(zip(names, types, strict=True)), f"r{k}")
        return s, df.toDF(*[s.internal(n) for n in names]), [r for p in parts for r in p.reads]

    def select(self, q: Select) -> Query:
        sources, frames, reads = [], [], []
        for k, ref in enumerate(q.refs):
            if isinstance(ref, Derived):
                s, df, more = self.derived(ref, k)
                reads += more
            else:
                s, df = self.source(ref, k)
            sources.append(s)
            frames.append(df)
        scope = Scope(sources)
        where = [scope.condition(c) for c in q.where]
        for s in sources:
            if s.table:
                reads.append((s.table, [c for c in where if {x.table for x in (c.left, c.right) if isinstance(x, Col)} == {s.alias}]))
        df = self.join(scope, sources, frames, where)
        if q.semi:
            ref, on = q.semi
            right, rdf = self.source(ref, len(q.refs))
            both = Scope([*sources, right])
            df = semi_join(df, rdf, self.predicate(both, both.condition(on)), self.hint)
            reads.append((right.table, []))
        items = q.items if q.items is not None else [Item(Col(s.alias, c)) for s in sources for c in s.columns]
        if q.group or q.having or any(isinstance(i.value, Agg) for i in items):
            out = self.aggregate(q, items, df, scope)
        else:
            out = self.plain(q, items, df, scope)
        out.reads = reads
        return out

    def join(self, scope: Scope, sources: list[Source], frames: list[DataFrame], where: list[Cond]) -> DataFrame:
        """The frames left to right, each condition at the first join that has its columns; Catalyst pushes and infers
        filters, and picks the sides and algorithms. A frame without a condition is crossed."""
        place = {s.alias: i for i, s in enumerate(sources)}
        step = [[] for _ in frames]
        for c in where:
            step[max(place[x.table] for x in (c.left, c.right) if isinstance(x, Col))].append(c)
        df = filter_rows(frames[0], [self.predicate(scope, c) for c in step[0]])
        for i, right in enumerate(frames[1:], 1):
            across = [self.predicate(scope, c) for c in step[i] if isinstance(c.right, Col) and c.left.table != c.right.table]
            own = [self.predicate(scope, c) for c in step[i] if not (isinstance(c.right, Col) and c.left.table != c.right.table)]
            right = filter_rows(hinted(right, self.hint), own)
            df = theta_join(df, right, conjunction(across)) if across else cross_join(df, right)
        return df

    def plain(self, q: Select, items: list[Item], df: DataFrame, scope: Scope) -> Query:
        named = {i.alias: i.value for i in items if i.alias}
        order = []
        for col, down in q.order:
            try:
                order.append((scope.find(col)[0].internal(col.name), down))
            except ColumnNotFound:  # an alias of the select list
                if col.table or col.name not in named:
                    raise
                value = named[col.name]
                order.append((scope.find(value)[0].internal(value.name), down))
        df = top_k(df, order, q.limit) if order and q.limit is not None else limit(order_by(df, order), q.limit)
        columns = [self.column(scope, i.value).alias(f"c{k}") for k, i in enumerate(items)]
        return Query(df.select(*columns), [i.alias or i.value.name for i in items], [scope.find(i.value)[1] for i in items])

    def aggregate(self, q: Select, items: list[Item], df: DataFrame, scope: Scope) -> Query:
        if q.items is None:
            raise EngineError("* can't be grouped")
        grouped(items, q.group, scope)
        slots: dict[tuple, Aggregate] = {}

        def slot(agg: Agg) -> Aggregate:
            kind = scope.aggregate(agg)
            column = None if agg.col is None else scope.find(agg.col)[0].internal(agg.col.name)
            return slots.setdefault((agg.func, column), Aggregate(agg.func, column, f"g{len(slots)}", kind.zero))

        columns, captions, types = [], [], []
        for i in items:
            if isinstance(i.value, Agg):
                columns.append(slot(i.value).name)
                captions.append(i.alias or i.value.func.lower())
                types.append(scope.aggregate(i.value))
            else:
                columns.append(scope.find(i.value)[0].internal(i.value.name))
                captions.append(i.alias or i.value.name)
                types.append(scope.find(i.value)[1])
        having = [(slot(a).name, op, having_value(v, scope.aggregate(a))) for a, op, v in q.having]
        keys = list(dict.fromkeys(scope.find(g)[0].internal(g.name) for g in q.group))
        aliases = dict(zip(captions, columns, strict=True))
        order = []
        for col, down in q.order:
            try:
                order.append((scope.find(col)[0].internal(col.name), down))
            except ColumnNotFound:
                if col.table or col.name not in aliases:
                    raise
                order.append((aliases[col.name], down))
        if not keys:
            out = global_aggregate(df, list(slots.values()) or [Aggregate("COUNT", None, "g0")])
            order = []
        else:
            made = {a.name for a in slots.values()}
            extra, by_first = [], [k for k, _ in order if k not in keys and k not in made]
            if by_first and any(k in made for k, _ in order):
                # next to an aggregate, a column counts with its first value in the group
                extra = [(F.max if down else F.min)(k).alias(f"_order{n}") for n, (k, down) in enumerate(order) if k in by_first]
                order = [(f"_order{n}" if k in by_first else k, down) for n, (k, down) in enumerate(order)]
            elif by_first:
                first, down = group_order(df, order)
                extra, order = [first.alias("_order")], [("_order", down)]
            out = df.groupBy(*keys).agg(*[a.column_() for a in slots.values()], *extra) if slots or extra else df.select(*keys).distinct()
        out = filter_rows(out, [compare(F.col(n), op, F.lit(v)) for n, op, v in having])
        out = top_k(out, order, q.limit) if order and q.limit is not None else limit(order_by(out, order), q.limit)
        return Query(out.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(columns)]), captions, types)


def table_predicate(columns: dict[str, SqlType], table: str, where: list[Cond]) -> tuple[Column, list[Cond]]:
    """A WHERE over one table as a Column over its plain column names, and its checked conditions."""
    source = Source(table, table, columns, "")
    source.internal = lambda c: c  # type: ignore[method-assign]
    scope = Scope([source])
    checked = [scope.condition(c) for c in where]
    out = []
    for c in checked:
        right = literal(c.right.value, columns[c.left.name]) if isinstance(c.right, Lit) else F.col(f"`{c.right.name}`")
        out.append(compare(F.col(f"`{c.left.name}`"), c.op, right))
    return conjunction(out), checked
