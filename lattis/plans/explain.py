"""EXPLAIN: the plan of a SELECT with the rows of each node.

The counts are a definition, not a trace of what Spark ran: a node under the right side of a join counts its rows once
for each row of the joins before it. All counts are taken by one Spark query over the same builder.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lattis.errors import EngineError
from lattis.operators import cross_join, filter_rows, semi_join
from lattis.plans.build import Builder
from lattis.plans.checks import Scope
from lattis.plans.dialect import Col, Cond, Derived, Select
from lattis.types import Lit


def _value(v) -> str:
    if isinstance(v, Col):
        return str(v)
    if v.kind == "FLOAT":
        return f"{v.value:.6f}"
    return f"'{v.value}'" if v.kind == "CHAR" else str(int(v.value))


def _text(c: Cond) -> str:
    return f"{c.left}{c.op}{_value(c.right)}"


def propagate(where: list[Cond]) -> list[Cond]:
    """A comparison of a column with a literal holds for all columns that equalities tie it to."""
    up: dict[Col, Col] = {}

    def top(c: Col) -> Col:
        while up.get(c, c) != c:
            c = up[c]
        return c

    for c in where:
        if c.op == "=" and isinstance(c.right, Col):
            up[top(c.left)] = top(c.right)
            up.setdefault(c.left, top(c.left))
            up.setdefault(c.right, top(c.right))
    out, seen = list(where), {_text(c) for c in where}
    members = list(dict.fromkeys([x for c in where if c.op == "=" and isinstance(c.right, Col) for x in (c.left, c.right)]))
    for c in where:
        if isinstance(c.right, Lit):
            for m in members:
                if m != c.left and c.left in members and top(m) == top(c.left):
                    new = Cond(m, c.op, c.right)
                    if _text(new) not in seen:
                        seen.add(_text(new))
                        out.append(new)
    return out


def explain(q: Select, builder: Builder, indexes) -> list[str]:
    """Lines of the plan; indexes(table) gives the column lists of a table's indexes."""
    if any(isinstance(r, Derived) for r in q.refs):
        return _union(q, builder, indexes)
    made = [builder.source(r, k) for k, r in enumerate(q.refs)]
    sources, frames = [m[0] for m in made], [m[1] for m in made]
    scope = Scope(sources)
    where = propagate([scope.condition(c) for c in q.where])
    place = {s.alias: i for i, s in enumerate(sources)}
    tables = lambda c: {x.table for x in (c.left, c.right) if isinstance(x, Col)}
    local = {s.alias: [c for c in where if tables(c) == {s.alias}] for s in sources}
    joins = [c for c in where if len(tables(c)) > 1]
    step = {i: [c for c in joins if max(place[t] for t in tables(c)) == i] for i in range(len(sources))}
    filtered = [filter_rows(df, [builder.predicate(scope, c) for c in local[s.alias]]) for s, df in zip(sources, frames, strict=True)]
    joined = [filtered[0]]
    for i in range(1, len(sources)):
        joined.append(filter_rows(cross_join(joined[-1], filtered[i]), [builder.predicate(scope, c) for c in step[i]]))
    # A right side with an index on its only join column is counted by the index's hits.
    by_index, hits = {}, {}
    for i, s in enumerate(sources[1:], 1):
        for c in step[i]:
            for mine, other in ((c.left, c.right), (c.right, c.left)):
                if c.op == "=" and isinstance(c.right, Col) and mine.table == s.alias and [mine.name] in indexes(s.table) and i not in by_index:
                    by_index[i] = mine.name
                    one = joined[i - 1].join(filtered[i], builder.column(scope, mine) == builder.column(scope, other))
                    hits[i] = one
    semi, halves = None, {}
    if q.semi:
        right, rdf = builder.source(q.semi[0], len(sources))
        both = Scope([*sources, right])
        semi = both.condition(q.semi[1])
        halves = {0: rdf, 1: semi_join(joined[-1], rdf, builder.predicate(both, semi))}
    counts, products = {}, [i for i in range(1, len(sources)) if not step[i]]
    for name, dfs in (("t", frames), ("f", filtered), ("j", joined), ("x", hits), ("s", halves)):
        for i, df in dfs.items() if isinstance(dfs, dict) else enumerate(dfs):
            if name == "j" and i in products:
                continue  # a product's rows are those of its sides, multiplied
            counts[f"{name}{i}"] = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"{name}{i}").alias("k"), "n")
    both = None
    for df in counts.values():
        both = df if both is None else both.union(df)
    n = {r["k"]: r["n"] for r in both.collect()}
    for i in products:
        n[f"j{i}"] = n[f"j{i - 1}"] * n[f"f{i}"]
    left = n[f"j{len(sources) - 1}"]
    total = n["s1"] if semi else left
    items = None if q.items is None else sorted({str(scope.qualify(i.value)) for i in q.items if isinstance(i.value, Col)})
    used = {s.alias: set() for s in sources}
    for i in q.items or []:
        if isinstance(i.value, Col):
            c = scope.qualify(i.value)
            used[c.table].add(str(c))
    for c in joins + ([semi] if semi else []):
        for x in (c.left, c.right):
            if isinstance(x, Col):
                used.setdefault(x.table, set()).add(str(x))
    several = len(sources) > 1 or semi is not None
    rows = min(total, q.limit) if q.limit is not None else total
    lines = [f"Project(columns=[{'*' if items is None else ', '.join(items)}], rows={rows})"]

    def leaf(i: int, depth: int) -> None:
        s, times = sources[i], n[f"j{i - 1}"] if i else 1
        scan, after, kind = n[f"t{i}"] * times, n[f"f{i}"] * times, "type=SeqScan"
        if i in by_index:
            scan = after = n[f"x{i}"]
            kind = f"type=IndexScan, using_index=({by_index[i]})"
        if several and q.items is not None:
            lines.append("\t" * depth + f"Project(columns=[{', '.join(sorted(used[s.alias]))}], rows={after})")
            depth += 1
        if local[s.alias]:
            lines.append("\t" * depth + f"Filter(condition=[{', '.join(sorted(map(_text, local[s.alias])))}], rows={after})")
            depth += 1
        lines.append("\t" * depth + f"Scan(table={s.table}, {kind}, rows={scan})")

    def join(i: int, depth: int) -> None:
        if i == 0:
            leaf(0, depth)
            return
        if step[i]:
            names = ", ".join(sorted({s.table for s in sources[: i + 1]}))
            lines.append("\t" * depth + f"Join(tables=[{names}], condition=[{', '.join(sorted(map(_text, step[i])))}], rows={n[f'j{i}']})")
            depth += 1
        join(i - 1, depth)
        leaf(i, depth)

    if semi is None:
        join(len(sources) - 1, 1)
        return lines
    lines.append(f"\tSemiJoin(tables=[{', '.join(sorted({*(s.table for s in sources), right.table}))}], condition=[{_text(semi)}], rows={total})")
    join(len(sources) - 1, 2)
    lines.append(f"\t\tProject(columns=[{', '.join(sorted(used.get(right.alias, set())))}], rows={n['s0'] * left})")
    lines.append(f"\t\t\tScan(table={right.table}, type=SeqScan, rows={n['s0'] * left})")
    return lines


def _union(q: Select, builder: Builder, indexes) -> list[str]:
    """A query over one UNION: the rows it gives, those of the UNION, and the branches' plans."""
    if len(q.refs) > 1:
        raise EngineError("EXPLAIN of a join with a UNION")
    source, df, _ = builder.derived(q.refs[0], 0)
    scope = Scope([source])
    where = [scope.condition(c) for c in q.where]
    whole, rows = df.count(), builder.select(q).df.count()
    columns = "*" if q.items is None else ", ".join(sorted({str(scope.qualify(i.value)) for i in q.items if isinstance(i.value, Col)}))
    lines = [f"Project(columns=[{columns}], rows={rows})"]
    if where:
        kept = filter_rows(df, [builder.predicate(scope, c) for c in where]).count()
        lines.append("\t" * len(lines) + f"Filter(condition=[{', '.join(sorted(map(_text, where)))}], rows={kept})")
    lines.append("\t" * len(lines) + f"Union(branches={len(q.refs[0].branches)}, rows={whole})")
    depth = len(lines)
    for branch in q.refs[0].branches:
        lines += ["\t" * depth + x for x in explain(branch, builder, indexes)]
    return lines
