"""EXPLAIN and SELECT over many shapes of query, against a mirror in plain Python that runs nested loops over the rows."""

import pytest

from lattis.plans import dialect as d

OPS = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}
TABLES = {
    "dept": ("id int, name char(8)", [(1, "tools"), (2, "sales"), (3, "crew")]),
    "person": ("pid int, id int, name char(8), pay int", [(10, 1, "ann", 50), (11, 1, "bo", 70), (12, 2, "cy", 70), (13, 9, "di", 20)]),
    "office": ("oid int, id int, town char(8), rent float", [(1, 1, "ulm", 10.5), (2, 2, "bonn", 0.1), (3, 2, "ulm", 7.25)]),
    "pair": ("a int, b int", [(1, 1), (2, 1), (2, 2), (3, 5), (4, 4)]),
    "code": ("k char(4), id int", [("x", 1), ("y", 2), ("tool", 3)]),
    "ship": ("k char(4), tag char(8)", [("x", "p"), ("tool", "q"), ("z", "r")]),
    "nobody": ("id int, v int", []),
}
SHAPES = [
    "select * from pair", "select a from pair where b = 1", "select b, a from pair where a < b", "select a from pair where a <= b and b > 1 and a <> 3", "select * from pair where a = 2 limit 1", "select a from pair limit 0", "select pair.a from pair where pair.b >= 4",
    "select rent from office where rent = 0.1", "select town from office where rent > 7.0 and town = 'ulm'", "select name from person where name >= 'b' and name < 'd'",
    "select person.name from person join dept on person.id = dept.id", "select person.name, dept.name from person join dept on dept.id = person.id", "select * from dept join person on dept.id = person.id",
    "select dept.name from dept join person on dept.id = person.id where person.pay > 60", "select dept.name from dept join person on dept.id = person.id where dept.id = 1", "select dept.name from dept join person on person.id = dept.id where person.id < 2 and dept.name = 'tools'",
    "select dept.name from dept, person where dept.id = person.id and person.pay >= 50 and dept.id <= 2", "select person.pid from person, dept where person.id = dept.id and person.pay < 60", "select dept.id, person.pid from dept, person", "select * from dept, pair, code",
    "select person.name, dept.name, office.town from person join dept on person.id = dept.id join office on dept.id = office.id", "select person.name, office.rent from person join dept on person.id = dept.id join office on person.id = office.id where office.rent > 1.0",
    "select office.town from office join dept on office.id = dept.id join person on dept.id = person.id where dept.id = 2", "select dept.name from dept join person on dept.id = person.id join office on office.id = dept.id and office.oid = person.id",
    "select dept.name from dept join person on dept.id = person.id and dept.id < person.pay", "select dept.name from dept join person on dept.id < person.id", "select dept.name, pair.b from dept join pair on dept.id = pair.a and dept.id = pair.b",
    "select x.a, y.b from pair x join pair y on x.a = y.b", "select x.a from pair x join pair y on x.a = y.b where x.b = 1 and y.a > 1", "select p.name from person p join person q on p.pay = q.pay where p.pid < q.pid", "select x.a from pair x, pair y, pair z where x.a = y.a and y.b = z.b",
    "select code.id, ship.tag from code join ship on code.k = ship.k", "select ship.tag from code join ship on ship.k = code.k where code.k = 'tool'", "select dept.name, code.k, ship.tag from dept join code on dept.id = code.id join ship on code.k = ship.k",
    "select dept.name from dept join nobody on dept.id = nobody.id", "select dept.name, person.name from dept join nobody on dept.id = nobody.id join person on person.id = dept.id", "select * from nobody where v = 1", "select dept.name from dept join person on dept.id = person.id limit 2",
    "select dept.name, person.name, office.town, code.k from dept join person on dept.id = person.id join office on dept.id = office.id join code on code.id = dept.id", "select dept.name, person.name, office.town, code.k, ship.tag from dept join person on dept.id = person.id join office on dept.id = office.id join code on code.id = dept.id join ship on ship.k = code.k",
    "select x.a from pair x join pair y on x.a = y.a join pair z on y.a = z.a where z.a = 2", "select dept.id from dept, person, office where person.id = office.id and dept.id = person.id and office.rent < 10.0", "select person.pay from person where pay > id and pay = 70", "select dept.name from dept join person on dept.id = person.id where dept.name <> person.name",
]


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    from lattis.session import Session
    from lattis.sources.storage import Database

    s = Session(Database(spark, str(tmp_path_factory.mktemp("plans"))))
    value = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    for name, (columns, rows) in TABLES.items():
        s.sql(f"create table {name} ({columns});")
        for r in rows:
            s.sql(f"insert into {name} values ({', '.join(map(value, r))});")
    return s


@pytest.fixture(scope="module")
def indexed(loaded):
    for name, column in (("dept", "id"), ("person", "pid"), ("nobody", "id"), ("ship", "k"), ("code", "id")):
        loaded.sql(f"create index {name}({column});")
    loaded.sql("create index pair(a, b);")  # of two columns: no help for a join on one
    return loaded


class Mirror:
    """A query's rows and plan by nested loops."""

    def __init__(self, text, indexes):
        q = d.parse(text)
        self.q, self.indexes = q, indexes
        self.refs = [(r.alias, r.name) for r in q.refs]
        self.columns = {a: [c.split()[0] for c in TABLES[t][0].split(", ")] for a, t in self.refs}
        self.float = {(a, c.split()[0]) for a, t in self.refs for c in TABLES[t][0].split(", ") if c.endswith("float")}
        self.where = self.propagated([(self.full(c.left), c.op, self.full(c.right) if isinstance(c.right, d.Col) else c.right.value) for c in q.where])

    def full(self, col):
        return next((a, col.name) for a, _ in self.refs if col.table in (None, a) and col.name in self.columns[a])

    def propagated(self, where):
        """Comparisons with literals, for all columns tied to one another by equalities, until nothing is new."""
        ties = [{x, y} for x, op, y in where if op == "=" and isinstance(y, tuple)]
        grown = True
        while grown:
            grown = False
            for i, s in enumerate(ties):
                for t in ties[i + 1 :]:
                    if s & t:
                        s |= t
                        ties.remove(t)
                        grown = True
                        break
        out = list(where)
        for x, op, v in where:
            if not isinstance(v, tuple):
                for s in ties:
                    out += [(y, op, v) for y in s if x in s and (y, op, v) not in out]
        return out

    def holds(self, row, conds):
        import numpy as np

        get = lambda x: row[x] if isinstance(x, tuple) else x
        wide = lambda x, v: float(np.float32(v)) if x in self.float else v
        return all(OPS[op](wide(x, get(x)), wide(x, get(y))) for x, op, y in conds)

    def rows_of(self, k):
        a, t = self.refs[k]
        return [{(a, c): v for c, v in zip(self.columns[a], r, strict=True)} for r in TABLES[t][1]]

    def own(self, k):
        return [c for c in self.where if {x[0] for x in (c[0], c[2]) if isinstance(x, tuple)} == {self.refs[k][0]}]

    def across(self, k):
        """Conditions between tables, the last of which is number k."""
        at = {a: i for i, (a, _) in enumerate(self.refs)}
        return [c for c in self.where if isinstance(c[2], tuple) and c[0][0] != c[2][0] and max(at[c[0][0]], at[c[2][0]]) == k]

    def joined(self, k):
        """Rows of the first k + 1 tables, and all of table k's beside the rows before it."""
        rows = [{}]
        for i in range(k + 1):
            rows = [r | s for r in rows for s in self.rows_of(i) if self.holds(s, self.own(i)) and self.holds(r | s, self.across(i))]
        return rows

    def selected(self):
        items = [self.full(i.value) for i in self.q.items] if self.q.items else [(a, c) for a, _ in self.refs for c in self.columns[a]]
        return [tuple(r[c] for c in items) for r in self.joined(len(self.refs) - 1)]

    def text(self, c):
        value = c[2]
        shown = ".".join(value) if isinstance(value, tuple) else f"'{value}'" if isinstance(value, str) else f"{value:.6f}" if isinstance(value, float) else str(value)
        return f"{'.'.join(c[0])}{c[1]}{shown}"

    def plan(self):
        last, items = len(self.refs) - 1, None if self.q.items is None else [self.full(i.value) for i in self.q.items]
        n = len(self.joined(last))
        n = n if self.q.limit is None else min(n, self.q.limit)
        names = lambda cols: ", ".join(sorted({".".join(c) for c in cols}))
        out = [f"Project(columns=[{'*' if items is None else names(items)}], rows={n})"]

        def leaf(k, depth):
            a, table = self.refs[k]
            before = len(self.joined(k - 1)) if k else 1
            scan, kept, how = len(self.rows_of(k)) * before, sum(self.holds(r, self.own(k)) for r in self.rows_of(k)) * before, "SeqScan"
            for x, op, y in self.across(k):
                mine = x if x[0] == a else y
                if op == "=" and how == "SeqScan" and [mine[1]] in self.indexes.get(table, []):
                    how = f"IndexScan, using_index=({mine[1]})"
                    scan = kept = sum(r[x if mine == y else y] == s[mine] for r in self.joined(k - 1) for s in self.rows_of(k) if self.holds(s, self.own(k)))
            if last and items is not None:
                joins = [x for i in range(last + 1) for c in self.across(i) for x in (c[0], c[2]) if x[0] == a]
                out.append("\t" * depth + f"Project(columns=[{names([i for i in items if i[0] == a] + joins)}], rows={kept})")
                depth += 1
            if self.own(k):
                out.append("\t" * depth + f"Filter(condition=[{', '.join(sorted(map(self.text, self.own(k))))}], rows={kept})")
                depth += 1
            out.append("\t" * depth + f"Scan(table={table}, type={how}, rows={scan})")

        def join(k, depth):
            if k and self.across(k):
                out.append("\t" * depth + f"Join(tables=[{', '.join(sorted({t for _, t in self.refs[: k + 1]}))}], condition=[{', '.join(sorted(map(self.text, self.across(k))))}], rows={len(self.joined(k))})")
                depth += 1
            if k:
                join(k - 1, depth)
            leaf(k, depth)

        join(last, 1)
        return out


def check(s, text, indexes):
    mirror = Mirror(text, indexes)
    rounded = lambda rows: sorted(tuple(round(v, 4) if isinstance(v, float) else v for v in r) for r in rows)
    got, want = rounded(s.sql(text + ";").rows()), rounded(mirror.selected())
    if mirror.q.limit is None:
        assert got == want
    else:
        assert len(got) == min(len(want), mirror.q.limit) and set(got) <= set(want)
    plan = s.execute(f"explain analyze {text};").splitlines()
    assert plan == mirror.plan()


@pytest.mark.parametrize("text", SHAPES)
def test_without_indexes(loaded, text):
    check(loaded, text, {})


@pytest.mark.parametrize("text", [t for t in SHAPES if " join " in t or ", " in t.split(" from ")[1]])
def test_with_indexes(indexed, text):
    check(indexed, text, {"dept": [["id"]], "person": [["pid"]], "nobody": [["id"]], "ship": [["k"]], "code": [["id"]], "pair": [["a", "b"]]})
