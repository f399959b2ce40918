"""Random statements against a mirror in plain Python."""

import random

import pytest

from lattis.session import Session

OPS = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}


def condition(r):
    column, op, value = r.choice("ab"), r.choice(list(OPS)), r.randint(0, 9)
    return f"{column} {op} {value}", lambda row: OPS[op](row["ab".index(column)], value)


@pytest.mark.parametrize("seed", range(3))
def test_changes(session, seed):
    r, mirror, before = random.Random(seed), [], None
    session.sql("create table t (a int, b int);")
    for _ in range(45):
        kind = r.choice(["insert", "insert", "insert", "update", "delete", "select", "begin", "commit", "abort", "checkpoint"])
        text, holds = condition(r)
        if kind == "insert":
            row = (r.randint(0, 9), r.randint(0, 9))
            session.sql(f"insert into t values ({row[0]}, {row[1]});")
            mirror.append(row)
        elif kind == "update":
            session.sql(f"update t set a = b, b = b + 1 where {text};")
            mirror = [(b, b + 1) if holds((a, b)) else (a, b) for a, b in mirror]
        elif kind == "delete":
            session.sql(f"delete from t where {text};")
            mirror = [x for x in mirror if not holds(x)]
        elif kind == "select":
            assert sorted(session.sql(f"select * from t where {text};").rows()) == sorted(x for x in mirror if holds(x))
        elif kind == "begin" and before is None:
            session.sql("begin;")
            before = list(mirror)
        elif kind in ("commit", "abort") and before is not None:
            session.sql(f"{kind};")
            mirror, before = (mirror if kind == "commit" else before), None
        elif kind == "checkpoint" and before is None:
            session.sql("create static_checkpoint;")
        assert sorted(session.sql("select * from t;").rows()) == sorted(mirror)
    other = Session(session.db)
    assert sorted(other.sql("select * from t;").rows()) == sorted(mirror if before is None else before)


@pytest.mark.parametrize("seed", range(3))
def test_queries(session, seed):
    r = random.Random(100 + seed)
    left, right = ([(r.randint(0, 5), r.randint(0, 9)) for _ in range(12)] for _ in range(2))
    session.sql("create table l (a int, b int);")
    session.sql("create table r (a int, b int);")
    for name, rows in (("l", left), ("r", right)):
        for a, b in rows:
            session.sql(f"insert into {name} values ({a}, {b});")
    op = r.choice(list(OPS))
    assert sorted(session.sql(f"select l.b, r.b from l join r on l.a = r.a where l.b {op} r.b;").rows()) == sorted((x[1], y[1]) for x in left for y in right if x[0] == y[0] and OPS[op](x[1], y[1]))
    assert sorted(session.sql(f"select * from l semi join r on l.b {op} r.a;").rows()) == sorted(x for x in left if any(OPS[op](x[1], y[0]) for y in right))
    groups = {}
    for a, b in left:
        groups.setdefault(a, []).append(b)
    n = r.randint(1, 3)
    assert sorted(session.sql(f"select a, count(*), sum(b), min(b), max(b) from l group by a having count(*) >= {n};").rows()) == sorted((a, len(v), sum(v), min(v), max(v)) for a, v in groups.items() if len(v) >= n)
    assert sorted(session.sql("select * from (select a, b from l union select b, a from r) u;").rows()) == sorted(set(left) | {(b, a) for a, b in right})
    k = r.randint(0, 5)
    assert session.sql(f"select a, b from l order by b desc, a limit {k};").rows() == sorted(left, key=lambda x: (-x[1], x[0]))[:k]
