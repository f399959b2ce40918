import pytest

from lattis.errors import SyntaxFault
from lattis.plans import dialect as d
from lattis.types import Lit, SqlType


def test_select_parts():
    q = d.parse("SELECT a.x AS k, COUNT(*) AS n FROM t a, u JOIN v ON a.x = v.x WHERE u.y <> -3 GROUP BY a.x HAVING MAX(y) >= 2.5 AND COUNT(*) > 1 ORDER BY a.x DESC, k LIMIT 4;")
    assert [i.alias for i in q.items] == ["k", "n"] and q.items[1].value == d.Agg("COUNT", None)
    assert [(r.name, r.alias) for r in q.refs] == [("t", "a"), ("u", "u"), ("v", "v")]
    assert q.where == [d.Cond(d.Col("a", "x"), "=", d.Col("v", "x")), d.Cond(d.Col("u", "y"), "<>", Lit(-3, "INT"))]
    assert q.group == [d.Col("a", "x")] and q.limit == 4 and q.order == [(d.Col("a", "x"), True), (d.Col(None, "k"), False)]
    assert q.having == [(d.Agg("MAX", d.Col(None, "y")), ">=", Lit(2.5, "FLOAT")), (d.Agg("COUNT", None), ">", Lit(1, "INT"))]


def test_semi_join_and_union():
    q = d.parse("select * from l semi join r on l.a < r.b where l.a = 1")
    assert q.semi == (d.Ref("r", "r"), d.Cond(d.Col("l", "a"), "<", d.Col("r", "b"))) and len(q.where) == 1
    u = d.parse("select * from (select a from t union select b from u union select c from v) w order by a")
    assert isinstance(u.refs[0], d.Derived) and len(u.refs[0].branches) == 3 and u.refs[0].alias == "w"


def test_statements():
    assert d.parse("create table t (a int, b char(4), c float, e datetime);").columns == [("a", SqlType("INT")), ("b", SqlType("CHAR", 4)), ("c", SqlType("FLOAT")), ("e", SqlType("CHAR", 19))]
    assert d.parse("load ../x/y-1.csv into t;") == d.Load("../x/y-1.csv", "t")
    assert d.parse("update t set a = a + 1, b = 'x', c = e").sets[0] == d.Assign("a", d.Col(None, "a"), "+", Lit(1, "INT"))
    assert d.parse("set enable_sortmerge = true").value is True
    assert d.parse("rollback") == d.TableCommand("abort")
    assert d.parse("create static_checkpoint;") == d.TableCommand("checkpoint")
    assert d.parse("explain analyze select a from t").query.items[0].value == d.Col(None, "a")
    assert d.parse("-- nothing\n ;") is None
    assert d.parse("set output_file off") == d.Setting("output_file", False)


@pytest.mark.parametrize("text", ["select a from t where a != 1", "select from t", "select a from t where 1 = a", "select a b from t", "insert into t (a) values (1)", "select a from (select a from t) x", "select a from t where a = 1 or a = 2", "select a from t limit -1", "create index t", "select a from t; x", "insert into t values (99999999999)"])
def test_rejected(text):
    with pytest.raises(SyntaxFault):
        d.parse(text)


def test_split_keeps_strings_and_comments_whole():
    parts = d.split("insert into t values ('a;b'); -- c;d\n select 1x from t; /* ; */")
    assert len(parts) == 3 and "'a;b'" in parts[0]


def test_case():
    assert d.parse("SeLeCt A FROM T").items[0].value == d.Col(None, "A")
