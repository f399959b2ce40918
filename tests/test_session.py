import pytest

from lattis.errors import AmbiguousColumn, ColumnNotFound, EngineError, IncompatibleType, StringTooLong, TableExists, TableNotFound, ValueCountMismatch
from lattis.session import Session
from lattis.sources.storage import RID, Database

MARKS = """create table marks (course char(12), id int, score float);
insert into marks values ('algebra', 1, 95);
insert into marks values ('algebra', 2, 93.5);
insert into marks values ('physics', 1, 99);
insert into marks values ('physics', 2, 88.5);
insert into marks values ('music', 3, 70.25);"""


def ordered(text):
    return sorted(text.splitlines())


def test_ddl_and_listings(session):
    assert session.script("create table t (a int, b char(4)); create index t(a); show tables; show index from t; desc t;").splitlines() == [
        "| Tables |", "| t |", "| t | unique | (a) |", "| Field | Type | Index |", "| a | INT | YES |", "| b | STRING | NO |"]
    assert session.script("drop index t(a); show index from t; drop table t; show tables; drop table t; create index t(a);") == "| Tables |\nfailure\nfailure\n"
    assert "begin | commit" in session.execute("help;")


def test_select_where_and_floats(session):
    session.script(MARKS)
    assert session.execute("select id, score from marks where course = 'algebra' and score < 95;") == "| id | score |\n| 2 | 93.500000 |\n"
    assert ordered(session.execute("select * from marks where id >= 2 and score <> 88.5;")) == ordered("| course | id | score |\n| algebra | 2 | 93.500000 |\n| music | 3 | 70.250000 |\n")
    session.script("create table f (x float); insert into f values (89.99);")
    assert session.execute("select * from f where x = 89.99;") == "| x |\n| 89.989998 |\n"  # compared in 32 bits


def test_aggregates(session):
    session.script(MARKS)
    assert session.execute("select count(*) as n, sum(id) as s, avg(score) as m, min(course) as c, max(score) as h from marks;") == "| n | s | m | c | h |\n| 5 | 9 | 89.250000 | algebra | 99.000000 |\n"
    assert session.execute("select count(id), sum(score), max(course), min(id) from marks where id > 100;") == "| count | sum | max | min |\n| 0 | 0.000000 |  | 0 |\n"
    assert ordered(session.execute("select course, max(score) as top from marks group by course having count(*) > 1 and min(id) < 2;")) == ordered("| course | top |\n| algebra | 95.000000 |\n| physics | 99.000000 |\n")
    # an input order: groups come by their first rows
    assert session.execute("select course, count(*) as n from marks group by course order by score desc limit 2;") == "| course | n |\n| physics | 2 |\n| algebra | 2 |\n"
    assert session.execute("select course, count(*) as n from marks group by course order by id desc, course;").splitlines()[1:] == ["| music | 1 |", "| algebra | 2 |", "| physics | 2 |"]
    assert session.execute("select id from marks group by course;") == "failure\n"
    assert session.execute("select sum(course) from marks;") == "failure\n"


def test_order_and_limit(session):
    session.script(MARKS)
    assert session.execute("select course from marks order by id desc, score limit 2;") == "| course |\n| music |\n| physics |\n"
    assert session.execute("select id from marks limit 0;") == "| id |\n"


def test_joins(session):
    session.script("create table a (id int, k int, v int); create table b (id int, k int, w int);" + "".join(f"insert into a values ({i}, {i % 3}, {i * 10});" for i in range(6)) + "".join(f"insert into b values ({i}, {i}, {i});" for i in range(3)))
    assert len(session.sql("select a.id, b.id from a join b on a.k = b.k;").rows()) == 6
    assert len(session.sql("select * from a, b;").rows()) == 18
    assert sorted(session.sql("select a.id, b.id from a join b on a.k < b.k where b.w > 1;").rows()) == [(0, 2), (1, 2), (3, 2), (4, 2)]
    assert sorted(session.sql("select * from a semi join b on a.id = b.id where a.v > 0;").rows()) == [(1, 1, 10), (2, 2, 20)]
    assert sorted(session.sql("select x.id, y.id from a x join a y on x.k = y.k where x.id < y.id;").rows()) == [(0, 3), (1, 4), (2, 5)]
    assert session.execute("select a.id, a.id from a where a.id = 1;") == "| id | id |\n| 1 | 1 |\n"
    for text, error in (("select id from a, b;", AmbiguousColumn), ("select z from a;", ColumnNotFound), ("select * from a, a;", AmbiguousColumn), ("select * from zz;", TableNotFound)):
        with pytest.raises(error):
            session.sql(text)


def test_join_hint_setting(session):
    session.script("create table a (id int); create table b (id int); insert into a values (1); insert into b values (1); set enable_nestloop = false; set enable_sortmerge = true;")
    text, plan = "select a.id from a join b on a.id = b.id;", lambda r: r.df._jdf.queryExecution().executedPlan().toString()
    merged = session.sql(text)
    assert merged.rows() == [(1,)] and "SortMergeJoin" in plan(merged)
    for hint, name in (("SHUFFLE_HASH", "ShuffledHashJoin"), ("BROADCAST", "BroadcastHashJoin"), ("MERGE", "SortMergeJoin")):
        made = Session(session.db, hint=hint).sql(text)
        assert made.rows() == [(1,)] and name in plan(made)


def test_union(session):
    session.script("create table p (n int, r char(4)); create table q (n float, r char(9)); insert into p values (1, 'x'); insert into p values (1, 'x'); insert into q values (1.0, 'x'); insert into q values (2.5, 'longer');")
    assert session.execute("select * from (select * from p union select * from q) as u order by n desc;") == "| n | r |\n| 2.500000 | longer |\n| 1.000000 | x |\n"
    assert session.execute("select r from (select * from p union select * from q) u where n > 2.0;") == "| r |\n| longer |\n"
    for bad in ("select * from (select n from p union select * from q) u;", "select * from (select n from p union select r from q) u;", "select * from (select n from p union select n from q) u order by r;"):
        assert session.execute(bad) == "failure\n"


def test_types_are_checked(session):
    session.script("create table t (a int, f float, c char(3));")
    for text, error in (
        ("insert into t values (1, 2);", ValueCountMismatch), ("insert into t values (1, 2, 'long');", StringTooLong), ("insert into t values (1.5, 2, 'x');", IncompatibleType),
        ("select * from t where a = 1.5;", IncompatibleType), ("select * from t where a = f;", IncompatibleType), ("select * from t where c = 'long';", StringTooLong),
        ("select * from t where a = true;", IncompatibleType), ("update t set c = c + 1;", IncompatibleType), ("update t set a = f;", IncompatibleType), ("update t set a = a / 0;", EngineError), ("create table t (a int);", TableExists),
    ):
        with pytest.raises(error):
            session.sql(text)
    session.script("insert into t values (1, 2, 'abc'); insert into t values (3, -1.5, 'äb'); insert into t values (5, 1, 'äbc');")
    assert len(session.sql("select * from t;").rows()) == 2  # CHAR(n) counts bytes


def test_update_and_delete(session):
    session.script("create table t (a int, b int, f float);" + "".join(f"insert into t values ({i}, {i * 2}, {i}.5);" for i in range(5)))
    session.sql("update t set a = b, b = a + 100, f = f * 2 where a >= 2;")  # new values come from the old row
    assert sorted(session.sql("select * from t;").rows()) == [(0, 0, 0.5), (1, 2, 1.5), (4, 102, 5.0), (6, 103, 7.0), (8, 104, 9.0)]
    session.sql("update t set a = a / -3 where b > 100;")
    assert sorted(r[0] for r in session.sql("select a from t where b > 100;").rows()) == [-2, -2, -1]  # toward zero
    session.sql("update t set f = a where a < 0;")
    session.sql("delete from t where f < 0.0;")
    assert len(session.sql("select * from t;").rows()) == 2
    session.sql("delete from t;")
    assert session.execute("select count(*) as n from t;") == "| n |\n| 0 |\n"
    session.script("insert into t values (2147483647, 1, 1.0);")
    assert session.execute("update t set a = a + 1;") == "failure\n"


def test_unique_keys(session):
    session.script("create table t (id int, c char(4)); insert into t values (1, 'a'); insert into t values (2, 'b'); create index t(id);")
    assert session.execute("insert into t values (1, 'z');") == "failure\n"
    assert session.execute("update t set id = 1 where c = 'b';") == "failure\n"
    assert session.execute("update t set id = id + 1;") == ""  # the state after the whole statement counts
    assert sorted(session.sql("select id from t;").rows()) == [(2,), (3,)]
    session.script("insert into t values (9, 'a');")
    assert session.execute("create index t(c);") == "failure\n"
    assert session.execute("create index t(id, c);") == ""


def test_output_file(session, tmp_path):
    session.script("create table t (a int); insert into t values (1); select * from t; select * from u; set output_file off; select * from t;")
    assert (tmp_path / "output.txt").read_text() == "| a |\n| 1 |\nfailure\n"
    assert "Total record(s): 1" in session.sql("select * from t;").table()


def test_csv(session, tmp_path, spark):
    path = tmp_path / "in.csv"
    path.write_text('h1,h2,h3\n1,"a,b",2.5\n\n2,,-1\n')
    session.script(f"create table t (a int, c char(5), f float); load {path} into t;")
    assert sorted(session.sql("select * from t;").rows()) == [(1, "a,b", 2.5), (2, "", -1.0)]
    session.sql("create index t(a);")
    assert session.execute(f"load {path} into t;") == "failure\n"  # the keys are there
    for bad in ("x\n1,a\n", "x,y,z\n1,a,\n", "x,y,z\n1.5,a,1\n", "x,y,z\n7,toolong,1\n"):
        path.write_text(bad)
        assert session.execute(f"load {path} into t;") == "failure\n", bad
    assert len(session.sql("select * from t;").rows()) == 2


def test_many_rows_rewrite_only_files_they_are_in(session, tmp_path, spark):
    session.sql("create table t (a int, b int);")
    for k in range(2):
        (tmp_path / f"{k}.csv").write_text("a,b\n" + "".join(f"{k * 5000 + i},{i}\n" for i in range(5000)))
        session.sql(f"load {tmp_path}/{k}.csv into t;")
    before = set(session.db.table("t").files)
    session.sql("update t set b = b * -1 where a >= 5000 and b > 0;")
    after = set(session.db.table("t").files)
    assert before & after and before - after
    assert session.sql("select count(*) as n from t where b < 0;").rows() == [(4999,)]
    session.sql("delete from t where a < 2500;")
    assert session.sql("select count(*) as n, min(a) as low from t;").rows() == [(7500, 2500)]
    session.sql("delete from t where a = 2501;")
    session.sql("insert into t values (2501, 7);")
    assert session.sql("select b from t where a = 2501;").rows() == [(7,)]
    session.sql("create static_checkpoint;")
    t = session.db.table("t")
    assert not t.rows and not t.gone and session.db.rows(t).count() == 7500 and session.db.rows(t).select(RID).distinct().count() == 7500


def test_recovery(session, spark, tmp_path):
    session.script("create table t (a int); insert into t values (1);")
    db = session.db.folder.path
    Session(session.db).script("begin; insert into t values (2); crash;")
    (tmp_path / "db" / "manifest-000000009999.json").write_text('{"version": 99')  # a commit that didn't end
    (tmp_path / "db" / "data-orphan").mkdir()
    again = Session(Database(spark, db))
    assert again.sql("select * from t;").rows() == [(1,)]
    assert not (tmp_path / "db" / "data-orphan").exists()
    again.sql("insert into t values (3);")
    again.sql("update t set a = 4 where a = 1;")
    assert sorted(again.sql("select * from t;").rows()) == [(3,), (4,)]


def test_explain(session):
    session.script("create table a (id int, k int, v int); create table b (id int, k int, f float);" + "".join(f"insert into a values ({i}, {i}, {i});" for i in range(4)) + "".join(f"insert into b values ({i}, {i % 2}, 1.5);" for i in range(3)))
    text = "explain analyze select a.id from a join b on a.k = b.k where a.k < 2 and b.f > 1.0;"
    assert session.execute(text).splitlines() == [
        "Project(columns=[a.id], rows=3)", "\tJoin(tables=[a, b], condition=[a.k=b.k], rows=3)", "\t\tProject(columns=[a.id, a.k], rows=2)",
        "\t\t\tFilter(condition=[a.k<2], rows=2)", "\t\t\t\tScan(table=a, type=SeqScan, rows=4)", "\t\tProject(columns=[b.k], rows=6)",
        "\t\t\tFilter(condition=[b.f>1.000000, b.k<2], rows=6)", "\t\t\t\tScan(table=b, type=SeqScan, rows=6)"]
    session.script("delete from b where id = 2; create index b(k);")
    assert session.execute(text).splitlines()[-1] == "\t\t\t\tScan(table=b, type=IndexScan, using_index=(k), rows=2)"
    assert session.execute("explain select * from a where v = 1 limit 1;").splitlines() == ["Project(columns=[*], rows=1)", "\tFilter(condition=[a.v=1], rows=1)", "\t\tScan(table=a, type=SeqScan, rows=4)"]


def pair(session, level="snapshot isolation"):
    other = Session(session.db)
    for s in (session, other):
        s.sql(f"set transaction isolation level {level};")
    return session, other


def test_snapshot_isolation(session):
    a, b = pair(session)
    a.script("create table t (id int, v int); create index t(id); insert into t values (1, 10); insert into t values (2, 20);")
    a.sql("begin;")
    assert a.sql("select count(*) as n from t;").rows() == [(2,)]
    b.script("begin; update t set v = 11 where id = 1; delete from t where id = 2; insert into t values (3, 30);")
    assert sorted(b.sql("select * from t;").rows()) == [(1, 11), (3, 30)]  # its own writes
    assert sorted(a.sql("select * from t;").rows()) == [(1, 10), (2, 20)]  # no dirty read
    b.sql("commit;")
    assert sorted(a.sql("select * from t;").rows()) == [(1, 10), (2, 20)]  # its snapshot
    assert a.execute("update t set v = 5 where id = 1;") == "abort\n"
    assert sorted(a.sql("select * from t;").rows()) == [(1, 11), (3, 30)]


def test_write_conflicts(session):
    a, b = pair(session)
    a.script("create table t (id int, v int); insert into t values (1, 10);")
    a.sql("begin;")
    b.sql("begin;")
    a.sql("update t set v = 1 where id = 1;")
    assert b.execute("delete from t where id = 1;") == "abort\n"
    b.sql("begin;")
    a.sql("insert into t values (7, 7);")
    assert b.execute("insert into t values (7, 8);") == "abort\n"  # id identifies a row
    a.sql("abort;")
    assert b.execute("insert into t values (7, 8);") == ""
    assert sorted(a.sql("select * from t;").rows()) == [(1, 10), (7, 8)]


def test_an_error_rolls_a_transaction_back(session):
    session.script("create table t (a int); begin; insert into t values (1);")
    assert session.execute("insert into t values ('x');") == "abort\n"
    assert session.txn is None and session.sql("select * from t;").rows() == []


def test_disjoint_writers_both_commit(session):
    a, b = pair(session)
    a.script("create table t (k int, v int); insert into t values (1, 1); insert into t values (2, 2);")
    a.script("begin; update t set v = 10 where k = 1;")
    b.script("begin; update t set v = 20 where k = 2;")
    assert (a.execute("commit;"), b.execute("commit;")) == ("", "")
    assert sorted(a.sql("select * from t;").rows()) == [(1, 10), (2, 20)]


def test_serializable(session):
    a, b = pair(session, "serializable")
    a.script("create table t (id int, v int); insert into t values (1, 1); insert into t values (2, 1);")
    for s in (a, b):
        s.script("begin; select * from t where v = 1;")
    assert a.execute("update t set v = 0 where id = 1;") == ""
    assert b.execute("update t set v = 0 where id = 2;") == "abort\n"  # write skew
    a.sql("commit;")
    for s in (a, b):  # phantoms: both read a range and insert into it
        s.script("begin; select * from t where v > 50;")
    a.sql("insert into t values (8, 60);")
    assert b.execute("insert into t values (9, 60);") == "abort\n"
    assert a.execute("commit;") == ""
    a.sql("begin;")
    b.sql("begin;")
    a.sql("select * from t where id = 1;")
    b.sql("update t set v = 5 where id = 2;")  # not what a has read
    assert (a.execute("commit;"), b.execute("commit;")) == ("", "")


def test_files_are_sorted_by_what_look_ups_use(session, tmp_path):
    (tmp_path / "in.csv").write_text("a,b\n" + "".join(f"{i * 7919 % 5000},{i}\n" for i in range(5000)))
    session.sql("create table t (a int, b int);")
    for _ in range(5):
        session.sql("select * from t where a = 3;")
    assert session.db.advisor.sort_columns("t", ()) == ["a"]
    session.sql(f"load {tmp_path}/in.csv into t;")
    import pyarrow.parquet as pq

    for f in session.db.table("t").files:
        values = pq.read_table(f.removeprefix("file:"))["a"].to_pylist()
        assert values == sorted(values)


def test_persisted_result(session):
    session.script("create table t (a int); insert into t values (4);")
    assert session.sql("select * from t;").persist().rows() == [(4,)]


def test_append(session, spark):
    session.script("create table t (a int, c char(3)); create index t(a);")
    session.append("t", spark.createDataFrame([("x", 1), ("yz", 2)], "c string, a long"))
    assert sorted(session.sql("select * from t;").rows()) == [(1, "x"), (2, "yz")]
    for rows in ([("x", 2)], [("long", 3)], [(None, 3)], [("x", 2**40)]):
        with pytest.raises(EngineError):
            session.append("t", spark.createDataFrame(rows, "c string, a long"))
    with pytest.raises(ValueCountMismatch):
        session.append("t", spark.createDataFrame([(1,)], "a int"))
    session.sql("begin;")
    session.append("t", spark.createDataFrame([("n", 9)], "c string, a int"))
    assert session.sql("select count(*) as n from t;").rows() == [(3,)]
    session.sql("abort;")
    assert session.sql("select count(*) as n from t;").rows() == [(2,)]


def test_explain_of_semi_join_and_union(session):
    session.script("create table a (id int, v int); create table b (id int, w int);" + "".join(f"insert into a values ({i}, {i}); insert into b values ({i * 2}, {i});" for i in range(4)))
    assert session.execute("explain select a.v from a semi join b on a.id = b.id where a.v > 0;").splitlines() == [
        "Project(columns=[a.v], rows=1)", "\tSemiJoin(tables=[a, b], condition=[a.id=b.id], rows=1)", "\t\tProject(columns=[a.id, a.v], rows=3)",
        "\t\t\tFilter(condition=[a.v>0], rows=3)", "\t\t\t\tScan(table=a, type=SeqScan, rows=4)", "\t\tProject(columns=[b.id], rows=12)", "\t\t\tScan(table=b, type=SeqScan, rows=12)"]
    assert session.execute("explain select * from (select id from a union select id from b) u where id > 2 order by id limit 2;").splitlines() == [
        "Project(columns=[*], rows=2)", "\tFilter(condition=[u.id>2], rows=3)", "\t\tUnion(branches=2, rows=6)", "\t\t\tProject(columns=[a.id], rows=4)",
        "\t\t\t\tScan(table=a, type=SeqScan, rows=4)", "\t\t\tProject(columns=[b.id], rows=4)", "\t\t\t\tScan(table=b, type=SeqScan, rows=4)"]
    assert session.execute("explain select zz from a;") == session.execute("explain select id from nowhere;") == "failure\n"


def test_two_processes_do_not_overwrite_each_other(session, spark):
    session.script("create table t (a int);")
    other = Session(Database(spark, session.db.folder.path))
    session.sql("insert into t values (1);")
    assert other.execute("insert into t values (2);") == "abort\n"  # it hasn't seen the version that is there
    other.db.refresh()
    other.sql("insert into t values (2);")
    session.db.refresh()
    assert sorted(session.sql("select * from t;").rows()) == sorted(other.sql("select * from t;").rows()) == [(1,), (2,)]


def test_row_ids_stay_unique_after_a_restart(session, spark, tmp_path):
    (tmp_path / "in.csv").write_text("a\n" + "".join(f"{i}\n" for i in range(1500)))
    session.script(f"create table t (a int); load {tmp_path}/in.csv into t; insert into t values (5000);")
    again = Session(Database(spark, session.db.folder.path))
    again.sql("insert into t values (5001);")
    again.sql(f"load {tmp_path}/in.csv into t;")
    rows = again.db.rows(again.db.table("t"))
    assert rows.count() == rows.select(RID).distinct().count() == 3002
    assert again.db.next_rid < 1 << 45


def test_insert_and_delete_in_one_transaction(session):
    session.script("create table t (a int, b int); begin; insert into t values (1, 1); update t set b = 2 where a = 1; delete from t where b = 2; insert into t values (3, 3); commit; create static_checkpoint;")
    assert session.sql("select * from t;").rows() == [(3, 3)]
    session.script("begin; update t set b = 4; update t set b = 5; commit; create static_checkpoint; delete from t; create static_checkpoint; create static_checkpoint;")
    assert session.sql("select * from t;").rows() == []


def test_a_commit_writes_what_it_changes_and_not_all_files(session, spark, tmp_path, monkeypatch):
    from lattis.sources import storage

    monkeypatch.setattr(storage, "LISTED", 3)
    names = lambda kind: [n for n in session.db.folder.names() if n.startswith(kind)]
    session.sql("create table t (a int); ")
    session.sql("create table u (a int);")
    for k in range(6):
        session.append("t", spark.range(k * 100, k * 100 + 100, 1, 2).selectExpr("cast(id as int) as a"))
    assert len(names("files-")) >= 2
    lists = set(names("files-"))
    session.sql("insert into u values (1);")
    manifest = session.db.folder.read(max(names("manifest-")))
    assert set(names("files-")) == lists and manifest.count(".parquet") <= 2 * 3
    for k in range(5):
        session.sql(f"delete from t where a < {k * 100 + 50};")
        session.sql("create static_checkpoint;")
        again = Session(Database(spark, session.db.folder.path))
        want = [(600 - k * 100 - 50, k * 100 + 50, 599)]
        for s in (session, again):
            assert s.sql("select count(*) as n, min(a) as low, max(a) as high from t;").rows() == want
    used = {n for own in session.db._lists.values() for n in own}
    assert set(names("files-")) == used
    session.db.refresh()
    assert session.sql("select count(*) as n from t;").rows() == [(150,)]


def test_float_columns_keep_32_bits(session):
    """Keys, predicates and sums are those of the 32-bit numbers, before and after rows go to files."""
    session.script("create table t (id int, f float); create index t(f); insert into t values (1, 0.1);")
    for _ in range(2):
        assert session.execute("insert into t values (2, 0.10000000001);") == "failure\n"
        assert session.sql("select id from t where f = 0.1;").rows() == session.sql("select id from t where f <= 0.10000000001 and f >= 0.1;").rows() == [(1,)]
        session.sql("create static_checkpoint;")
    assert session.execute("insert into t values (3, 1e39);") == "failure\n"
    assert session.execute("select max(f) as m from t group by id having max(f) = 0.1;") == "| m |\n| 0.100000 |\n"
