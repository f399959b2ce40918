"""The driver's queries that run statements through sessions: changes, unique keys, listings, transactions, recovery, EXPLAIN.

Each loads whole tables of the driver's into a versioned database of its own, or makes a small one where the statements and
not the rows are the matter. Answers of statements are rows (step, answer); an oracle gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattis.frame import Frames
from lattis.render import HELP
from lattis.session import Session
from lattis.sources.parquet import read_table
from lattis.sources.scratch import scratch_path
from lattis.sources.storage import Database

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return add


def rows_sql(columns: str, rows: list[tuple]) -> str:
    """SQL for constant rows."""
    value = lambda v: str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return f"select * from (values {', '.join('(' + ', '.join(map(value, r)) + ')' for r in rows)}) as v({columns})"


def lines_of(spark: SparkSession, lines: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")


def new_session(spark: SparkSession) -> Session:
    return Session(Database(spark, scratch_path(spark, "db")))


def answers(spark: SparkSession, session: Session, texts: list[str]) -> DataFrame:
    return spark.createDataFrame([(i, session.execute(t).strip()) for i, t in enumerate(texts)], "step int, answer string")


#: Tables of the driver's as the dialect's types have them: INT and FLOAT of 32 bits.
ITEM = "select cast(p_partkey as int) as id, p_brand as brand, p_size as size, cast(p_retailprice as float) as price, cast(p_size as float) / cast(4 as float) as stock from part"


def items(spark: SparkSession, sf_dir: str) -> Session:
    """A session whose table item holds all rows of part."""
    session = new_session(spark)
    session.sql("create table item (id int, brand char(20), size int, price float, stock float);")
    part = read_table(spark, sf_dir, "part")
    session.append("item", part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), (F.col("p_size") / 4).alias("stock")))
    return session


# -- FLOAT: sums of 32-bit numbers in 64 bits are exact here, whatever their order --------------------------------------


@query(f"select sum(cast(price as double)) as total, avg(cast(price as double)) as mean, min(price) as low, max(price) as high from ({ITEM})")
def sum_avg_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).sql("select sum(price) as total, avg(price) as mean, min(price) as low, max(price) as high from item;").df


@query(f"select brand, sum(cast(price as double)) as total, avg(cast(stock as double)) as mean from ({ITEM}) group by brand having avg(cast(price as double)) > 1200.5 and min(stock) <= 0.25")
def group_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).sql("select brand, sum(price) as total, avg(stock) as mean from item group by brand having avg(price) > 1200.5 and min(stock) <= 0.25;").df


@query(f"select id, price from ({ITEM}) where price = cast(905.1 as float) or price >= cast(1999.9 as float)")
def filter_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A literal is compared as the 32-bit number that the column holds."""
    s = items(spark, sf_dir)
    return s.sql("select id, price from item where price = 905.1;").df.union(s.sql("select id, price from item where price >= 1999.9;").df)


@query(f"""select id, case when size > 30 then cast(price * cast(1.1 as float) as float) when size > 20 then cast(price / cast(-3 as float) as float)
 when size > 10 then price + cast(0.1 as float) else price - cast(1000000.3 as float) end as price,
 case when size > 30 then cast(size as float) when size > 20 then price when size > 10 then stock else cast(-1.5 as float) end as stock from ({ITEM})""")
def update_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLOAT arithmetic in 32 bits, an INT column into a FLOAT one, the old row's values, signed literals."""
    s = items(spark, sf_dir)
    for text in ("price = price * 1.1, stock = size where size > 30", "price = price / -3, stock = price where size > 20 and size <= 30", "price = price + 0.1 where size > 10 and size <= 20", "price = price - 1000000.3, stock = -1.5 where size <= 10"):
        s.sql(f"update item set {text};")
    return s.sql("select id, price, stock from item;").df


@query("select * from (values (0, ''), (1, 'failure'), (2, ''), (3, 'failure'), (4, '| n |\n| 1 |'), (5, 'failure'), (6, '')) as v(step, answer)")
def unique_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that are one in 32 bits are one key."""
    s = new_session(spark)
    s.script("create table t (id int, f float); create index t(f);")
    texts = ("insert into t values (1, 0.1);", "insert into t values (2, 0.10000000001);", "insert into t values (3, 0.2);", "update t set f = 0.10000000001 where id = 3;", "select count(*) as n from t where f = 0.1;", "update t set f = f + 0.1 where f = 0.1;", "update t set f = f + 0.2;")
    return answers(spark, s, list(texts))


# -- changes as statements ----------------------------------------------------------------------------------------------


def _modified(name: str, text: str, oracle: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = items(spark, sf_dir)
        s.sql(text)
        return s.sql("select id, brand, size from item;").df

    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, f"select id, brand, size from (select id, {oracle} from ({ITEM}))" if "size," not in oracle else oracle


for _name, _set, _sql in (("add", "size + 7", "size + 7"), ("sub", "size - 100", "size - 100"), ("mul", "size * 3", "size * 3"), ("div", "size / -7", "cast(trunc(size / -7) as int)"), ("literal", "-12", "-12"), ("col", "id", "id")):
    _modified(f"stmt_update_{_name}", f"update item set size = {_set} where size > 15;", f"brand, case when size > 15 then {_sql} else size end as size")
_modified("stmt_update_few", "update item set size = size + 1, brand = 'one' where id = 7;", "case when id = 7 then 'one' else brand end as brand, case when id = 7 then size + 1 else size end as size")


@query(f"select id, size from ({ITEM}) where not (size > 40 and price < 1500.0)")
def stmt_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = items(spark, sf_dir)
    s.sql("delete from item where size > 40 and price < 1500.0;")
    return s.sql("select id, size from item;").df


@query(f"select id, brand, size, price, stock from ({ITEM}) union all select 2000000000, 'New brand', -3, 0.5, 2.0")
def stmt_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = items(spark, sf_dir)
    s.sql("insert into item values (2000000000, 'New brand', -3, 0.5, 2);")
    return s.sql("select * from item;").df


# -- unique keys --------------------------------------------------------------------------------------------------------

_COUNT = "(select '| n |' || chr(10) || '| ' || count(*)::varchar || ' |' from part)"


@query(f"select * from (values (0, ''), (1, 'failure'), (2, 'failure'), (3, ''), (4, 'failure'), (5, 'failure'), (6, {_COUNT})) as v(step, answer)".replace("count(*)", "(count(*) + 1)"))
def unique_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key that is there, in files or among small changes, is refused; so are too few values and a second key list."""
    s = items(spark, sf_dir)
    return answers(spark, s, ["create index item(id);", "insert into item values (7, 'x', 1, 1.0, 1.0);", "insert into item values (7, 'x', 1, 1.0);", "insert into item values (2000000000, 'x', 1, 1.0, 1.0);", "insert into item values (2000000000, 'y', 1, 1.0, 1.0);", "create index item(id);", "select count(*) as n from item;"])


@query(f"select * from (values (0, ''), (1, 'failure'), (2, 'failure'), (3, ''), (4, ''), (5, '| low |' || chr(10) || '| ' || (select (min(p_partkey) + 1)::varchar from part) || ' |'), (6, 'failure'), (7, {_COUNT})) as v(step, answer)")
def unique_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys after the whole statement count: all may move by one, none may become another's."""
    s = items(spark, sf_dir)
    return answers(spark, s, ["create index item(id);", "update item set id = 8 where id = 7;", "update item set id = 3;", "update item set id = id + 1;", "update item set size = 3;", "select min(id) as low from item;", "update item set id = size where id > 5;", "select count(*) as n from item;"])


@query(f"select * from (values (0, ''), (1, ''), (2, 'failure'), (3, {_COUNT}), (4, 'failure')) as v(step, answer)")
def load_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LOAD into a table with a unique key: keys that are there, or twice in the file, are refused as a whole."""
    s, path, twice = new_session(spark), scratch_path(spark, "csv"), scratch_path(spark, "csv")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_size")
    part.write.csv(path, header=True)
    part.select(F.col("p_partkey") + 10_000_000, "p_size").union(part.filter("p_partkey = 7").select(F.lit(10_000_007), "p_size")).coalesce(1).write.csv(twice, header=True)
    s.sql("create table t (k int, size int);")
    return answers(spark, s, ["create index t(k);", f"load {path} into t;", f"load {path} into t;", "select count(*) as n from t;", f"load {twice} into t;"])


@query("select * from (values (1, 'a,b', cast(2.5 as float)), (2, '', cast(-1 as float)), (-2147483648, 'x y', cast(0.1 as float)), (2147483647, 'say \"no\"', cast(3 as float))) as v(a, c, f) union all select 0, bad, cast(0 as float) from (values ('failure')) as w(bad), range(6)")
def load_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV fields: quotes, commas in them, blanks around numbers, the ends of INT's range; what can't be read is refused."""
    s = new_session(spark)
    s.sql("create table t (a int, c char(8), f float);")

    def file(lines: list[str]) -> str:
        path = scratch_path(spark, "csv")
        spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1).write.text(path)
        return path

    s.sql(f"load {file(['h1,h2,h3', '1,"a,b",2.5', '', ' 2 ,, -1 ', '-2147483648,x y,0.1', '2147483647,"say ""no""",3'])} into t;")
    bad = ["2147483648,a,1", "1.5,a,1", "x,a,1", "1,a,", "1,far too long,1", "1,a,1x"]
    refused = [(0, s.execute(f"load {file(['a,c,f', line])} into t;").strip(), 0.0) for line in bad]
    return s.sql("select * from t;").df.union(spark.createDataFrame(refused, "a int, c string, f float"))


# -- listings and results as text ---------------------------------------------------------------------------------------


def listed(texts: list[str], then: list[str]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = new_session(spark)
        for t in texts:
            s.sql(t)
        return lines_of(spark, [x for t in then for x in s.execute(t).splitlines()])

    return run


_MADE = ["create table orders (o_id int, w_id int, note char(8), at datetime, price float);", "create table t (id int);", "create index orders(o_id, w_id);", "create index t(id);"]
for _name, _texts, _then, _lines in (
    ("show_tables", _MADE, ["show tables;"], ["| Tables |", "| orders |", "| t |"]),
    ("show_index", _MADE, ["show index from orders;", "show index from t;"], ["| orders | unique | (o_id,w_id) |", "| t | unique | (id) |"]),
    ("describe", _MADE, ["desc orders;"], ["| Field | Type | Index |", "| o_id | INT | YES |", "| w_id | INT | YES |", "| note | STRING | NO |", "| at | STRING | NO |", "| price | FLOAT | NO |"]),
    ("drop_table", [*_MADE, "drop table orders;"], ["show tables;", "select * from orders;", "drop table orders;", "create table orders (a int);", "show tables;"], ["| Tables |", "| t |", "failure", "failure", "| Tables |", "| t |", "| orders |"]),
    ("drop_index", [*_MADE, "insert into t values (1);", "drop index t(id);"], ["insert into t values (1);", "select count(*) as n from t;", "show index from t;", "drop index t(id);", "create index t(id);"], ["| n |", "| 2 |", "failure", "failure"]),
    ("help_text", [], ["help;"], HELP.splitlines()),
    ("illegal_statements", ["create table g (course char(8), id int, score float);", "insert into g values ('a', 1, 2.5);"],
     ["select id, score from g group by course;", "select id, max(score) as m from g group by course;", "select * from g group by id;", "select sum(course) as s from g;", "select id from g where course = 1;", "select nothing from g;", "select id from g order by nothing;", "insert into g values ('123456789', 1, 1.0);", "create table g (a int);", "select id from g where score > 'x';", "update g set id = 1.5;", "update g set id = id / 0;", "select course, count(*) as n from g group by course;"],
     [*["failure"] * 12, "| course | n |", "| a | 1 |"]),
    ("aggregate_captions", ["create table g (id int, score float);", "insert into g values (1, 2.5);", "insert into g values (4, 90);"], ["select count(*), count(id), max(id), min(score), sum(id), avg(score) from g;", "select id, max(score) from g group by id order by id;"],
     ["| count | count | max | min | sum | avg |", "| 2 | 2 | 4 | 2.500000 | 5 | 46.250000 |", "| id | max |", "| 1 | 2.500000 |", "| 4 | 90.000000 |"]),
):
    QUERIES[_name], ORACLES[_name] = listed(_texts, _then), rows_sql("line_no, line", list(enumerate(_lines)))


@query("""with c as (select row_number() over (order by c_custkey) as r, lpad(c_custkey::varchar, 16, ' ') as a, lpad(case when length(c_name) > 16 then c_name[1:13] || '...' else c_name end, 16, ' ') as b,
 lpad(printf('%.6f', c_acctbal), 16, ' ') as f from customer where c_nationkey = 3), k as (select count(*) as n from c), rule as (select '+------------------+------------------+------------------+' as line)
 select 0::int as line_no, line from rule union all select 1, '|        c_custkey |           c_name |        c_acctbal |' union all select 2, line from rule
 union all select (r + 2)::int, '| ' || a || ' | ' || b || ' | ' || f || ' |' from c union all select (n + 3)::int, line from rule, k union all select (n + 4)::int, 'Total record(s): ' || n from k""")
def client_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The client's table: cells of 16 characters, longer ones end in dots."""
    from lattis.render import cells
    from lattis.render import client_table as table

    q = Frames.read(spark, sf_dir, "customer").query("select c_custkey, c_name, c_acctbal from customer where c_nationkey = 3 order by c_custkey")
    return lines_of(spark, table(q.captions, cells(q)).split("\n"))


@query("select 0 as line_no, '| s_name | s_acctbal |' as line union all select (row_number() over (order by s_suppkey))::int, '| ' || s_name || ' | ' || printf('%.6f', s_acctbal) || ' |' from supplier")
def output_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of output.txt."""
    from lattis.render import output_lines as made

    return lines_of(spark, made(Frames.read(spark, sf_dir, "supplier").query("select s_name, s_acctbal from supplier order by s_suppkey")))


@query(f"select id, size from ({ITEM}) where size >= 45")
def persisted_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result kept in the executors, read twice."""
    kept = items(spark, sf_dir).sql("select id, size from item where size >= 45;").persist()
    assert kept.df.count() == len(kept.rows())
    return kept.df


@query(rows_sql("line_no, line", [(0, "price"), (1, "brand"), (2, "id")]))
def advised_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that files should be sorted by: those of unique keys, then those that queries look up most."""
    s = items(spark, sf_dir)
    for _ in range(5):
        s.sql("select id from item where brand = 'Brand#11' and size > 3;")
    for _ in range(9):
        s.sql("select id from item where price = 901.0;")
    free = s.db.advisor.sort_columns("item", ())
    s.sql("create index item(id);")
    s.sql("create static_checkpoint;")
    return lines_of(spark, [*free, s.db.advisor.sort_columns("item", s.db.table("item").indexes)[0]])


# -- transactions -------------------------------------------------------------------------------------------------------


def two(spark: SparkSession, made: str, level: str = "snapshot isolation") -> tuple[Session, Session]:
    a = new_session(spark)
    a.script(made)
    b = Session(a.db)
    for s in (a, b):
        s.sql(f"set transaction isolation level {level};")
    return a, b


def turns(spark: SparkSession, sessions: tuple[Session, Session], texts: list[tuple[int, str]]) -> DataFrame:
    """The answers of statements that the sessions run in turn."""
    return spark.createDataFrame([(i, "ab"[k], sessions[k].execute(t).strip()) for i, (k, t) in enumerate(texts)], "step int, who string, answer string")


def _dialogue(name: str, made: str, level: str, texts: list[tuple[int, str, str]]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return turns(spark, two(spark, made, level), [t[:2] for t in texts])

    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, rows_sql("step, who, answer", [(i, "ab"[k], a) for i, (k, _, a) in enumerate(texts)])


_ACCOUNT = "create table account (id int, balance int); insert into account values (1, 100); insert into account values (2, 200);"
_dialogue("error_aborts", _ACCOUNT, "snapshot isolation", [
    (0, "begin;", ""), (0, "update account set balance = 5 where id = 1;", ""), (0, "insert into account values ('x', 1);", "abort"),
    (0, "select balance from account where id = 1;", "| balance |\n| 100 |"), (0, "insert into account values ('x', 1);", "failure"),
    (0, "begin;", ""), (0, "delete from account;", ""), (0, "abort;", ""), (1, "select count(*) as n from account;", "| n |\n| 2 |"),
])
_dialogue("logical_key", _ACCOUNT, "snapshot isolation", [
    (0, "begin;", ""), (1, "begin;", ""), (0, "insert into account values (7, 7);", ""), (1, "insert into account values (7, 8);", "abort"), (0, "commit;", ""),
    (1, "select balance from account where id = 7;", "| balance |\n| 7 |"),
])
_dialogue("first_updater_wins", _ACCOUNT, "snapshot isolation", [
    (0, "begin;", ""), (1, "begin;", ""), (0, "update account set balance = 1 where id = 1;", ""), (1, "update account set balance = 2 where id = 2;", ""), (1, "update account set balance = 2 where id = 1;", "abort"),
    (0, "commit;", ""), (1, "begin;", ""), (0, "delete from account where id = 2;", ""), (1, "delete from account where id = 2;", "abort"), (1, "select id, balance from account order by id;", "| id | balance |\n| 1 | 1 |"),
])
_dialogue("snapshot_and_own_writes", _ACCOUNT, "snapshot isolation", [
    (0, "begin;", ""), (0, "select count(*) as n from account;", "| n |\n| 2 |"), (1, "begin;", ""), (1, "insert into account values (3, 300);", ""), (1, "select count(*) as n from account;", "| n |\n| 3 |"),
    (0, "select count(*) as n from account;", "| n |\n| 2 |"), (1, "commit;", ""), (0, "select count(*) as n from account;", "| n |\n| 2 |"), (0, "commit;", ""), (0, "select sum(balance) as s from account;", "| s |\n| 600 |"),
])
_dialogue("write_skew_float", "create table duty (id int, here float); insert into duty values (1, 0.1); insert into duty values (2, 0.1);", "serializable", [
    (0, "begin;", ""), (1, "begin;", ""), (0, "select id from duty where here = 0.1 and id = 2;", "| id |\n| 2 |"), (1, "select id from duty where here = 0.1 and id = 1;", "| id |\n| 1 |"),
    (0, "update duty set here = 0 where id = 1;", ""), (1, "update duty set here = 0 where id = 2;", "abort"), (0, "commit;", ""), (1, "select count(*) as n from duty where here = 0.1;", "| n |\n| 1 |"),
])
_dialogue("phantoms", "create table t (k int, v int); insert into t values (1, 1);", "serializable", [
    (0, "begin;", ""), (1, "begin;", ""), (0, "select count(*) as n from t where v > 50;", "| n |\n| 0 |"), (1, "select count(*) as n from t where v > 50;", "| n |\n| 0 |"),
    (0, "insert into t values (2, 60);", ""), (1, "insert into t values (3, 60);", "abort"), (0, "commit;", ""), (1, "select count(*) as n from t where v > 50;", "| n |\n| 1 |"),
])


@query(rows_sql("step, what, n", [(0, "manifests", 1), (1, "small changes", 0), (2, "unused folders", 0)]) + f" union all select 3, 'rows', count(*) from ({ITEM}) where size <> 3 union all select 4, 'rows in its snapshot', count(*) + 1 from part")
def checkpoint_and_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checkpoint folds small changes into files; versions and files that nobody reads any more are removed."""
    s = items(spark, sf_dir)
    s.sql("insert into item values (2000000000, 'x', 1, 1.0, 1.0);")
    reader = Session(s.db)
    reader.sql("begin;")
    s.sql("delete from item where id = 2000000000;")
    s.sql("delete from item where size = 3;")
    s.sql("create static_checkpoint;")
    seen = reader.sql("select count(*) as n from item;").rows()[0][0]  # its version is still there
    reader.sql("commit;")
    s.sql("create static_checkpoint;")
    t, names = s.db.table("item"), s.db.folder.names()
    used = {f.rsplit("/", 2)[-2] for f in t.files}
    out = [(0, "manifests", sum(n.startswith("manifest-") for n in names)), (1, "small changes", len(t.rows) + len(t.gone)), (2, "unused folders", sum(n.startswith("data-") and n not in used for n in names)), (3, "rows", s.sql("select count(*) as n from item;").rows()[0][0]), (4, "rows in its snapshot", seen)]
    return spark.createDataFrame(out, "step int, what string, n long")


@query(f"select id, case when size > 30 then size + 1 else size end as size from ({ITEM}) where id <> 9 union all select 2000000000, 5")
def recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was committed is there after a crash; an open transaction's changes, a torn manifest and stray files aren't."""
    s = items(spark, sf_dir)
    s.script("update item set size = size + 1 where size > 30; delete from item where id = 9; insert into item values (2000000000, 'x', 5, 1.0, 1.0);")
    Session(s.db).script("begin; update item set size = 0; insert into item values (2000000001, 'x', 5, 1.0, 1.0); crash;")
    last = max(n for n in s.db.folder.names() if n.startswith("manifest-"))
    s.db.folder.write_new("manifest-999999999999.json", s.db.folder.read(last)[:40])
    spark.range(3).write.parquet(f"{s.db.folder.path}/data-stray")
    again = Database(spark, s.db.folder.path)
    assert "data-stray" not in again.folder.names()
    return Session(again).sql("select id, size from item;").df


# -- EXPLAIN ------------------------------------------------------------------------------------------------------------


def explained(name: str, tables: str, text: str, lines: str, indexes: dict[str, list[list[str]]] | None = None) -> None:
    """EXPLAIN of text; lines: SQL expressions of its lines over a row n with the counts that `counts` gives."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return lines_of(spark, Frames.read(spark, sf_dir, *tables.split(), indexes=indexes).explain(text))

    run.__name__ = name
    QUERIES[name] = run
    counts, _, exprs = lines.partition("|||")
    parts = [x.strip() for x in exprs.strip().split("\n")]
    tabbed = lambda x: " || ".join([*(["chr(9)"] * (len(x) - len(x.lstrip(">")))), *(f"'{y}'" if k % 2 == 0 else f"({y})::varchar" for k, y in enumerate(x.lstrip(">").split("$")))])
    ORACLES[name] = f"with n as (select {counts.strip()}) " + " union all ".join(f"select {k} as line_no, {tabbed(x)} as line from n" for k, x in enumerate(parts))


explained("explain_scan", "orders", "select o_orderkey from orders where o_orderstatus = 'F' and o_custkey < o_orderkey limit 12", """
 (select count(*) from orders) as t, (select count(*) from orders where o_orderstatus = 'F' and o_custkey < o_orderkey) as f
 |||Project(columns=[orders.o_orderkey], rows=$least(f, 12)$)
 >Filter(condition=[orders.o_custkey<orders.o_orderkey, orders.o_orderstatus=''F''], rows=$f$)
 >>Scan(table=orders, type=SeqScan, rows=$t$)""")
explained("explain_join", "customer orders", "select customer.c_name from customer join orders on customer.c_custkey = orders.o_custkey where customer.c_acctbal > 100.0", """
 (select count(*) from customer) as t, (select count(*) from customer where c_acctbal > 100) as f, (select count(*) from customer join orders on c_custkey = o_custkey where c_acctbal > 100) as j
 |||Project(columns=[customer.c_name], rows=$j$)
 >Join(tables=[customer, orders], condition=[customer.c_custkey=orders.o_custkey], rows=$j$)
 >>Project(columns=[customer.c_custkey, customer.c_name], rows=$f$)
 >>>Filter(condition=[customer.c_acctbal>100.000000], rows=$f$)
 >>>>Scan(table=customer, type=SeqScan, rows=$t$)
 >>Project(columns=[orders.o_custkey], rows=$j$)
 >>>Scan(table=orders, type=IndexScan, using_index=(o_custkey), rows=$j$)""", {"orders": [["o_custkey"]]})
explained("explain_three", "region nation supplier", "select s.s_name, n.n_name from nation n join region r on n.n_regionkey = r.r_regionkey join supplier s on n.n_nationkey = s.s_nationkey where n.n_nationkey < 9", """
 (select count(*) from nation) as t1, (select count(*) from nation where n_nationkey < 9) as f1, (select count(*) from region) as t2, (select count(*) from nation join region on n_regionkey = r_regionkey where n_nationkey < 9) as j2,
 (select count(*) from supplier) as t3, (select count(*) from supplier where s_nationkey < 9) as f3, (select count(*) from nation join region on n_regionkey = r_regionkey join supplier on n_nationkey = s_nationkey where n_nationkey < 9) as j3
 |||Project(columns=[n.n_name, s.s_name], rows=$j3$)
 >Join(tables=[nation, region, supplier], condition=[n.n_nationkey=s.s_nationkey], rows=$j3$)
 >>Join(tables=[nation, region], condition=[n.n_regionkey=r.r_regionkey], rows=$j2$)
 >>>Project(columns=[n.n_name, n.n_nationkey, n.n_regionkey], rows=$f1$)
 >>>>Filter(condition=[n.n_nationkey<9], rows=$f1$)
 >>>>>Scan(table=nation, type=SeqScan, rows=$t1$)
 >>>Project(columns=[r.r_regionkey], rows=$t2 * f1$)
 >>>>Scan(table=region, type=SeqScan, rows=$t2 * f1$)
 >>Project(columns=[s.s_name, s.s_nationkey], rows=$f3 * j2$)
 >>>Filter(condition=[s.s_nationkey<9], rows=$f3 * j2$)
 >>>>Scan(table=supplier, type=SeqScan, rows=$t3 * j2$)""")
explained("explain_product", "region nation", "select * from nation, region", """
 (select count(*) from nation) as a, (select count(*) from region) as b
 |||Project(columns=[*], rows=$a * b$)
 >Scan(table=nation, type=SeqScan, rows=$a$)
 >Scan(table=region, type=SeqScan, rows=$a * b$)""")
explained("explain_semi", "customer orders", "select c_name from customer semi join orders on c_custkey = o_custkey where c_nationkey = 5", """
 (select count(*) from customer) as t, (select count(*) from customer where c_nationkey = 5) as f, (select count(*) from orders) as o, (select count(*) from customer where c_nationkey = 5 and c_custkey in (select o_custkey from orders)) as s
 |||Project(columns=[customer.c_name], rows=$s$)
 >SemiJoin(tables=[customer, orders], condition=[customer.c_custkey=orders.o_custkey], rows=$s$)
 >>Project(columns=[customer.c_custkey, customer.c_name], rows=$f$)
 >>>Filter(condition=[customer.c_nationkey=5], rows=$f$)
 >>>>Scan(table=customer, type=SeqScan, rows=$t$)
 >>Project(columns=[orders.o_custkey], rows=$o * f$)
 >>>Scan(table=orders, type=SeqScan, rows=$o * f$)""")
explained("explain_union", "customer supplier", "select * from (select c_nationkey from customer union select s_nationkey from supplier where s_acctbal < 0.0) u where c_nationkey > 20 limit 3", """
 (select count(*) from customer) as t1, (select count(*) from supplier) as t2, (select count(*) from supplier where s_acctbal < 0) as f2, (select count(*) from (select c_nationkey from customer union select s_nationkey from supplier where s_acctbal < 0)) as u, (select count(*) from (select c_nationkey as k from customer union select s_nationkey from supplier where s_acctbal < 0) where k > 20) as f
 |||Project(columns=[*], rows=$least(f, 3)$)
 >Filter(condition=[u.c_nationkey>20], rows=$f$)
 >>Union(branches=2, rows=$u$)
 >>>Project(columns=[customer.c_nationkey], rows=$t1$)
 >>>>Scan(table=customer, type=SeqScan, rows=$t1$)
 >>>Project(columns=[supplier.s_nationkey], rows=$f2$)
 >>>>Filter(condition=[supplier.s_acctbal<0.000000], rows=$f2$)
 >>>>>Scan(table=supplier, type=SeqScan, rows=$t2$)""")
