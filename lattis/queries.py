"""The engine's queries over the driver's tables, one or more for each operator, each with its SQL for DuckDB.

Most are texts of the dialect run on DataFrames (lattis.frame); the others call the operators. All of them read whole
tables; a limit stands only where the limit is the operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattis.frame import Frames
from lattis.operators import Change, cross_join, delete_rows, duplicate_keys, equi_join, semi_join, theta_join, update_rows
from lattis.operators.extensions import anti_join, count_distinct, outer_join, rank_within, rollup_counts
from lattis.sources.parquet import read_table
from lattis.streaming import windowed_counts
from lattis.types import BIGINT, DOUBLE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def dialect(name: str, tables: str, text: str, oracle: str | None = None, hint: str | None = None) -> None:
    """A query in the dialect; the same text is its SQL unless another is given."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Frames.read(spark, sf_dir, *tables.split(), hint=hint).sql(text)

    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, oracle or text


def query(oracle: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# -- scans and projections --------------------------------------------------------------------------------------------

dialect("scan_all", "customer", "select * from customer")
dialect("project_reorder", "lineitem", "select l_linenumber, l_orderkey, l_returnflag from lineitem")
dialect("project_alias", "part", "select p_partkey as k, p_brand as brand from part")
dialect("scan_all_datetime", "orders", "select * from orders")
dialect("filter_datetime", "events", "select * from events where ts >= '2023-01-01 00:00:00' and event_type <> 'click'")
dialect("min_max_datetime", "lineitem", "select l_returnflag, min(l_shipdate) as first, max(l_shipdate) as last from lineitem group by l_returnflag")
dialect("scan_opaque", "embeddings", "select label, count(*) as n, count(embedding) as m from embeddings group by label")
dialect("scan_pruned", "lineitem", "select l_orderkey, l_quantity from lineitem where l_quantity > 49.0")


# -- filters ----------------------------------------------------------------------------------------------------------

for _name, _op in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("gt", ">"), ("le", "<="), ("ge", ">=")):
    dialect(f"filter_{_name}", "part", f"select p_partkey, p_size from part where p_size {_op} 25")
dialect("filter_and", "lineitem", "select l_orderkey, l_linenumber, l_discount from lineitem where l_quantity < 24.0 and l_discount >= 0.05 and l_returnflag = 'R'")
dialect("filter_string_range", "customer", "select c_custkey, c_mktsegment from customer where c_mktsegment >= 'B' and c_mktsegment < 'G'")
dialect("filter_col_col", "lineitem", "select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem where l_partkey > l_suppkey")
dialect("filter_negative", "customer", "select c_custkey, c_acctbal from customer where c_acctbal < -500.0")
dialect("point_lookup", "orders", "select o_orderkey, o_custkey, o_orderstatus from orders where o_orderkey = 77")


# -- joins ------------------------------------------------------------------------------------------------------------

dialect("cross_join", "region nation", "select r_name, n_name from region, nation")
dialect("join_without_on", "region nation", "select r_regionkey, n_nationkey from region join nation", "select r_regionkey, n_nationkey from region cross join nation")
dialect("equi_join", "customer orders", "select c_custkey, c_mktsegment, o_orderkey, o_orderstatus from customer join orders on c_custkey = o_custkey")
for _name, _hint in (("merge", "MERGE"), ("hash", "SHUFFLE_HASH"), ("broadcast", "BROADCAST")):
    dialect(f"join_hint_{_name}", "supplier nation", "select s_suppkey, n_name from supplier join nation on s_nationkey = n_nationkey where s_acctbal > 0.0", hint=_hint)
dialect("theta_join", "nation region", "select n_nationkey, r_regionkey from nation join region on n_regionkey < r_regionkey")
dialect("join_residual", "nation supplier", "select n_name, s_suppkey from nation join supplier on n_nationkey = s_nationkey and n_regionkey < s_nationkey")
dialect("join_multi_cond", "lineitem orders", "select l_orderkey, l_linenumber, o_custkey from orders join lineitem on o_orderkey = l_orderkey and o_custkey = l_suppkey")
dialect("comma_join", "nation region", "select n_name, r_name from nation, region where n_regionkey = r_regionkey and r_regionkey >= 2")
dialect("join_right_filter", "customer orders", "select c_custkey, o_orderkey from customer join orders on o_custkey = c_custkey where o_totalprice > 100000.0")
dialect("self_join", "nation", "select a.n_name as left_name, b.n_name as right_name from nation a join nation b on a.n_regionkey = b.n_regionkey where a.n_nationkey < b.n_nationkey")
dialect("three_way_join", "customer nation region", "select c_custkey, n_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
dialect(
    "five_way_join", "region nation customer orders lineitem",
    "select r_name, o_orderkey, l_linenumber from region join nation on r_regionkey = n_regionkey join customer on n_nationkey = c_nationkey join orders on c_custkey = o_custkey join lineitem on o_orderkey = l_orderkey where l_returnflag = 'A' and r_regionkey = 1",
)
dialect("filter_propagation", "orders lineitem", "select o_orderkey, l_linenumber, l_partkey from orders join lineitem on o_orderkey = l_orderkey where o_orderkey < 500")
dialect("semi_join", "customer orders", "select c_custkey, c_name from customer semi join orders on c_custkey = o_custkey", "select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey)")
dialect("semi_join_filtered", "customer orders", "select * from customer semi join orders on c_custkey = o_custkey where c_acctbal > 5000.0", "select * from customer where exists (select 1 from orders where o_custkey = c_custkey) and c_acctbal > 5000.0")
dialect("semi_join_theta", "nation region", "select n_name from nation semi join region on n_regionkey < r_regionkey", "select n_name from nation where exists (select 1 from region where n_regionkey < r_regionkey)")


@query("select c_custkey, o_orderkey from customer join orders on c_custkey = o_custkey and c_acctbal < o_totalprice")
def op_equi_join_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equi_join(read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "orders"), [("c_custkey", "o_custkey")], F.col("c_acctbal") < F.col("o_totalprice")).select("c_custkey", "o_orderkey")


@query("select s_suppkey, r_name from supplier cross join region")
def op_cross_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_join(read_table(spark, sf_dir, "supplier"), read_table(spark, sf_dir, "region")).select("s_suppkey", "r_name")


@query("select s_suppkey, n_nationkey from supplier join nation on s_nationkey > n_nationkey")
def op_theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return theta_join(read_table(spark, sf_dir, "supplier"), read_table(spark, sf_dir, "nation"), F.col("s_nationkey") > F.col("n_nationkey")).select("s_suppkey", "n_nationkey")


@query("select p_partkey from part where exists (select 1 from lineitem where l_partkey = p_partkey)")
def op_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semi_join(read_table(spark, sf_dir, "part"), read_table(spark, sf_dir, "lineitem"), F.col("p_partkey") == F.col("l_partkey")).select("p_partkey")


# -- aggregates -------------------------------------------------------------------------------------------------------

dialect("count_star", "lineitem", "select count(*) as n from lineitem")
dialect("count_col", "orders", "select count(o_orderkey) as n from orders where o_orderstatus = 'F'")
dialect("count_range", "orders", "select count(*) as n from orders where o_orderkey > 100 and o_orderkey <= 900")
dialect("sum_int", "part", "select sum(p_size) as total from part", "select cast(sum(p_size) as bigint) as total from part")
dialect("sum_bigint", "orders", "select max(o_totalprice) as top, sum(o_custkey) as keys from orders", "select max(o_totalprice) as top, cast(sum(o_custkey) as bigint) as keys from orders")
dialect("sum_avg_double", "lineitem", "select l_returnflag, sum(l_quantity) as total, avg(l_quantity) as mean from lineitem group by l_returnflag")
dialect("avg_int", "part", "select avg(p_size) as mean from part where p_size > 10")
dialect("min_max", "supplier", "select min(s_acctbal) as low, max(s_acctbal) as high, min(s_name) as first, max(s_name) as last from supplier")
dialect("min_prefix", "lineitem", "select min(l_linenumber) as low from lineitem where l_orderkey = 33")
dialect("agg_empty_zero", "part", "select count(*) as n, sum(p_size) as s, min(p_size) as low, max(p_brand) as top, avg(p_size) as mean from part where p_size > 1000", "select count(*) as n, cast(coalesce(sum(p_size), 0) as bigint) as s, coalesce(min(p_size), 0) as low, coalesce(max(p_brand), '') as top, coalesce(avg(p_size), 0.0) as mean from part where p_size > 1000")
dialect("group_by", "lineitem", "select l_returnflag, count(*) as n, min(l_quantity) as low, max(l_extendedprice) as high from lineitem group by l_returnflag")
dialect("group_by_multi", "lineitem", "select l_returnflag, l_linestatus, count(*) as n, sum(l_linenumber) as lines from lineitem group by l_returnflag, l_linestatus", "select l_returnflag, l_linestatus, count(*) as n, cast(sum(l_linenumber) as bigint) as lines from lineitem group by l_returnflag, l_linestatus")
dialect("group_without_agg", "part", "select p_brand from part group by p_brand")
dialect("having", "orders", "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12")
dialect("having_hidden_agg", "orders", "select o_custkey, max(o_totalprice) as top from orders group by o_custkey having count(*) >= 10 and min(o_totalprice) < 5000")
dialect("join_group_having", "customer orders", "select c_mktsegment, count(*) as n, max(o_totalprice) as top from customer join orders on c_custkey = o_custkey where o_totalprice > 1000.0 group by c_mktsegment having count(*) > 1 order by c_mktsegment", "select c_mktsegment, count(*) as n, max(o_totalprice) as top from customer join orders on c_custkey = o_custkey where o_totalprice > 1000.0 group by c_mktsegment having count(*) > 1")
dialect("shared_aggregates", "part", "select p_brand, count(*) as a, count(p_size) as b, max(p_size) as c from part group by p_brand having max(p_size) > 10")
dialect("group_order_limit", "orders", "select o_custkey, count(*) as n from orders group by o_custkey order by o_custkey limit 7", "select o_custkey, count(*) as n from orders group by o_custkey order by o_custkey limit 7")
dialect("group_order_by_first_row", "orders", "select o_orderpriority, count(*) as n from orders group by o_orderpriority order by o_orderkey desc limit 3", "select o_orderpriority, n from (select o_orderpriority, count(*) as n, max(o_orderkey) as k from orders group by o_orderpriority) order by k desc limit 3")
dialect("group_order_mixed", "orders", "select o_orderstatus, count(*) as n from orders group by o_orderstatus order by o_orderpriority desc, o_orderkey limit 2", "select o_orderstatus, n from (select o_orderstatus, count(*) over (partition by o_orderstatus) as n, row_number() over (partition by o_orderstatus order by o_orderpriority desc, o_orderkey) as first, row_number() over (order by o_orderpriority desc, o_orderkey) as place from orders) where first = 1 order by place limit 2")
dialect("group_order_by_agg_and_column", "orders", "select o_custkey, count(*) as n from orders group by o_custkey order by n desc, o_orderkey limit 9", "select o_custkey, n from (select o_custkey, count(*) as n, min(o_orderkey) as k from orders group by o_custkey) order by n desc, k limit 9")
dialect("group_order_by_agg", "customer", "select c_mktsegment, count(*) as n from customer group by c_mktsegment order by n desc, c_mktsegment limit 3")


@query("""select l_returnflag, l_linestatus, cast(sum(cast(l_quantity as decimal(18, 2))) as double) as sum_qty,
 cast(sum(cast(l_extendedprice as decimal(18, 2))) as double) as sum_price, avg(l_linenumber) as avg_line, count(*) as n
 from lineitem group by l_returnflag, l_linestatus""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    money = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    df = read_table(spark, sf_dir, "lineitem")
    return df.groupBy("l_returnflag", "l_linestatus").agg(money("l_quantity").alias("sum_qty"), money("l_extendedprice").alias("sum_price"), F.avg("l_linenumber").alias("avg_line"), F.count(F.lit(1)).alias("n"))


# -- sorting and limits -----------------------------------------------------------------------------------------------

dialect("order_by", "customer", "select c_custkey, c_mktsegment, c_acctbal from customer order by c_mktsegment, c_acctbal desc, c_custkey")
dialect("order_by_hidden_key", "supplier", "select s_name from supplier order by s_acctbal desc, s_suppkey limit 5")
dialect("top_k", "orders", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
dialect("limit_zero", "region", "select r_name from region limit 0")
dialect("limit_all", "region", "select r_name from region order by r_name limit 100")
dialect("order_by_alias", "part", "select p_size as size, p_partkey as k from part order by size, k limit 12")


# -- set operations ---------------------------------------------------------------------------------------------------

dialect("union_distinct", "customer supplier", "select * from (select c_nationkey from customer union select s_nationkey from supplier) as u", "select c_nationkey from customer union select s_nationkey from supplier")
dialect("union_promote", "part supplier", "select * from (select p_size from part union select s_acctbal from supplier) as u", "select cast(p_size as double) as p_size from part union select s_acctbal from supplier")
dialect("union_order", "region nation", "select * from (select r_name from region union select n_name from nation union select r_name from region) as u order by r_name desc limit 8", "select r_name from (select r_name from region union select n_name from nation) order by r_name desc limit 8")
dialect("union_outer_filter", "customer supplier", "select n from (select c_nationkey as n, c_custkey as k from customer union select s_nationkey, s_suppkey from supplier) as u where n > 20 and k < 50", "select n from (select c_nationkey as n, c_custkey as k from customer union select s_nationkey, s_suppkey from supplier) where n > 20 and k < 50")
dialect("union_aggregate_branch", "customer supplier", "select * from (select c_nationkey, count(*) as n from customer group by c_nationkey union select s_nationkey, count(*) as n from supplier group by s_nationkey) as u", "select c_nationkey, count(*) as n from customer group by c_nationkey union select s_nationkey, count(*) from supplier group by s_nationkey")


# -- changes ----------------------------------------------------------------------------------------------------------


def _updated(name: str, table: str, where: str, change: Change, oracle: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return update_rows(read_table(spark, sf_dir, table), F.expr(where), [change])

    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, oracle


_S = "select s_suppkey, s_name, s_nationkey, case when s_nationkey > 12 then {} else s_acctbal end as s_acctbal from supplier"
_updated("update_literal", "supplier", "s_nationkey > 12", Change("s_acctbal", DOUBLE, value=1.5), _S.format("1.5"))
_O = "select o_orderkey, case when o_orderstatus = 'F' then {} else o_custkey end as o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders"
for _name, _op, _value, _sql in (("add", "+", 7, "o_custkey + 7"), ("sub", "-", 1000, "o_custkey - 1000"), ("mul", "*", 3, "o_custkey * 3"), ("div", "/", -7, "o_custkey // -7")):
    _updated(f"update_{_name}", "orders", "o_orderstatus = 'F'", Change("o_custkey", BIGINT, "o_custkey", BIGINT, _op, _value), _O.format(_sql if _name != "div" else "cast(trunc(o_custkey / -7) as bigint)"))
_updated("update_col", "orders", "o_orderstatus = 'F'", Change("o_custkey", BIGINT, "o_orderkey", BIGINT), _O.format("o_orderkey"))


@query("select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer where not (c_acctbal < 0 and c_nationkey >= 5)")
def delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delete_rows(read_table(spark, sf_dir, "customer"), (F.col("c_acctbal") < 0) & (F.col("c_nationkey") >= 5))


@query("select o_orderkey as k, case when o_orderkey < 100 then o_custkey + 1 else o_custkey end as a, case when o_orderkey < 100 then o_custkey else o_orderkey end as b from orders")
def update_reads_old_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b"))
    return update_rows(df, F.col("k") < 100, [Change("a", BIGINT, "a", BIGINT, "+", 1), Change("b", BIGINT, "a", BIGINT)])


@query("select l_orderkey, count(*) as n from lineitem group by l_orderkey having count(*) > 1")
def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_keys(read_table(spark, sf_dir, "lineitem"), ["l_orderkey"])


@query("select o_orderkey, o_custkey from orders where exists (select 1 from customer where c_custkey = o_custkey and c_acctbal > 9000)")
def unique_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probe of many new keys against a table, as an insert does it."""
    new = read_table(spark, sf_dir, "customer").filter("c_acctbal > 9000").select("c_custkey")
    return semi_join(read_table(spark, sf_dir, "orders"), new, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey")


@query("select n_nationkey, n_name, n_regionkey from nation")
def load_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as CSV to the session's scratch folder and loaded with the types it had."""
    from lattis.sources.csv import read_csv
    from lattis.sources.scratch import scratch_path
    from lattis.types import INT, SqlType

    path = scratch_path(spark, "csv")
    read_table(spark, sf_dir, "nation").write.csv(path, header=True)
    return read_csv(spark, path, {"n_nationkey": INT, "n_name": SqlType("CHAR", 25), "n_regionkey": INT})


@query("select 0 as line_no, 'Project(columns=[customer.c_custkey, orders.o_orderkey], rows=' || count(*) || ')' as line from customer join orders on c_custkey = o_custkey where o_orderkey < 1000")
def explain_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = Frames.read(spark, sf_dir, "customer", "orders").explain("select customer.c_custkey, orders.o_orderkey from customer join orders on customer.c_custkey = orders.o_custkey where orders.o_orderkey < 1000")
    return spark.createDataFrame([(0, lines[0])], "line_no int, line string")


@query("select o_orderkey, 'balance ' || printf('%.6f', cast(o_totalprice as double)) as line from orders")
def float_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattis.functions import float_text

    return read_table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("balance "), float_text(F.col("o_totalprice"))).alias("line"))


# -- versioned tables and transactions --------------------------------------------------------------------------------


def _session(spark: SparkSession):
    from lattis.session import Session
    from lattis.sources.scratch import scratch_path
    from lattis.sources.storage import Database

    return Session(Database(spark, scratch_path(spark, "db")))


def _loaded(spark: SparkSession, sf_dir: str, **more: Column):
    """A session whose table part has p_partkey, p_size and p_brand of the driver's, and strings of more."""
    from lattis.sources.scratch import scratch_path

    session, path = _session(spark), scratch_path(spark, "csv")
    read_table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int"), "p_size", "p_brand", *[c.alias(n) for n, c in more.items()]).write.csv(path, header=True)
    session.sql(f"create table part (p_partkey int, p_size int, p_brand char(20){''.join(f', {n} char(20)' for n in more)});")
    session.sql(f"load {path} into part;")
    return session


@query("select cast(p_partkey as int) as p_partkey, case when p_size > 30 then p_size - 5 else p_size end as p_size, p_brand from part where p_size <> 7 union all select 1000000, 1, 'New'")
def versioned_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LOAD, CREATE INDEX, UPDATE, DELETE and INSERT on a versioned table. The unique key has line too, a number
    for each row, as part may hold the inserted p_partkey, or one twice."""
    s = _loaded(spark, sf_dir, line=F.monotonically_increasing_id().cast("string"))
    for text in ("create index part(p_partkey, line);", "update part set p_size = p_size - 5 where p_size > 30;", "delete from part where p_size = 7 and line <> 'new';", "insert into part values (1000000, 1, 'New', 'new');"):
        s.sql(text)
    return s.sql("select p_partkey, p_size, p_brand from part;").df


ORACLES["versioned_changes"] = "select cast(p_partkey as int) as p_partkey, case when p_size > 30 then p_size - 5 else p_size end as p_size, p_brand from part where case when p_size > 30 then p_size - 5 else p_size end <> 7 union all select 1000000, 1, 'New'"


@query("select count(*) as before_commit, count(*) - (select count(*) from part where p_size < 10) as after_commit from part")
def snapshot_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader keeps its snapshot while another transaction deletes and commits."""
    from lattis.session import Session

    writer = _loaded(spark, sf_dir)
    reader = Session(writer.db)
    reader.sql("begin;")
    writer.sql("delete from part where p_size < 10;")
    before = reader.sql("select count(*) as n from part;").df
    after = writer.sql("select count(*) as n from part;").df
    return before.select(F.col("n").alias("before_commit")).crossJoin(after.select(F.col("n").alias("after_commit")))


@query("select 'abort' as second_writer, 12 as size")
def write_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two transactions that update one row, the second is rolled back."""
    from lattis.session import Session

    a = _session(spark)
    b = Session(a.db)
    for text in ("create table t (id int, size int);", "insert into t values (1, 5);", "begin;"):
        a.sql(text)
    b.sql("begin;")
    a.sql("update t set size = 12 where id = 1;")
    answer = b.execute("update t set size = 13 where id = 1;").strip()
    a.sql("commit;")
    return a.sql("select size from t;").df.select(F.lit(answer).alias("second_writer"), F.col("size").cast(T.IntegerType()))


@query("select 'abort' as second_writer, 1 as on_call")
def write_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serializable: of two transactions that each rely on what the other changes, one is rolled back."""
    from lattis.session import Session

    a = _session(spark)
    b = Session(a.db)
    for text in ("create table duty (id int, here int);", "insert into duty values (1, 1);", "insert into duty values (2, 1);"):
        a.sql(text)
    for s in (a, b):
        s.sql("set transaction isolation level serializable;")
        s.sql("begin;")
        s.sql("select * from duty where here = 1;")
    a.sql("update duty set here = 0 where id = 1;")
    answer = b.execute("update duty set here = 0 where id = 2;").strip()
    a.sql("commit;")
    return a.sql("select count(*) as n from duty where here = 1;").df.select(F.lit(answer).alias("second_writer"), F.col("n").cast("int").alias("on_call"))


# -- extensions -------------------------------------------------------------------------------------------------------


@query("select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_totalprice > 200000")
def ext_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outer_join(read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "orders").filter("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def ext_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anti_join(read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey")


@query("select l_returnflag, count(distinct l_suppkey) as n from lineitem group by l_returnflag")
def ext_count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_distinct(read_table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_suppkey")


@query("select s_nationkey, s_suppkey from (select *, row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) as r from supplier) where r <= 2")
def ext_top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = rank_within(read_table(spark, sf_dir, "supplier"), ["s_nationkey"], [F.col("s_acctbal").desc(), F.col("s_suppkey")], "r")
    return ranked.filter("r <= 2").select("s_nationkey", "s_suppkey")


@query("select o_orderstatus, o_orderpriority, count(*) as n from orders group by rollup (o_orderstatus, o_orderpriority)")
def ext_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup_counts(read_table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, cast(sum(cast(value as decimal(18, 6))) as double) as total from events group by 1, 2")
def ext_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_counts(read_table(spark, sf_dir, "events"))


# -- statements -------------------------------------------------------------------------------------------------------

from lattis import statements  # noqa: E402

QUERIES |= statements.QUERIES
ORACLES |= statements.ORACLES
