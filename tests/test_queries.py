import re

import duckdb
import pytest
from conftest import DATA

import __spark_entry__
from lattis.queries import ORACLES, QUERIES

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_against_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    text = lambda df: sorted(map(str, df[columns].itertuples(index=False, name=None)))
    assert text(got) == text(want)


@pytest.mark.parametrize("rows", [[(999_999, 7), (1_000_000, 31), (1_000_001, 12)], [(1_000_000, 1), (1_000_001, 7)], [(5, 31), (5, 31), (5, 12), (6, 7), (6, 7)], [(-3, 7), (0, 7), (-4, 40)], []], ids=["inserted key", "inserted row", "keys twice", "negative keys", "no rows"])
def test_versioned_changes_whatever_keys_there_are(spark, tmp_path, rows):
    con = duckdb.connect()
    con.execute("create table part (p_partkey bigint, p_size int, p_brand varchar)")
    for key, size in rows:
        con.execute("insert into part values (?, ?, 'New')", [key, size])
    con.execute(f"copy part to '{tmp_path}/part.parquet' (format parquet)")
    got = QUERIES["versioned_changes"](spark, str(tmp_path))
    assert got.columns == ["p_partkey", "p_size", "p_brand"]
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(ORACLES["versioned_changes"]).fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["filter_and"](spark, SF))
    assert "PushedFilters: [" in text and re.search(r"ReadSchema: struct<[^>]*>", text)[0].count(":") <= 6
    assert "l_quantity" in text.split("PushedFilters: [")[1].split("]")[0] and "l_shipdate" not in text


def test_plans(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["top_k"](spark, SF))
    assert "SortMergeJoin" in plan(QUERIES["join_hint_merge"](spark, SF))
    assert "ShuffledHashJoin" in plan(QUERIES["join_hint_hash"](spark, SF))
    assert "CartesianProduct" not in plan(QUERIES["comma_join"](spark, SF))
    assert "LeftSemi" in plan(QUERIES["semi_join"](spark, SF))
    assert "BroadcastHashJoin" in plan(QUERIES["join_hint_broadcast"](spark, SF))


def test_a_large_side_is_not_broadcast_by_a_hint(spark, monkeypatch):
    from lattis.operators import join

    monkeypatch.setattr(join, "BROADCAST_BYTES", 100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Broadcast" not in plan(QUERIES["join_hint_broadcast"](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_groups_in_a_mixed_order_need_no_single_task(spark):
    assert "Window" not in plan(QUERIES["group_order_mixed"](spark, SF))


def test_no_timestamp_is_dropped(spark):
    assert QUERIES["scan_all_datetime"](spark, SF).columns == spark.read.parquet(f"{SF}/orders.parquet").columns


def test_dates_and_other_types(spark):
    from lattis.errors import IncompatibleType
    from lattis.frame import Frames

    f = Frames({"t": spark.sql("select 1 as id, date'2024-05-06' as d, timestamp'2024-05-06 07:08:09' as at, array(1, 2) as xs, decimal(1.5) as m")})
    assert f.sql("select * from t where d >= '2024-05-06' and at < '2024-05-07'").count() == 1
    for bad in ("select id from t where xs = 1", "select id from t where d = 'soon'", "select sum(m) as s from t", "select id from t where d = 5", "select id from t where xs = xs"):
        with pytest.raises(IncompatibleType):
            f.sql(bad)


def test_entry_without_the_training_data_package(tmp_path):
    """With those two folders deleted, the other queries are still there, and run."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__spark_entry__.__file__).parent
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'pipeline' not in q and 'op1_lm_score' not in q and set(o) <= set(q) and len(q) > 100; print('fine')"
    for gone in ((), ("corpus_pipeline.py",)):
        for name in gone:
            (tmp_path / "repo" / name).unlink(missing_ok=True)
        done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env={k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, check=False)
        assert done.stdout.strip() == "fine", done.stderr
