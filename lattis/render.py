"""Results as text: the lines of output.txt, and the client's table of 16-character cells."""

from __future__ import annotations

from lattis.functions import float_text
from lattis.plans.build import Query
from pyspark.sql import functions as F

HELP = """Statements end with a semicolon; keywords are read in any case.
Tables:       create table t (a int, b float, c char(8), d datetime) | drop table t | desc t | show tables
Unique keys:  create index t (a, b) | drop index t (a, b) | show index from t
Rows:         insert into t values (1, 2.5, 'x', '2024-01-01 00:00:00') | load file.csv into t
              update t set a = a + 1, b = 0.5 where c = 'x' and a < 9 | delete from t where a = 1
Queries:      select a, count(*) as n from t join u on t.a = u.a where b > 1.0 group by a having count(*) > 1 order by a desc limit 5
              select * from (select a from t union select a from u) as v order by a | select a from t semi join u on t.a = u.a
              explain analyze select ...
Transactions: begin | commit | abort | set transaction isolation level snapshot isolation (or serializable)"""


def cells(query: Query) -> list[list[str]]:
    """The rows as text; FLOAT with six digits."""
    columns = [float_text(F.col(c)).alias(c) if t.kind in ("FLOAT", "DOUBLE") else F.col(c).cast("string").alias(c) for c, t in zip(query.df.columns, query.types, strict=True)]
    return [list(r) for r in query.df.select(*columns).collect()]


def bar_line(values: list[str]) -> str:
    return "".join(f"| {v} " for v in values) + "|"


def output_lines(query: Query) -> list[str]:
    return [bar_line(query.captions), *(bar_line(r) for r in cells(query))]


def client_table(captions: list[str], rows: list[list[str]], width: int = 16) -> str:
    """Cells over the width end in dots; never cut as a whole."""
    rule = "+" + "+".join("-" * (width + 2) for _ in captions) + "+"
    cell = lambda v: (v if len(v) <= width else v[: width - 3] + "...").rjust(width)
    line = lambda r: "|" + "|".join(f" {cell(v)} " for v in r) + "|"
    return "\n".join([rule, line(captions), rule, *(line(r) for r in rows), rule, f"Total record(s): {len(rows)}"])
