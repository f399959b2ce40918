"""A session: statements as text, their results as DataFrames or lines, and their answers as the server gives them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattis.errors import Conflict, DuplicateKey, EngineError, IncompatibleType, IndexExists, IndexNotFound, ValueCountMismatch
from lattis.operators import Change, duplicate_keys
from lattis.plans import dialect as d
from lattis.plans.build import Builder, Query, table_predicate
from lattis.plans.explain import explain
from lattis.render import HELP, bar_line, cells, client_table, output_lines
from lattis.sources.csv import read_csv
from lattis.sources.storage import INLINE, RID, Database, TableState
from lattis.txn import Transaction, key_column
from lattis.types import SqlType, coerce


@dataclass
class Result:
    """A query's rows, or lines of text."""

    query: Query | None = None
    lines: list[str] = field(default_factory=list)

    @property
    def df(self) -> DataFrame:
        return self.query.named()

    def rows(self) -> list[tuple]:
        return [tuple(r) for r in self.query.df.collect()]

    def persist(self) -> Result:
        """Keep the rows in the executors for further use; nothing is cached unless asked for."""
        self.query.df = self.query.df.persist()
        return self

    def output(self) -> list[str]:
        return output_lines(self.query) if self.query else self.lines

    def table(self) -> str:
        return client_table(self.query.captions, cells(self.query)) if self.query else "\n".join(self.lines)


class _Catalog:
    def __init__(self, db: Database, txn: Transaction):
        self.db, self.txn = db, txn

    def columns(self, table: str) -> dict[str, SqlType]:
        return self.txn.state(table).types

    def rows(self, table: str) -> DataFrame:
        return self.db.rows(self.txn.state(table))


class Session:
    def __init__(self, db: Database, output: str | None = None, hint: str | None = None):
        """hint: the join algorithm to ask for (MERGE, SHUFFLE_HASH, BROADCAST) where no setting does."""
        self.db, self.spark, self.output_file, self.hint = db, db.spark, output, hint
        self.txn: Transaction | None = None
        self.serializable, self.settings = False, {"output_file": True, "enable_nestloop": True, "enable_sortmerge": False}
        self.closed = False

    # -- statements ---------------------------------------------------------------------------------------------------

    def sql(self, text: str) -> Result | None:
        """Run a statement; errors are raised, after a rollback if a transaction was open."""
        try:
            return self._run(d.parse(text))
        except Conflict:
            self._rollback()
            raise
        except (PySparkException, Py4JError) as e:
            self._rollback()
            raise EngineError(str(e).splitlines()[0]) from e
        except EngineError:
            self._rollback()
            raise

    def execute(self, text: str) -> str:
        """Run a statement and give the server's answer: its rows, nothing, failure or abort. Results and failures are
        also added to the output file."""
        return self.answer(text)[1]

    def answer(self, text: str) -> tuple[Result | None, str]:
        """execute(), with the result that its lines are of."""
        explicit, result = self.txn is not None, None
        try:
            result = self.sql(text)
            lines = result.output() if result else []
        except Conflict:
            lines = ["abort"]
        except EngineError:
            lines = ["abort" if explicit else "failure"]
        except (PySparkException, Py4JError):  # a row that can't be read shows when the result is taken
            self._rollback()
            result, lines = None, ["abort" if explicit else "failure"]
        if lines and self.output_file and self.settings["output_file"]:
            with Path(self.output_file).open("a") as f:
                f.write("".join(x + "\n" for x in lines))
        return result, "".join(x + "\n" for x in lines)

    def close(self) -> None:
        """Roll back what is open."""
        self._rollback()
        self.closed = True

    def script(self, text: str) -> str:
        return "".join(self.execute(s) for s in d.split(text))

    def _rollback(self) -> None:
        if self.txn:
            self.txn.abort()
            self.txn = None

    def _run(self, s) -> Result | None:
        if s is None:
            return None
        if isinstance(s, d.TableCommand):
            return self._command(s)
        if isinstance(s, d.CreateTable):
            return self.db.create(s.name, s.columns)
        if isinstance(s, d.IndexCommand):
            return self._create_index(s) if s.kind == "create" else self._drop_index(s)
        if isinstance(s, d.Setting):
            if s.name == "isolation":
                self.serializable = s.value == "serializable"
            else:
                self.settings[s.name] = s.value
            return None
        txn = self.txn or Transaction(self.db, False, False)
        try:
            out = self._in(txn, s)
            if txn is not self.txn:
                txn.commit(self._verify)
            return out
        except BaseException:
            if txn is not self.txn:
                txn.abort()
            raise

    def _in(self, txn: Transaction, s) -> Result | None:
        if isinstance(s, d.Select):
            return Result(self._select(txn, s))
        if isinstance(s, d.Explain):
            return Result(lines=explain(s.query, self._builder(txn), lambda t: [list(i) for i in txn.state(t).indexes]))
        if isinstance(s, d.Insert):
            return self._insert(txn, s)
        if isinstance(s, d.Load):
            return self._load(txn, s)
        return self._modify(txn, s.table, s.where, s.sets if isinstance(s, d.Update) else None)

    def _command(self, s: d.TableCommand) -> Result | None:
        if s.kind == "begin":
            if self.txn is None:
                self.txn = Transaction(self.db, self.serializable, True)
        elif s.kind == "commit":
            if self.txn:
                txn, self.txn = self.txn, None
                try:
                    txn.commit(self._verify)
                except EngineError as e:
                    txn.abort()
                    raise Conflict(str(e)) from e
        elif s.kind in ("abort", "crash"):
            self._rollback()
            self.closed = s.kind == "crash"
        elif s.kind == "exit":
            self._rollback()
            self.closed = True
        elif s.kind == "checkpoint":
            self.db.checkpoint()
        elif s.kind == "help":
            return Result(lines=HELP.splitlines())
        elif s.kind == "show_tables":
            return Result(lines=[bar_line(["Tables"]), *(bar_line([t]) for t in self.db.tables)])
        elif s.kind == "show_index":
            return Result(lines=[bar_line([s.table, "unique", f"({','.join(i)})"]) for i in self.db.table(s.table).indexes])
        elif s.kind == "desc":
            t = self.db.table(s.table)
            keyed = {c for i in t.indexes for c in i}
            return Result(lines=[bar_line(["Field", "Type", "Index"]), *(bar_line([c, k.shown(), "YES" if c in keyed else "NO"]) for c, k in t.columns)])
        elif s.kind == "drop":
            self.db.drop(s.table)
        return None

    # -- queries ------------------------------------------------------------------------------------------------------

    def _builder(self, txn: Transaction) -> Builder:
        hint = "MERGE" if self.settings["enable_sortmerge"] and not self.settings["enable_nestloop"] else self.hint
        return Builder(_Catalog(self.db, txn), hint)

    def _select(self, txn: Transaction, s: d.Select) -> Query:
        query = self._builder(txn).select(s)
        for table, where in query.reads:
            txn.read(table, where)
            self.db.advisor.note(table, where)
        return query

    # -- unique keys --------------------------------------------------------------------------------------------------

    def _create_index(self, s: d.IndexCommand) -> None:
        with self.db.lock:
            t = self.db.table(s.table)
            for c in s.columns:
                if c not in t.types:
                    raise EngineError(f"no column {c}")
            if tuple(s.columns) in t.indexes:
                raise IndexExists(str(s.columns))
            if not duplicate_keys(self.db.rows(t), s.columns).isEmpty():
                raise DuplicateKey(str(s.columns))
            self.db.publish({t.name: replace(t, indexes=(*t.indexes, tuple(s.columns)))})

    def _drop_index(self, s: d.IndexCommand) -> None:
        with self.db.lock:
            t = self.db.table(s.table)
            if tuple(s.columns) not in t.indexes:
                raise IndexNotFound(str(s.columns))
            self.db.publish({t.name: replace(t, indexes=tuple(i for i in t.indexes if i != tuple(s.columns)))})

    def _verify(self, t: TableState, rows: dict[int, tuple]) -> None:
        """Raise DuplicateKey if rows (id: values) clash with each other or with the rows of t under other ids."""
        names = [c for c, _ in t.columns]
        for index in t.indexes:
            at = [names.index(c) for c in index]
            keys = [tuple(v[k] for k in at) for v in rows.values()]
            if len(set(keys)) < len(keys):
                raise DuplicateKey(str(index))
            inline = {tuple(r[1 + k] for k in at) for r in t.rows if r[0] not in rows}
            if inline & set(keys):
                raise DuplicateKey(str(index))
            if t.files:
                stored = self.db.rows(replace(t, rows=()))
                if len(keys) == 1:  # a point look-up: the filter reaches the files' statistics
                    for c, v in zip(index, keys[0], strict=True):
                        stored = stored.filter(F.col(f"`{c}`") == F.lit(v).cast(t.types[c].spark))
                else:
                    new = self.spark.createDataFrame(keys, ", ".join(f"`{c}` {t.types[c].spark.simpleString()}" for c in index))
                    stored = stored.join(F.broadcast(new), list(index), "left_semi")  # at most INLINE keys
                if not stored.filter(~F.col(RID).isin(list(rows))).isEmpty():
                    raise DuplicateKey(str(index))

    def _uncommitted(self, txn: Transaction, t: TableState, rows: dict[int, tuple]) -> None:
        """Raise Conflict if another open transaction has written one of the rows' unique keys."""
        names = [c for c, _ in t.columns]
        for index in t.indexes:
            at = [names.index(c) for c in index]
            keys = {tuple(v[k] for k in at) for v in rows.values()}
            for x in txn.others():
                delta = x.deltas.get(t.name)
                if delta and any(tuple(v[k] for k in at) in keys for v in delta.added.values()):
                    raise Conflict(f"{index} is being written")

    # -- changes ------------------------------------------------------------------------------------------------------

    def _insert(self, txn: Transaction, s: d.Insert) -> None:
        t = txn.state(s.table)
        if len(s.values) != len(t.columns):
            raise ValueCountMismatch(f"{len(s.values)} values for {len(t.columns)} columns")
        values = tuple(coerce(v, k) for v, (_, k) in zip(s.values, t.columns, strict=True))
        rid = self.db.new_ids(1)
        self._write(txn, t, {rid: values}, {})

    def _write(self, txn: Transaction, t: TableState, new: dict[int, tuple], old: dict[int, tuple]) -> None:
        """Put rows of new in place of those of old (ids: values); ids of old alone are deleted."""
        with self.db.lock:
            key = key_column(t)
            at = [c for c, _ in t.columns].index(key) if key else None
            keys = {v[at] for r, v in new.items() if r not in old or old[r][at] != v[at]} if key else set()
            txn.check(t.name, set(old), keys)
            base = txn._applied(t, type(txn.delta(t.name))(set(old) | set()))
            if new:
                self._verify(base, new)
                self._uncommitted(txn, t, new)
            images = [*old.values(), *new.values()]
            txn.wrote(t.name, images)
            delta = txn.delta(t.name)
            if delta.whole:
                delta.whole = txn._applied(delta.whole, type(delta)(set(old), dict(new)))
            else:
                delta.removed |= set(old)
                for r in old:
                    delta.added.pop(r, None)
                delta.added.update(new)
            delta.images += images

    def _load(self, txn: Transaction, s: d.Load) -> None:
        t = txn.state(s.table)
        txn.check(t.name, None, set())
        files = self.db.write_new_rows(read_csv(self.spark, s.path, t.types), t)
        self._added(t, files)
        self._whole(txn, t, replace(t, files=t.files + files))

    def append(self, table: str, df: DataFrame) -> None:
        """Add the rows of any DataFrame with the table's columns: Parquet, JSON, JDBC, whatever Spark reads. Types are
        cast, strings over their column's bytes and nulls are errors, unique keys are checked."""
        txn = self.txn or Transaction(self.db, False, False)
        try:
            t = txn.state(table)
            missing = [c for c in t.types if c not in df.columns]
            if missing:
                raise ValueCountMismatch(f"no columns {missing}")
            columns = []
            for c, k in t.columns:
                value = F.col(f"`{c}`").cast(k.spark)
                value = F.when(value.isNull(), F.raise_error(F.lit(f"null in {c}"))).otherwise(value)
                if k.kind == "CHAR":
                    value = F.when(F.octet_length(value) > k.length, F.raise_error(F.lit(f"too long for {c}"))).otherwise(value)
                columns.append(value.cast(k.spark).alias(c))
            txn.check(t.name, None, set())
            files = self.db.write_new_rows(df.select(*columns), t)
            self._added(t, files)
            self._whole(txn, t, replace(t, files=t.files + files))
            if txn is not self.txn:
                txn.commit(self._verify)
        except BaseException as e:
            txn.abort()
            self.txn = None if txn is self.txn else self.txn
            if isinstance(e, (PySparkException, Py4JError)):
                raise EngineError(str(e).splitlines()[0]) from e
            raise

    def _unique(self, t: TableState, new: DataFrame, others: DataFrame, indexes=None) -> None:
        """Raise DuplicateKey if rows of new clash with each other, or with others. Only new is grouped; the other rows are
        looked through once, against its keys."""
        for index in t.indexes if indexes is None else indexes:
            keys = [F.col(f"`{c}`") for c in index]
            if not duplicate_keys(new, list(index)).isEmpty() or not others.select(*keys).join(new.select(*keys), list(index), "left_semi").isEmpty():
                raise DuplicateKey(str(index))

    def _added(self, t: TableState, files: tuple[str, ...]) -> None:
        if files and t.indexes:
            self._unique(t, self.spark.read.schema(t.schema()).parquet(*files), self.db.rows(t))

    def _whole(self, txn: Transaction, before: TableState, after: TableState) -> None:
        with self.db.lock:
            txn.check(before.name, None, set())
            txn.wrote(before.name, [], whole=True)
            txn.delta(before.name).whole = after

    def _changes(self, t: TableState, sets: list[d.Assign]) -> list[Change]:
        out = []
        for a in sets:
            if a.column not in t.types:
                raise EngineError(f"no column {a.column}")
            to = t.types[a.column]
            if a.source is None:
                out.append(Change(a.column, to, value=coerce(a.value, to)))
                continue
            if a.source.name not in t.types:
                raise EngineError(f"no column {a.source.name}")
            of = t.types[a.source.name]
            if to.kind != of.kind and not (to.kind == "FLOAT" and of.kind == "INT"):
                raise IncompatibleType(f"{of.kind} for {to.kind}")
            if a.op and (not to.numeric or a.value.kind not in ("INT", "FLOAT") or to.kind == "INT" and a.value.kind != "INT"):
                raise IncompatibleType(f"{a.op} on {to.kind}")
            if a.op == "/" and float(a.value.value) == 0:
                raise EngineError("division by zero")
            out.append(Change(a.column, to, a.source.name, of, a.op, a.value.value if a.op else None))
        return out

    def _modify(self, txn: Transaction, table: str, where: list[d.Cond], sets: list[d.Assign] | None) -> None:
        t = txn.state(table)
        predicate, checked = table_predicate(t.types, table, where)
        changes = self._changes(t, sets) if sets is not None else []
        new = {c.column: c.column_() for c in changes}
        txn.read(table, checked)
        names = [c for c, _ in t.columns]
        rows = self.db.rows(t)
        matched = rows.filter(predicate)
        after = matched.select(RID, *[F.col(f"`{c}`") for c in names], *[new.get(c, F.col(f"`{c}`")).alias(f"_new{k}") for k, c in enumerate(names)])
        got = after.limit(INLINE + 1).collect()
        if len(got) > INLINE:
            return self._modify_many(txn, t, predicate, new if sets is not None else None)
        old = {r[0]: tuple(r[1 : 1 + len(names)]) for r in got}
        if sets is None:
            changed: dict[int, tuple] = {}
        else:
            changed = {r[0]: tuple(r[1 + len(names) :]) for r in got}
            same = {k for k in old if old[k] == changed[k]}
            if same and txn.explicit:
                txn.check(table, same, set())
            old = {k: v for k, v in old.items() if k not in same}
            changed = {k: v for k, v in changed.items() if k not in same}
        if old:
            self._write(txn, t, changed, old)
        return None

    def _modify_many(self, txn: Transaction, t: TableState, predicate, new: dict | None) -> None:
        """Write again only the files that hold a row which changes."""
        txn.check(t.name, None, set())
        stored = self.spark.read.schema(t.schema()).parquet(*t.files) if t.files else None
        hit = self.db.files_of(stored, predicate) if t.files else []
        affected = self.db.rows(replace(t, files=tuple(hit)))
        keyed = [i for i in t.indexes if new and set(i) & set(new)]
        if keyed:
            changed = self.db.rows(t).filter(predicate).select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c, _ in t.columns])
            self._unique(t, changed, self.db.rows(t).filter(~predicate), keyed)
        if new is None:
            made = affected.filter(~predicate)
        else:
            made = affected.select(RID, *[(F.when(predicate, new[c]).otherwise(F.col(f"`{c}`")) if c in new else F.col(f"`{c}`")).alias(c) for c, _ in t.columns])
        kept = tuple(f for f in t.files if f not in set(hit))
        # gone rows in files that stay untouched are still hidden by their ids
        self._whole(txn, t, replace(t, files=kept + self.db.write_rows(made, t), rows=()))
