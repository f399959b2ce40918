"""Versioned tables: immutable Parquet files, small changes kept in the manifest, and one manifest for each version.

A database is a folder. Each commit writes a manifest-N.json; it has, for each table, its columns, its unique keys, the
names of the lists of its Parquet files with what has changed in them, and the small changes since: rows that aren't in files yet, and
ids of rows in files that are gone. Lists are files of their own, written once and named again by later manifests, so what a commit
writes hangs on what it changes and not on how many files the tables have. A reader pins a version, and never meets a half-written one. When a table's small changes pass INLINE rows they
are folded: only files with rows that are gone are written again. Statements over many rows write files at once, again
only those that hold a row they change. Files that no version in use lists are removed by vacuum().

The folder is reached through Hadoop's file system API, so that it can be anywhere that Spark reaches.
"""

from __future__ import annotations

import json
import threading
import uuid
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattis.errors import Conflict, TableExists, TableNotFound
from lattis.sources.advisor import Advisor
from lattis.types import SqlType

#: Rows of a table that a manifest may hold before they go to files.
INLINE = 1000
#: Files that a manifest may name beside its tables' lists.
LISTED = 1000
RID = "_rid"


@dataclass(frozen=True)
class TableState:
    """A table at one version. rows: (id, values..) not in files; gone: ids of rows in files that are deleted."""

    name: str
    columns: tuple[tuple[str, SqlType], ...]
    indexes: tuple[tuple[str, ...], ...] = ()
    files: tuple[str, ...] = ()
    rows: tuple[tuple, ...] = ()
    gone: frozenset[int] = frozenset()
    changed: int = 0  # the version that last changed the table

    @property
    def types(self) -> dict[str, SqlType]:
        return dict(self.columns)

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(RID, T.LongType())] + [T.StructField(c, t.spark) for c, t in self.columns])

    def to_json(self, files: dict) -> dict:
        """files: the names of the lists of its files, and what has been added to and dropped from them."""
        return {"columns": [[c, t.kind, t.length] for c, t in self.columns], "indexes": self.indexes, "files": files, "rows": self.rows, "gone": sorted(self.gone), "changed": self.changed}

    @staticmethod
    def from_json(name: str, d: dict, files: tuple[str, ...]) -> TableState:
        return TableState(name, tuple((c, SqlType(k, n)) for c, k, n in d["columns"]), tuple(map(tuple, d["indexes"])), files, tuple(map(tuple, d["rows"])), frozenset(d["gone"]), d["changed"])


class Folder:
    """Files of a folder on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.fs = self._of(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._of(path))

    def _of(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self) -> list[str]:
        return [f.getPath().getName() for f in self.fs.listStatus(self._of(self.path))]

    def read(self, name: str) -> str:
        stream = self.fs.open(self._of(f"{self.path}/{name}"))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> None:
        """Write a file as a whole: it appears under its name once it is complete."""
        temp = f"{self.path}/.{name}-{uuid.uuid4().hex}"
        out = self.fs.create(self._of(temp), False)
        out.write(bytearray(text.encode()))
        out.close()
        if self.fs.exists(self._of(f"{self.path}/{name}")) or not self.fs.rename(self._of(temp), self._of(f"{self.path}/{name}")):
            self.fs.delete(self._of(temp), False)
            raise Conflict(f"{name} is there already: another process writes to this database")

    def delete(self, name: str) -> None:
        self.fs.delete(self._of(f"{self.path}/{name}"), True)

    def files(self, name: str) -> list[str]:
        """The Parquet files in a folder below."""
        return sorted(str(f.getPath().toString()) for f in self.fs.listStatus(self._of(f"{self.path}/{name}")) if f.getPath().getName().endswith(".parquet"))


@dataclass
class Commit:
    """What a version changed: for each table the ids of changed rows (None: any), and the values of logical keys."""

    version: int
    touched: dict[str, set[int] | None] = field(default_factory=dict)
    keys: dict[str, set] = field(default_factory=dict)


class Database:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder, self.lock = spark, Folder(spark, path), threading.RLock()
        self._lists: dict[str, tuple[str, ...]] = {}  # the lists that a table's newest manifest names
        self._listed: dict[str, frozenset[str]] = {}  # what they hold
        self._named: dict[int, set[str]] = {}  # the lists that each version's manifest names
        self.version, self.next_rid, self.tables = self._recover()
        self.transactions: dict[int, object] = {}
        self.history: list[Commit] = []
        self._views: dict[tuple, DataFrame] = {}
        self.advisor = Advisor()

    def _recover(self) -> tuple[int, int, dict[str, TableState]]:
        """The newest manifest that can be read; what a commit that didn't end has left is removed."""
        names = self.folder.names()
        for name in sorted((n for n in names if n.startswith("manifest-")), reverse=True):
            try:
                d = json.loads(self.folder.read(name))
            except ValueError:
                self.folder.delete(name)
                continue
            tables = self._taken(d)
            self._sweep(names, [tables])
            return d["version"], d["next_rid"], tables
        return 0, 0, {}

    def _taken(self, manifest: dict) -> dict[str, TableState]:
        """The tables of a manifest, whose lists are this process's from now on."""
        out, self._lists = {}, {}
        for name, t in manifest["tables"].items():
            self._lists[name], files = tuple(t["files"]["lists"]), set(t["files"]["added"])
            for n in self._lists[name]:
                if n not in self._listed:
                    self._listed[n] = frozenset(json.loads(self.folder.read(n)))
                files |= self._listed[n]
            out[name] = TableState.from_json(name, t, tuple(sorted(files - set(t["files"]["dropped"]))))
        self._named[manifest["version"]] = {n for lists in self._lists.values() for n in lists}
        return out

    def _list(self, t: TableState) -> tuple[tuple[str, ...], dict]:
        """Lists for a table's files, and how a manifest names them: those there are, with small changes, or new ones of what was
        added, or of all files once most of those listed are gone."""
        lists, files = self._lists.get(t.name, ()), set(t.files)
        listed = set().union(*(self._listed[n] for n in lists))
        added, dropped = files - listed, listed - files
        if len(dropped) > LISTED and 2 * len(dropped) > len(listed):
            lists, added, dropped = (), files, set()
        if len(added) > LISTED:
            name = f"files-{uuid.uuid4().hex}.json"
            self.folder.write_new(name, json.dumps(sorted(added)))
            self._listed[name] = frozenset(added)
            lists, added = (*lists, name), set()
        return lists, {"lists": lists, "added": sorted(added), "dropped": sorted(dropped)}

    def _sweep(self, names: list[str], kept: list[dict[str, TableState]]) -> None:
        used = {f.rsplit("/", 2)[-2] for tables in kept for t in tables.values() for f in t.files}
        used |= {n for lists in self._named.values() for n in lists}
        for n in names:
            if n.startswith((".manifest-", ".files-")) or n.startswith(("data-", "files-")) and n not in used:
                self.folder.delete(n)

    def refresh(self) -> None:
        """Take up versions that another process has written. Open transactions keep their snapshots."""
        with self.lock:
            newer = sorted(n for n in self.folder.names() if n.startswith("manifest-") and int(n[9:-5]) > self.version)
            if newer:
                d = json.loads(self.folder.read(newer[-1]))
                self.version, self.tables = d["version"], self._taken(d)
                self.next_rid = max(self.next_rid, d["next_rid"])

    def table(self, name: str, tables: dict[str, TableState] | None = None) -> TableState:
        try:
            return (self.tables if tables is None else tables)[name]
        except KeyError:
            raise TableNotFound(name) from None

    def rows(self, t: TableState) -> DataFrame:
        """A table's rows with their ids."""
        key = (t.name, t.columns, t.files, t.rows, t.gone)
        if key not in self._views:
            if len(self._views) > 200:
                self._views.clear()
            self._views[key] = self._rows(t)
        return self._views[key]

    def _rows(self, t: TableState) -> DataFrame:
        out = None
        if t.files:
            out = self.spark.read.schema(t.schema()).parquet(*t.files)
            if t.gone:
                out = out.filter(~F.col(RID).isin(sorted(t.gone)))
        if t.rows or out is None:
            kinds = {"INT": pa.int32(), "FLOAT": pa.float32(), "CHAR": pa.string()}
            types = [(RID, pa.int64())] + [(c, kinds[k.kind]) for c, k in t.columns]
            columns = list(zip(*t.rows, strict=True)) or [[]] * len(types)
            inline = self.spark.createDataFrame(pa.table([pa.array(v, k) for v, (_, k) in zip(columns, types, strict=True)], names=[n for n, _ in types]))
            out = inline if out is None else out.unionByName(inline)
        return out

    def new_ids(self, n: int) -> int:
        with self.lock:
            first, self.next_rid = self.next_rid, self.next_rid + n
            return first

    def write_rows(self, df: DataFrame, t: TableState) -> tuple[str, ...]:
        """Rows with ids to new files, which no version lists yet, sorted by the columns that look-ups go by."""
        name, order = f"data-{uuid.uuid4().hex}", self.advisor.sort_columns(t.name, t.indexes)
        if order := [c for c in order if c in df.columns]:
            df = df.sortWithinPartitions(*[F.col(f"`{c}`") for c in order])
        df.write.parquet(f"{self.folder.path}/{name}")
        return tuple(self.folder.files(name))

    def write_new_rows(self, df: DataFrame, t: TableState) -> tuple[str, ...]:
        """Rows without ids to new files, with ids of their own."""
        room = 1 << 50  # monotonically_increasing_id takes 2 ** 33 a partition
        first = self.new_ids(room)
        files = self.write_rows(df.select((F.monotonically_increasing_id() + F.lit(first)).alias(RID), *[F.col(f"`{c}`") for c, _ in t.columns]), t)
        with self.lock:
            if self.next_rid == first + room:  # give back what wasn't used
                last = self.spark.read.schema(t.schema()).parquet(*files).agg(F.max(RID)).first()[0] if files else None
                self.next_rid = first if last is None else last + 1
        return files

    def fold(self, t: TableState) -> TableState:
        """t with its small changes in files; only files with rows that are gone are written again."""
        if not t.rows and not t.gone:
            return t
        files, extra = set(t.files), self._rows(replace(t, files=(), gone=frozenset()))
        if t.gone and t.files:
            old = self.spark.read.schema(t.schema()).parquet(*t.files)
            hit = self.files_of(old, F.col(RID).isin(sorted(t.gone)))
            again = self.spark.read.schema(t.schema()).parquet(*hit).filter(~F.col(RID).isin(sorted(t.gone))) if hit else None
            files -= set(hit)
            extra = extra if again is None else extra.unionByName(again)
        return replace(t, files=tuple(sorted(files)) + self.write_rows(extra, t), rows=(), gone=frozenset())

    def files_of(self, df: DataFrame, where: Column) -> list[str]:
        """The files that hold a row for which where holds."""
        return sorted(r[0] for r in df.filter(where).select(F.col("_metadata.file_path")).distinct().collect())

    def publish(self, changed: dict[str, TableState | None], commit: Commit | None = None) -> None:
        """The next version: changed tables (None: dropped) over the current ones."""
        with self.lock:
            version = self.version + 1
            tables = dict(self.tables)
            for name, t in changed.items():
                if t is None:
                    tables.pop(name, None)
                else:
                    tables[name] = replace(t if len(t.rows) + len(t.gone) <= INLINE else self.fold(t), changed=version)
            lists = {n: self._list(t) for n, t in tables.items()}
            self.folder.write_new(f"manifest-{version:012d}.json", json.dumps({"version": version, "next_rid": self.next_rid, "tables": {n: t.to_json(lists[n][1]) for n, t in tables.items()}}))
            self.version, self.tables, self._lists = version, tables, {n: own for n, (own, _) in lists.items()}
            self._named[version] = {n for own in self._lists.values() for n in own}
            if commit:
                commit.version = version
                self.history.append(commit)
            oldest = min((x.start for x in self.transactions.values()), default=version)
            self.history = [c for c in self.history if c.version > oldest]

    def create(self, name: str, columns: list[tuple[str, SqlType]]) -> None:
        with self.lock:
            if name in self.tables:
                raise TableExists(name)
            if len({c for c, _ in columns}) < len(columns):
                raise TableExists("a column name is used twice")
            self.publish({name: TableState(name, tuple(columns))})

    def drop(self, name: str) -> None:
        with self.lock:
            self.table(name)
            self.publish({name: None})

    def checkpoint(self) -> None:
        """All small changes to files, one new version, and what is no longer used removed."""
        with self.lock:
            self.publish({n: self.fold(t) for n, t in self.tables.items()})
            self.vacuum()

    def vacuum(self) -> None:
        """Remove manifests before the oldest version in use, and files that none in use lists."""
        with self.lock:
            oldest = min((x.start for x in self.transactions.values()), default=self.version)
            kept = [self.tables, *(x.snapshot for x in self.transactions.values())]
            for n in self.folder.names():
                if n.startswith("manifest-") and int(n[9:-5]) < min(oldest, self.version):
                    self.folder.delete(n)
            self._named = {v: lists for v, lists in self._named.items() if v >= min(oldest, self.version)}
            self._listed = {n: files for n, files in self._listed.items() if any(n in lists for lists in self._named.values())}
            self._views.clear()
            self._sweep(self.folder.names(), kept)
