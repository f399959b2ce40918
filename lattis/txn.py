"""Transactions: snapshots, write conflicts, and serializable ones by their rw-dependencies.

A transaction reads the version it began with and its own changes. A statement that would change a row which another
transaction has changed, uncommitted or since the snapshot, aborts (first updater wins). A column called id, or the
only column of a table, identifies rows as well: two transactions can't both write one value of it. Serializable
transactions also note the predicates they read; when a concurrent one writes a row that meets them, before or after
the read, the reader depends on it (an rw-edge), and the statement that gives a transaction both an incoming and an
outgoing edge aborts. Changes of more than storage.INLINE rows count as changing the whole table.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace

from lattis.errors import Conflict
from lattis.plans.dialect import Col, Cond
from lattis.sources.storage import Commit, Database, TableState

_numbers = itertools.count(1)
_OPS = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}


@dataclass
class Delta:
    """A transaction's changes of a table. whole: the new state, where too many rows changed to list them."""

    removed: set[int] = field(default_factory=set)
    added: dict[int, tuple] = field(default_factory=dict)
    images: list[tuple] = field(default_factory=list)  # old and new values of rows written
    whole: TableState | None = None

    @property
    def touched(self) -> set[int] | None:
        return None if self.whole else self.removed | set(self.added)


def key_column(t: TableState) -> str | None:
    names = [c for c, _ in t.columns]
    return "id" if "id" in names else names[0] if len(names) == 1 else None


def meets(values: tuple, names: list[str], where: list[Cond]) -> bool:
    """Whether a row meets checked conditions, whose literals are values of their columns' types (32-bit ones for FLOAT)."""
    row = dict(zip(names, values, strict=True))
    return all(_OPS[c.op](row[c.left.name], row[c.right.name] if isinstance(c.right, Col) else c.right.value) for c in where)


class Transaction:
    def __init__(self, db: Database, serializable: bool, explicit: bool):
        with db.lock:
            self.db, self.serializable, self.explicit = db, serializable, explicit
            self.number, self.start, self.snapshot = next(_numbers), db.version, dict(db.tables)
            self.deltas: dict[str, Delta] = {}
            self.reads: list[tuple[str, list[Cond]]] = []
            self.incoming: set[int] = set()
            self.outgoing: set[int] = set()
            self.ended: int | None = None
            db.transactions[self.number] = self

    def state(self, name: str) -> TableState:
        """The table as this transaction sees it."""
        t, d = self.db.table(name, self.snapshot), self.deltas.get(name)
        return t if d is None else self._applied(t, d)

    @staticmethod
    def _applied(t: TableState, d: Delta) -> TableState:
        if d.whole:
            return d.whole
        inline = {r[0] for r in t.rows}
        rows = tuple(r for r in t.rows if r[0] not in d.removed and r[0] not in d.added) + tuple((k, *v) for k, v in d.added.items())
        # an updated row of a file is gone there and stands inline under its id: the file's row is hidden by gone
        return replace(t, rows=rows, gone=t.gone | {r for r in d.removed if r not in inline} if t.files else t.gone)

    def others(self) -> list[Transaction]:
        return [x for x in self.db.transactions.values() if x is not self and x.ended is None]

    def check(self, table: str, rids: set[int] | None, keys: set) -> None:
        """Raise Conflict if rows (None: any) or logical keys of a table are another transaction's."""
        clash = lambda theirs, theirs_keys: theirs is None or rids is None or bool(theirs & rids) or bool(theirs_keys & keys)
        for x in self.others():
            d = x.deltas.get(table)
            if d and clash(d.touched, x.keys(table)):
                raise Conflict(f"{table} is being changed")
        for c in self.db.history:
            if c.version > self.start and table in c.touched and clash(c.touched[table], c.keys.get(table, set())):
                raise Conflict(f"{table} was changed")

    def keys(self, table: str) -> set:
        d, t = self.deltas.get(table), self.db.table(table, self.snapshot)
        key = key_column(t)
        if d is None or key is None:
            return set()
        at = [c for c, _ in t.columns].index(key)
        return {v[at] for v in d.added.values()}

    def read(self, table: str, where: list[Cond]) -> None:
        """Note a predicate read, and depend on concurrent writers of rows that meet it."""
        if not (self.serializable and self.explicit):
            return
        self.reads.append((table, where))
        for x in self.concurrent():
            d = x.deltas.get(table)
            if d and self._hit(table, d, where):
                self.edge(self, x)

    def wrote(self, table: str, images: list[tuple], whole: bool = False) -> None:
        """Make concurrent readers of what was written depend on this transaction."""
        for x in self.concurrent():
            for t, where in x.reads:
                if t == table and (whole or self._hit(table, Delta(images=images), where)):
                    self.edge(x, self)

    def _hit(self, table: str, d: Delta, where: list[Cond]) -> bool:
        names = [c for c, _ in self.db.table(table, self.snapshot).columns]
        return bool(d.whole) or any(meets(v, names, where) for v in d.images)

    def concurrent(self) -> list[Transaction]:
        return [x for x in self.db.transactions.values() if x is not self and x.serializable and (x.ended is None or x.ended > self.start)]

    def edge(self, reader: Transaction, writer: Transaction) -> None:
        if not (reader.serializable and writer.serializable and reader.explicit and writer.explicit):
            return
        reader.outgoing.add(writer.number)
        writer.incoming.add(reader.number)
        if reader.incoming and reader.outgoing or writer.incoming and writer.outgoing:
            raise Conflict("a dangerous structure of rw-dependencies")

    def delta(self, table: str) -> Delta:
        return self.deltas.setdefault(table, Delta())

    def commit(self, verify) -> None:
        """Publish the changes over the current version; verify(state, rows) checks unique keys again if the table has
        moved on since the snapshot."""
        db = self.db
        with db.lock:
            changed, record = {}, Commit(0)
            for name, d in self.deltas.items():
                now = db.table(name)
                if d.whole and now.changed > self.start:
                    raise Conflict(f"{name} was changed")
                if now.changed > self.start and d.added:
                    verify(self._applied(now, Delta(d.removed)), d.added)
                changed[name] = self._applied(now, d)
                record.touched[name], record.keys[name] = d.touched, self.keys(name)
            if changed:
                db.publish(changed, record)
            self._end()

    def _end(self) -> None:
        db = self.db
        self.ended = db.version
        alive = [x.start for x in db.transactions.values() if x.ended is None]
        for n, x in list(db.transactions.items()):
            if x.ended is not None and not (x.serializable and x.explicit and any(s < x.ended for s in alive)):
                del db.transactions[n]

    def abort(self) -> None:
        with self.db.lock:
            self.deltas = {}
            self.reads = []
            self.db.transactions.pop(self.number, None)
            self.ended = self.db.version
            for x in self.db.transactions.values():
                x.incoming.discard(self.number)
                x.outgoing.discard(self.number)
