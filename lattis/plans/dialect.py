"""The dialect: a tokenizer and a recursive-descent parser to small dataclasses."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field

from lattis.errors import SyntaxFault
from lattis.types import FLOAT, INT, Lit, SqlType

AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")
WORDS = set("SHOW TABLES CREATE TABLE DROP DESC INSERT INTO VALUES DELETE FROM WHERE UPDATE SET SELECT INT CHAR FLOAT DATETIME INDEX AND JOIN SEMI ON EXIT HELP ORDER BY ASC TRUE FALSE BEGIN COMMIT ABORT ROLLBACK GROUP HAVING LIMIT AS UNION EXPLAIN ANALYZE LOAD TRANSACTION ISOLATION LEVEL SNAPSHOT SERIALIZABLE STATIC_CHECKPOINT".split()) | set(AGGREGATES)
TOKEN = re.compile(r"\s+|--[^\n]*|/\*.*?\*/|(?P<float>\d+\.\d*)|(?P<int>\d+)|(?P<word>[A-Za-z][A-Za-z0-9_]*)|'(?P<text>[^']*)'|(?P<op><>|<=|>=|[=<>(),;.*+/-])", re.S)


@dataclass(frozen=True)
class Col:
    table: str | None
    name: str

    def __str__(self) -> str:
        return f"{self.table}.{self.name}" if self.table else self.name


@dataclass(frozen=True)
class Cond:
    left: Col
    op: str
    right: Col | Lit


@dataclass(frozen=True)
class Agg:
    func: str
    col: Col | None  # None: COUNT(*)


@dataclass
class Item:
    value: Col | Agg
    alias: str | None = None


@dataclass
class Ref:
    name: str
    alias: str


@dataclass
class Derived:
    branches: list[Select]
    alias: str


@dataclass
class Select:
    items: list[Item] | None  # None: *
    refs: list
    where: list[Cond] = field(default_factory=list)
    semi: tuple[Ref, Cond] | None = None
    group: list[Col] = field(default_factory=list)
    having: list[tuple[Agg, str, Lit]] = field(default_factory=list)
    order: list[tuple[Col, bool]] = field(default_factory=list)  # True: descending
    limit: int | None = None


@dataclass
class Explain:
    query: Select


@dataclass
class CreateTable:
    name: str
    columns: list[tuple[str, SqlType]]


@dataclass
class TableCommand:
    """drop, desc, show_index on a table; show_tables, help, exit, begin, commit, abort, checkpoint on none."""

    kind: str
    table: str | None = None


@dataclass
class IndexCommand:
    kind: str  # create or drop
    table: str
    columns: list[str]


@dataclass
class Insert:
    table: str
    values: list[Lit]


@dataclass
class Load:
    path: str
    table: str


@dataclass
class Delete:
    table: str
    where: list[Cond]


@dataclass
class Assign:
    column: str
    source: Col | None
    op: str | None
    value: Lit | None


@dataclass
class Update:
    table: str
    sets: list[Assign]
    where: list[Cond]


@dataclass
class Setting:
    name: str
    value: object


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise SyntaxFault(f"unexpected {text[at : at + 10]!r}")
        at = m.end()
        if m.lastgroup == "word" and m["word"].upper() in WORDS:
            out.append(("key", m["word"].upper()))
        elif m.lastgroup:
            out.append((m.lastgroup, m[m.lastgroup]))
    return out


class Parser:
    def __init__(self, text: str):
        self.toks, self.at = tokens(text), 0

    def peek(self, *keys: str, ahead: int = 0) -> bool:
        t = self.toks[self.at + ahead] if self.at + ahead < len(self.toks) else ("end", "")
        return t[0] in ("key", "op") and t[1] in keys

    def take(self, *keys: str) -> str | None:
        if self.peek(*keys):
            self.at += 1
            return self.toks[self.at - 1][1]
        return None

    def need(self, *keys: str) -> str:
        got = self.take(*keys)
        if got is None:
            raise SyntaxFault(f"expected {' or '.join(keys)} at token {self.at}")
        return got

    def kind(self, kind: str) -> str:
        if self.at < len(self.toks) and self.toks[self.at][0] == kind:
            self.at += 1
            return self.toks[self.at - 1][1]
        raise SyntaxFault(f"expected {kind} at token {self.at}")

    def is_kind(self, kind: str) -> bool:
        return self.at < len(self.toks) and self.toks[self.at][0] == kind

    def comma_list(self, one) -> list:
        out = [one()]
        while self.take(","):
            out.append(one())
        return out

    def statement(self):
        out = self.command()
        self.take(";")
        if self.at != len(self.toks):
            raise SyntaxFault(f"unexpected token {self.toks[self.at][1]!r}")
        return out

    def command(self):
        key = self.need("SHOW", "CREATE", "DROP", "DESC", "INSERT", "DELETE", "UPDATE", "SELECT", "EXPLAIN", "SET", "BEGIN", "COMMIT", "ABORT", "ROLLBACK", "HELP", "EXIT")
        if key in ("BEGIN", "COMMIT", "HELP", "EXIT"):
            return TableCommand(key.lower())
        if key in ("ABORT", "ROLLBACK"):
            return TableCommand("abort")
        if key == "SHOW":
            if self.take("TABLES"):
                return TableCommand("show_tables")
            self.need("INDEX")
            self.need("FROM")
            return TableCommand("show_index", self.kind("word"))
        if key == "DESC":
            return TableCommand("desc", self.kind("word"))
        if key in ("CREATE", "DROP"):
            if key == "CREATE" and self.take("STATIC_CHECKPOINT"):
                return TableCommand("checkpoint")
            if self.take("INDEX"):
                table = self.kind("word")
                self.need("(")
                names = self.comma_list(lambda: self.kind("word"))
                self.need(")")
                return IndexCommand(key.lower(), table, names)
            self.need("TABLE")
            name = self.kind("word")
            if key == "DROP":
                return TableCommand("drop", name)
            self.need("(")
            columns = self.comma_list(lambda: (self.kind("word"), self.type_()))
            self.need(")")
            return CreateTable(name, columns)
        if key == "INSERT":
            self.need("INTO")
            table = self.kind("word")
            self.need("VALUES")
            self.need("(")
            values = self.comma_list(self.value)
            self.need(")")
            return Insert(table, values)
        if key == "DELETE":
            self.need("FROM")
            return Delete(self.kind("word"), self.where())
        if key == "UPDATE":
            table = self.kind("word")
            self.need("SET")
            return Update(table, self.comma_list(self.assign), self.where())
        if key == "EXPLAIN":
            self.take("ANALYZE")
            self.need("SELECT")
            return Explain(self.select())
        if key == "SET":
            if self.take("TRANSACTION"):
                self.need("ISOLATION")
                self.need("LEVEL")
                if self.take("SERIALIZABLE"):
                    return Setting("isolation", "serializable")
                self.need("SNAPSHOT")
                self.need("ISOLATION")
                return Setting("isolation", "snapshot")
            name = self.kind("word").lower()
            if name not in ("enable_nestloop", "enable_sortmerge"):
                raise SyntaxFault(f"unknown setting {name}")
            self.need("=")
            return Setting(name, self.need("TRUE", "FALSE") == "TRUE")
        return self.select()

    def type_(self) -> SqlType:
        key = self.need("INT", "FLOAT", "CHAR", "DATETIME")
        if key == "CHAR":
            self.need("(")
            n = int(self.kind("int"))
            self.need(")")
            return SqlType("CHAR", n)
        return {"INT": INT, "FLOAT": FLOAT, "DATETIME": SqlType("CHAR", 19)}[key]

    def value(self) -> Lit:
        sign = self.take("+", "-")
        if self.is_kind("int"):
            v = int(self.kind("int")) * (-1 if sign == "-" else 1)
            if not -(2**31) <= v < 2**31:
                raise SyntaxFault(f"{v} is out of range")
            return Lit(v, "INT")
        if self.is_kind("float"):
            return Lit(float(self.kind("float")) * (-1 if sign == "-" else 1), "FLOAT")
        if sign:
            raise SyntaxFault("a sign needs a number")
        if self.is_kind("text"):
            return Lit(self.kind("text"), "CHAR")
        return Lit(self.need("TRUE", "FALSE") == "TRUE", "BOOL")

    def column(self) -> Col:
        name = self.kind("word")
        return Col(name, self.kind("word")) if self.take(".") else Col(None, name)

    def condition(self) -> Cond:
        left, op = self.column(), self.need("=", "<>", "<", ">", "<=", ">=")
        return Cond(left, op, self.column() if self.is_kind("word") else self.value())

    def conditions(self) -> list[Cond]:
        out = [self.condition()]
        while self.take("AND"):
            out.append(self.condition())
        return out

    def where(self) -> list[Cond]:
        return self.conditions() if self.take("WHERE") else []

    def assign(self) -> Assign:
        column = self.kind("word")
        self.need("=")
        if not self.is_kind("word"):
            return Assign(column, None, None, self.value())
        source = Col(None, self.kind("word"))
        op = self.take("+", "-", "*", "/")
        if op:
            return Assign(column, source, op, self.value())
        if self.is_kind("int") or self.is_kind("float"):
            raise SyntaxFault("an operator is missing")
        return Assign(column, source, None, None)

    def aggregate(self) -> Agg:
        func = self.need(*AGGREGATES)
        self.need("(")
        col = None if func == "COUNT" and self.take("*") else self.column()
        self.need(")")
        return Agg(func, col)

    def item(self) -> Item:
        value = self.aggregate() if self.peek(*AGGREGATES) else self.column()
        return Item(value, self.kind("word") if self.take("AS") else None)

    def select(self) -> Select:
        items = None if self.take("*") else self.comma_list(self.item)
        self.need("FROM")
        q = Select(items, [])
        self.table_ref(q)
        while True:
            if self.take(","):
                self.table_ref(q)
            elif self.peek("SEMI"):
                self.need("SEMI")
                self.need("JOIN")
                right = self.plain_ref()
                self.need("ON")
                q.semi = (right, self.condition())
            elif self.take("JOIN"):
                self.table_ref(q)
                if self.take("ON"):
                    q.where += self.conditions()
            else:
                break
        q.where += self.where()
        if self.take("GROUP"):
            self.need("BY")
            q.group = self.comma_list(self.column)
        if self.take("HAVING"):
            q.having.append(self.having())
            while self.take("AND"):
                q.having.append(self.having())
        if self.take("ORDER"):
            self.need("BY")
            q.order = self.comma_list(self.order_key)
        if self.take("LIMIT"):
            q.limit = int(self.kind("int"))
        return q

    def having(self):
        agg, op = self.aggregate(), self.need("=", "<>", "<", ">", "<=", ">=")
        return agg, op, self.value()

    def order_key(self):
        col = self.column()
        return col, self.take("ASC", "DESC") == "DESC"

    def plain_ref(self) -> Ref:
        name = self.kind("word")
        self.take("AS")
        return Ref(name, self.kind("word") if self.is_kind("word") else name)

    def table_ref(self, q: Select) -> None:
        if not self.take("("):
            q.refs.append(self.plain_ref())
            return
        self.need("SELECT")
        branches = [self.select()]
        while self.take("UNION"):
            self.need("SELECT")
            branches.append(self.select())
        self.need(")")
        if len(branches) < 2:
            raise SyntaxFault("a derived table is a UNION")
        self.take("AS")
        q.refs.append(Derived(branches, self.kind("word")))


@functools.lru_cache(maxsize=512)
def parse(text: str):
    """A statement's dataclass; None for an empty text. Statements are kept by text, and nothing changes them."""
    if m := re.fullmatch(r"\s*load\s+(\S+)\s+into\s+([A-Za-z][A-Za-z0-9_]*)\s*;?\s*", text, re.I):
        return Load(m[1].strip("'\""), m[2])
    if re.fullmatch(r"\s*set\s+output_file\s+(on|off)\s*;?\s*", text, re.I):
        return Setting("output_file", not re.search(r"off\s*;?\s*$", text, re.I))
    if re.fullmatch(r"\s*crash\s*;?\s*", text, re.I):
        return TableCommand("crash")
    parser = Parser(text)
    return parser.statement() if parser.toks and parser.toks != [("op", ";")] else None


def split(script: str) -> list[str]:
    """The statements of a script, by semicolons outside of strings and comments."""
    out, at, start = [], 0, 0
    while at < len(script):
        m = TOKEN.match(script, at)
        end = m.end() if m else at + 1
        if m and m.lastgroup == "op" and m["op"] == ";":
            out.append(script[start:end])
            start = end
        at = end
    if script[start:].strip():
        out.append(script[start:])
    return [s for s in out if s.strip(" \t\r\n;")]
