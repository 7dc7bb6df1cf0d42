"""The syntax tree. Nodes are plain dataclasses; equal trees compare equal."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Literal:
    value: object  # None, int, float, str, bytes


@dataclass(frozen=True)
class Param:
    name: str  # a number as text, or a name


@dataclass(frozen=True)
class Col:
    name: str
    table: str | None = None
    quoted: bool = False


@dataclass(frozen=True)
class Star:
    table: str | None = None


@dataclass(frozen=True)
class Unary:
    op: str
    value: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Between:
    value: object
    low: object
    high: object
    no: bool = False


@dataclass(frozen=True)
class InList:
    value: object
    items: tuple
    no: bool = False


@dataclass(frozen=True)
class InSelect:
    value: object
    query: object
    no: bool = False


@dataclass(frozen=True)
class Like:
    op: str
    value: object
    pattern: object
    escape: object = None
    no: bool = False


@dataclass(frozen=True)
class Exists:
    query: object


@dataclass(frozen=True)
class Scalar:
    query: object


@dataclass(frozen=True)
class Case:
    base: object
    whens: tuple
    other: object


@dataclass(frozen=True)
class Cast:
    value: object
    kind: str


@dataclass(frozen=True)
class Collate:
    value: object
    name: str


@dataclass(frozen=True)
class Frame:
    unit: str
    start: tuple  # (kind, expression or None): kind in up, p, c, f, uf
    end: tuple


@dataclass(frozen=True)
class Over:
    partition: tuple
    order: tuple
    frame: Frame | None = None


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    distinct: bool = False
    star: bool = False
    filter: object = None
    over: Over | None = None


@dataclass(frozen=True)
class Order:
    expr: object
    desc: bool = False
    nulls: str | None = None


@dataclass(frozen=True)
class Item:
    expr: object
    alias: str | None = None
    label: str = ""


@dataclass(frozen=True)
class TableRef:
    name: str
    alias: str | None = None
    args: tuple | None = None  # of a table-valued function


@dataclass(frozen=True)
class Derived:
    query: object
    alias: str | None = None


@dataclass(frozen=True)
class Join:
    kind: str  # inner, left, right, full, cross
    source: object
    on: object = None
    using: tuple = ()
    natural: bool = False


@dataclass(frozen=True)
class Select:
    items: tuple
    source: object = None
    joins: tuple = ()
    where: object = None
    group: tuple = ()
    having: object = None
    distinct: bool = False


@dataclass(frozen=True)
class Values:
    rows: tuple


@dataclass(frozen=True)
class SetOp:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Cte:
    name: str
    columns: tuple
    query: object


@dataclass(frozen=True)
class Query:
    body: object
    order: tuple = ()
    limit: object = None
    offset: object = None
    ctes: tuple = ()
    recursive: bool = False


@dataclass
class ColumnDef:
    name: str
    kind: str = ""
    not_null: bool = False
    primary: bool = False
    primary_desc: bool = False
    auto: bool = False
    unique: bool = False
    default: object = None
    default_sql: str | None = None
    collation: str | None = None
    check: list = field(default_factory=list)
    references: object = None
    generated: object = None
    stored: bool = False


@dataclass
class ForeignKey:
    columns: tuple
    table: str
    targets: tuple = ()
    on_delete: str = "NO ACTION"
    on_update: str = "NO ACTION"


@dataclass
class CreateTable:
    name: str
    columns: list
    primary: tuple = ()
    uniques: list = field(default_factory=list)
    checks: list = field(default_factory=list)
    foreign: list = field(default_factory=list)
    if_not_exists: bool = False
    query: object = None
    sql: str = ""


@dataclass
class CreateIndex:
    name: str
    table: str
    columns: tuple
    unique: bool = False
    where: object = None
    if_not_exists: bool = False
    sql: str = ""


@dataclass
class CreateView:
    name: str
    columns: tuple
    query: object
    if_not_exists: bool = False
    sql: str = ""


@dataclass
class CreateTrigger:
    name: str
    timing: str
    event: str
    of: tuple
    table: str
    when: object
    body: list
    if_not_exists: bool = False
    sql: str = ""


@dataclass
class Drop:
    kind: str
    name: str
    if_exists: bool = False


@dataclass
class Alter:
    table: str
    action: str
    name: str = ""
    to: str = ""
    column: ColumnDef | None = None


@dataclass
class Upsert:
    target: tuple
    sets: tuple | None  # None: do nothing
    where: object = None


@dataclass
class Insert:
    table: str
    columns: tuple
    query: object  # None: default values
    conflict: str = "ABORT"
    upserts: tuple = ()
    returning: tuple = ()


@dataclass
class Update:
    table: str
    sets: tuple
    where: object = None
    conflict: str = "ABORT"
    returning: tuple = ()


@dataclass
class Delete:
    table: str
    where: object = None
    returning: tuple = ()


@dataclass
class Transaction:
    action: str  # begin, commit, rollback, savepoint, release, rollback_to
    name: str = ""


@dataclass
class Pragma:
    name: str
    value: object = None


@dataclass
class Explain:
    statement: object
    plan: bool = False
