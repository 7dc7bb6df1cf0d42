"""A small client over Engine: prepared statements, bound values and fetch modes."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession

from quillsql import streaming
from quillsql.engine import Engine
from quillsql.errors import SqlError


class Statement:
    """A prepared script; values are bound by number (from 1) or by name."""

    def __init__(self, connection: Connection, text: str):
        self.connection, self.text = connection, text
        self.values: dict = {}
        self.frame = None
        self._rows: Iterator | None = None

    def bind(self, name: int | str, value) -> Statement:
        self.values[str(name).lstrip(":@$")] = value
        return self

    def execute(self, params=None) -> Statement:
        values = dict(self.values)
        if params is not None:
            values |= params if isinstance(params, dict) else {str(i): v for i, v in enumerate(params, 1)}
        self.frame = self.connection.engine.sql(self.text, values)
        self._rows = None
        return self

    @property
    def columns(self) -> list[str]:
        return self.frame.columns if self.frame is not None else []

    @property
    def row_count(self) -> int:
        return self.connection.engine.changes

    def __iter__(self) -> Iterator[tuple]:
        """Rows one by one, a partition in memory at a time."""
        if self.frame is None:
            raise SqlError("the statement has not been executed")
        return streaming.rows(self.frame)

    def fetch(self):
        if self._rows is None:
            self._rows = iter(self)
        return next(self._rows, None)

    def fetch_all(self, mode: str = "num") -> list:
        """All rows: num (tuples), assoc (dicts), both, obj (Rows), column (first values) or pair (a dict of two columns)."""
        rows = self.frame.collect()
        if mode == "num":
            return [tuple(r) for r in rows]
        if mode == "assoc":
            return [r.asDict() for r in rows]
        if mode == "both":
            return [r.asDict() | dict(enumerate(r)) for r in rows]
        if mode == "obj":
            return rows
        if mode == "column":
            return [r[0] for r in rows]
        if mode == "pair":
            return dict((r[0], r[1]) for r in rows)
        raise SqlError(f"unknown fetch mode: {mode}")

    def fetch_column(self, n: int = 0):
        row = self.fetch()
        return None if row is None else row[n]


class Connection:
    def __init__(self, spark: SparkSession, path: str | None = None):
        self.engine = Engine(spark, path)

    def prepare(self, text: str) -> Statement:
        return Statement(self, text)

    def query(self, text: str) -> Statement:
        return Statement(self, text).execute()

    def exec(self, text: str) -> int:
        return self.engine.exec(text)

    def begin(self) -> None:
        self.engine.sql("BEGIN")

    def commit(self) -> None:
        self.engine.sql("COMMIT")

    def rollback(self) -> None:
        self.engine.sql("ROLLBACK")

    @property
    def in_transaction(self) -> bool:
        return self.engine.in_transaction

    def last_insert_id(self) -> int:
        return self.engine.last_rowid

    @staticmethod
    def quote(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"
