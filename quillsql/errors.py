"""Errors of the engine, with an SQLSTATE."""

from __future__ import annotations


class SqlError(Exception):
    sqlstate = "HY000"

    def __init__(self, message: str, sqlstate: str | None = None):
        super().__init__(message)
        if sqlstate:
            self.sqlstate = sqlstate


class ParseError(SqlError):
    sqlstate = "42000"


class ConstraintError(SqlError):
    sqlstate = "23000"
