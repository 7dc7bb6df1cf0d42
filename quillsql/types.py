"""Column kinds, declared-type affinity, and SQL snippets that convert between kinds.

Kinds: int, real, text, blob, bool, json (text that is JSON), any (a text that may spell a number), null,
and native (dates, timestamps, decimals of files that were not written by the engine).
"""

from __future__ import annotations

from pyspark.sql import types as T

NUMERIC = ("int", "real", "bool")
SPARK = {"int": "BIGINT", "real": "DOUBLE", "text": "STRING", "blob": "BINARY", "json": "STRING", "any": "STRING", "bool": "INT", "null": "STRING"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NUMBER = r"^\\s*([+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?)"
_WHOLE = r"^\\s*([+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?)\\s*$"


def affinity(declared: str) -> str:
    """The affinity of a declared type: the first rule that fits."""
    name = declared.upper()
    if "INT" in name:
        return "INTEGER"
    if any(w in name for w in ("CHAR", "CLOB", "TEXT")):
        return "TEXT"
    if "BLOB" in name or not name.strip():
        return "BLOB"
    if any(w in name for w in ("REAL", "FLOA", "DOUB")):
        return "REAL"
    return "NUMERIC"


def kind_of_declared(declared: str) -> str:
    """How a column of the declared type is kept."""
    name = declared.upper()
    if "BOOL" in name:
        return "int"
    if name.startswith(("DATE", "TIME")):
        return "text"
    if not name.strip():
        return "any"
    return {"INTEGER": "int", "TEXT": "text", "BLOB": "blob", "REAL": "real", "NUMERIC": "real"}[affinity(declared)]


def kind_of_spark(kind: T.DataType) -> str:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "real"
    if isinstance(kind, T.StringType):
        return "text"
    if isinstance(kind, T.BinaryType):
        return "blob"
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.NullType):
        return "null"
    return "native"


def quote(text: str) -> str:
    """A Spark string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def number(x: str) -> str:
    """The numeric prefix of a text, 0 without one, NULL for NULL."""
    return f"CASE WHEN {x} IS NULL THEN NULL ELSE coalesce(try_cast(regexp_extract({x}, '{_NUMBER}', 1) AS DOUBLE), 0D) END"


def whole_number(x: str) -> str:
    """The number that a text spells, else NULL."""
    return f"try_cast(nullif(regexp_extract({x}, '{_WHOLE}', 1), '') AS DOUBLE)"


def real_text(x: str) -> str:
    """A double as text: fifteen digits at most, always with a point or an exponent."""
    plain = f"CAST(CAST({x} AS DECIMAL(38, 12)) AS STRING)"
    trimmed = f"regexp_replace(regexp_replace({plain}, '0+$', ''), '\\\\.$', '.0')"
    far = f"regexp_replace(regexp_replace(lower(CAST({x} AS STRING)), 'e([0-9])', 'e+$1'), 'e([+-])([0-9])$', 'e$10$2')"
    return f"CASE WHEN {x} = 0 THEN '0.0' WHEN abs({x}) >= 1e-4 AND abs({x}) < 1e15 THEN {trimmed} ELSE {far} END"


def nocase(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"
