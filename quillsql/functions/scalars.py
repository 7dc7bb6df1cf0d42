"""Scalar functions, patterns and JSON operators as Spark SQL."""

from __future__ import annotations

import re

from quillsql import types as ty
from quillsql.errors import SqlError
from quillsql.functions.aggregates import json_string, member

VERSION = "0.1.0"
DIALECT_VERSION = "3.45.0"
#: Paths that Spark reads itself; others go to the functions of json_functions.
PLAIN_PATH = re.compile(r"\$(\.[A-Za-z_]\w*|\[\d+\])*")


def _lower():
    from quillsql.dialect import lower

    return lower


def _expr(sql: str, kind: str):
    return _lower().Expr(sql, kind)


def _text(e) -> str:
    return _lower().as_kind(e, "text")


def _int(e) -> str:
    n = _lower().numeric(e)
    return f"CAST({n.sql} AS INT)"


# -- patterns -------------------------------------------------------------------------------------


def glob_regex(pattern: str) -> str:
    """A GLOB pattern as an anchored regular expression."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("(?s:.*)")
        elif c == "?":
            out.append("(?s:.)")
        elif c == "[":
            end = pattern.find("]", i + 2 if pattern[i + 1 : i + 2] != "^" else i + 3)
            if end < 0:
                return r"(?!)"
            inside = pattern[i + 1 : end]
            no = inside.startswith("^")
            inside = re.sub(r"([\\\[\]&~^])", r"\\\1", inside[no:])
            out.append(f"[{'^' if no else ''}{inside}]")
            i = end
        else:
            out.append(re.sub(r"([^\w])", r"\\\1", c) if ord(c) < 128 else c)
        i += 1
    return "\\A" + "".join(out) + "\\z"


def like(op: str, value, pattern, escape, no: bool):
    if op == "MATCH":
        raise SqlError("unable to use function MATCH in the requested context")
    v, p = _text(value), _text(pattern)
    if op == "LIKE":
        # Spark's own escape character is the backslash; the dialect has none unless it is named
        mark = "\x01" if escape is None else escape
        if len(mark) != 1:
            raise SqlError("ESCAPE expression must be a single character")
        if escape is not None and pattern.is_literal and isinstance(pattern.literal, str):
            # Spark refuses an escape before an ordinary character; there it means nothing
            kept = re.sub(re.escape(mark) + "(.)", lambda m: m[0] if m[1] in "%_" + mark else m[1], pattern.literal, flags=re.S)
            p = ty.quote(kept)
        sql = f"({v} ILIKE {p} ESCAPE {ty.quote(mark)})"
    elif op == "GLOB":
        sql = f"({v} RLIKE {ty.quote(glob_regex(pattern.literal))})" if pattern.is_literal and pattern.literal is not None else f"quill_glob({p}, {v})"
    else:
        sql = f"({v} RLIKE {p})"
    return _expr(f"(NOT {sql})" if no else sql, "bool")


# -- JSON -----------------------------------------------------------------------------------------


def json_value(doc, path):
    """The value at a path: scalars as SQL values in text, containers as JSON."""
    if path.is_literal and isinstance(path.literal, str) and PLAIN_PATH.fullmatch(path.literal) and path.literal != "$":
        at = f"get_json_object({_text(doc)}, {path.sql})"
        return _expr(f"CASE {at} WHEN 'true' THEN quill_json_extract({_text(doc)}, {path.sql}) WHEN 'false' THEN quill_json_extract({_text(doc)}, {path.sql}) ELSE {at} END", "any")
    return _expr(f"quill_json_extract({_text(doc)}, {_text(path)})", "any")


def _label(path):
    """The right side of an arrow as a path."""
    if path.is_literal:
        p = path.literal
        if isinstance(p, int):
            return ty.quote(f"$[{p}]" if p >= 0 else f"$[#{p}]")
        return ty.quote(p if str(p).startswith("$") else f'$."{p}"')
    if path.kind == "int":
        return f"CASE WHEN {path.sql} < 0 THEN concat('$[#', {path.sql}, ']') ELSE concat('$[', {path.sql}, ']') END"
    return f"CASE WHEN {path.sql} LIKE '$%' THEN {path.sql} ELSE concat('$.\"', {path.sql}, '\"') END"


def arrow(op: str, doc, path):
    at = _label(path)
    if op == "->":
        return _expr(f"quill_json_at({_text(doc)}, {at})", "json")
    if path.is_literal and isinstance(path.literal, str) and re.fullmatch(r"[A-Za-z_]\w*", path.literal):
        return json_value(doc, _lower().literal(f"$.{path.literal}"))
    return _expr(f"quill_json_extract({_text(doc)}, {at})", "any")


def _changed(mode: str):
    def build(args):
        if len(args) < 3 or len(args) % 2 == 0:
            raise SqlError(f"json_{mode}() needs an odd number of arguments")
        doc = _text(args[0])
        for path, value in zip(args[1::2], args[2::2], strict=True):
            doc = f"quill_json_change({doc}, {_text(path)}, {member(value)}, '{mode}')"
        return _expr(doc, "json")

    return build


def _json_extract(args):
    if len(args) == 2:
        return json_value(args[0], args[1])
    parts = ", ".join(f"coalesce(quill_json_at({_text(args[0])}, {_text(p)}), 'null')" for p in args[1:])
    return _expr(f"CASE WHEN {_text(args[0])} IS NOT NULL THEN '[' || concat_ws(',', {parts}) || ']' END", "json")


def _json_object(args):
    if len(args) % 2:
        raise SqlError("json_object() requires an even number of arguments")
    parts = [f"{json_string(_text(k))} || ':' || {member(v)}" for k, v in zip(args[::2], args[1::2], strict=True)]
    inside = " || ',' || ".join(parts) if parts else "''"
    return _expr(f"('{{' || {inside} || '}}')", "json")


def _json_remove(args):
    doc = _text(args[0])
    for path in args[1:]:
        doc = f"quill_json_change({doc}, {_text(path)}, 'null', 'remove')"
    return _expr(doc, "json")


# -- texts and numbers ----------------------------------------------------------------------------


def _substr(args):
    x, start = _text(args[0]) if args[0].kind != "blob" else args[0].sql, _int(args[1])
    kind = "blob" if args[0].kind == "blob" else "text"
    n = f"length({x})"
    # the dialect counts from 1, from the end if negative, and takes a negative length to the left
    first = f"(CASE WHEN {start} > 0 THEN {start} WHEN {start} = 0 THEN 0 ELSE {n} + {start} + 1 END)"
    if len(args) == 2:
        return _expr(f"substr({x}, greatest({first}, 1))", kind)
    count = _int(args[2])
    low = f"(CASE WHEN {count} >= 0 THEN {first} ELSE {first} + {count} END)"
    high = f"(CASE WHEN {count} >= 0 THEN {first} + {count} ELSE {first} END)"
    return _expr(f"substr({x}, greatest({low}, 1), greatest({high} - greatest({low}, 1), 0))", kind)


def _trim(side: str):
    def build(args):
        x = _text(args[0])
        if len(args) == 1:
            return _expr(f"{ {'BOTH': 'trim', 'LEADING': 'ltrim', 'TRAILING': 'rtrim'}[side] }({x})", "text")
        return _expr(f"trim({side} {_text(args[1])} FROM {x})", "text")

    return build


def _char(args):
    if not args:
        return _expr("''", "text")
    if all(a.is_literal and isinstance(a.literal, int) for a in args):
        return _lower().literal("".join(chr(a.literal) for a in args))
    parts = [f"decode(unhex(lpad(hex(CAST({_lower().numeric(a).sql} AS BIGINT)), 4, '0')), 'UTF-16BE')" for a in args]
    return _expr(f"concat({', '.join(parts)})", "text")


def _quote(args):
    a = args[0]
    if a.kind in ("int", "real", "bool"):
        return _expr(f"coalesce({_text(a)}, 'NULL')", "text")
    if a.kind == "blob":
        return _expr(f"coalesce('X\\'' || hex({a.sql}) || '\\'', 'NULL')", "text")
    return _expr(f"coalesce('\\'' || replace({_text(a)}, '\\'', '\\'\\'') || '\\'', 'NULL')", "text")


def _format(args):
    if not args[0].is_literal:
        return _expr(f"format_string({', '.join(a.sql for a in args)})", "text")
    text = args[0].literal
    if text is None:
        return _expr("CAST(NULL AS STRING)", "text")
    out, rest = [], list(args[1:])

    def one(m) -> str:
        flags, kind = m[1], m[2]
        if kind == "%":
            return "%%"
        a = rest.pop(0) if rest else _lower().literal(None)
        n = _lower().numeric(a)
        if kind in "diu":
            out.append(f"CAST({n.sql} AS BIGINT)")
            return f"%{flags}d"
        if kind in "fFeEgG":
            out.append(f"CAST({n.sql} AS DOUBLE)")
            return f"%{flags}{kind.replace('F', 'f')}"
        if kind in "xXo":
            out.append(f"CAST({n.sql} AS BIGINT)")
            return f"%{flags}{kind}"
        if kind == "c":
            out.append(f"left({_text(a)}, 1)")
            return f"%{flags}s"
        if kind in "qQ":
            out.append(_quote([a]).sql if kind == "Q" else f"replace({_text(a)}, '\\'', '\\'\\'')")
            return f"%{flags}s"
        out.append(f"coalesce({_text(a)}, '')")
        return f"%{flags}s"

    pattern = re.sub(r"%([-+ 0#,]*\d*(?:\.\d+)?)([diufFeEgGxXosczqQ%])", one, text)
    return _expr(f"format_string({', '.join([ty.quote(pattern), *out])})", "text")


def _round(args):
    x = f"CAST({_lower().numeric(args[0]).sql} AS DOUBLE)"
    if len(args) == 1:
        return _expr(f"round({x}, 0)", "real")
    if args[1].is_literal:
        return _expr(f"round({x}, {max(0, int(args[1].literal or 0))})", "real")
    return _expr(f"(round({x} * power(10, {_int(args[1])}), 0) / power(10, {_int(args[1])}))", "real")


def _abs(args):
    n = _lower().numeric(args[0])
    return _expr(f"abs({n.sql})", n.kind)


def _extreme(name: str):
    def build(args):
        kind = _lower().unified([a.kind for a in args])
        sides = [_lower().as_kind(a, kind) for a in args]
        nulls = " OR ".join(f"{s} IS NULL" for s in sides)
        return _expr(f"CASE WHEN {nulls} THEN NULL ELSE {name}({', '.join(sides)}) END", kind)

    return build


def _first_of(args):
    kind = _lower().unified([a.kind for a in args])
    return _expr(f"coalesce({', '.join(_lower().as_kind(a, kind) for a in args)})", kind)


def _nullif(args):
    same = _lower().Lowering(lambda _: None).compare("=", args[0], args[1]).sql
    return _expr(f"CASE WHEN {same} THEN NULL ELSE {args[0].sql} END", args[0].kind)


def _typeof(args):
    a = args[0]
    name = {"int": "integer", "bool": "integer", "real": "real", "blob": "blob", "null": "null"}.get(a.kind, "text")
    if a.kind == "any":
        whole = ty.whole_number(a.sql)
        return _expr(f"CASE WHEN {a.sql} IS NULL THEN 'null' WHEN {whole} IS NULL THEN 'text' WHEN {a.sql} RLIKE '[.eE]' THEN 'real' ELSE 'integer' END", "text")
    return _expr("'null'" if name == "null" else f"CASE WHEN {a.sql} IS NULL THEN 'null' ELSE '{name}' END", "text")


def _length(args):
    a = args[0]
    return _expr(f"CAST(length({a.sql if a.kind == 'blob' else _text(a)}) AS BIGINT)", "int")


def _simple(template: str, kind: str, as_text: bool = True):
    def build(args):
        return _expr(template.format(*[_text(a) if as_text else a.sql for a in args]), kind)

    return build


def _now(pattern: str):
    return lambda args: _expr(f"date_format(to_utc_timestamp(current_timestamp(), current_timezone()), '{pattern}')", "text")


def _glob_call(args):
    return like("GLOB", args[1], args[0], None, False)


def _like_call(args):
    return like("LIKE", args[1], args[0], args[2].literal if len(args) > 2 else None, False)


#: name: (fewest arguments, most (None: any number), builder)
FUNCTIONS = {
    "length": (1, 1, _length),
    "lower": (1, 1, _simple("lower({0})", "text")),
    "lcase": (1, 1, _simple("lower({0})", "text")),
    "upper": (1, 1, _simple("upper({0})", "text")),
    "ucase": (1, 1, _simple("upper({0})", "text")),
    "trim": (1, 2, _trim("BOTH")),
    "ltrim": (1, 2, _trim("LEADING")),
    "rtrim": (1, 2, _trim("TRAILING")),
    "substr": (2, 3, _substr),
    "substring": (2, 3, _substr),
    "replace": (3, 3, _simple("replace({0}, {1}, {2})", "text")),
    "instr": (2, 2, _simple("CAST(instr({0}, {1}) AS BIGINT)", "int")),
    "char": (0, None, _char),
    "unicode": (1, 1, _simple("CAST(ascii(nullif({0}, '')) AS BIGINT)", "int")),
    "hex": (1, 1, lambda a: _expr(f"hex({a[0].sql if a[0].kind == 'blob' else _text(a[0])})", "text")),
    "quote": (1, 1, _quote),
    "printf": (1, None, _format),
    "format": (1, None, _format),
    "abs": (1, 1, _abs),
    "round": (1, 2, _round),
    "sign": (1, 1, lambda a: _expr(f"CAST(signum(CAST({_lower().numeric(a[0]).sql} AS DOUBLE)) AS INT)", "int")),
    "max": (2, None, _extreme("greatest")),
    "min": (2, None, _extreme("least")),
    "coalesce": (2, None, _first_of),
    "ifnull": (2, 2, _first_of),
    "nullif": (2, 2, _nullif),
    "typeof": (1, 1, _typeof),
    "random": (0, 0, lambda a: _expr("CAST((rand() - 0.5D) * 18446744073709551615D AS BIGINT)", "int")),
    "randomblob": (1, 1, lambda a: _expr(f"quill_random_blob(greatest({_int(a[0])}, 1))", "blob")),
    "zeroblob": (1, 1, lambda a: _expr(f"unhex(repeat('00', greatest({_int(a[0])}, 0)))", "blob")),
    "sqlite_version": (0, 0, lambda a: _lower().literal(DIALECT_VERSION)),
    "quillsql_version": (0, 0, lambda a: _lower().literal(VERSION)),
    "current_date": (0, 0, _now("yyyy-MM-dd")),
    "current_time": (0, 0, _now("HH:mm:ss")),
    "current_timestamp": (0, 0, _now("yyyy-MM-dd HH:mm:ss")),
    "like": (2, 3, _like_call),
    "glob": (2, 2, _glob_call),
    "json": (1, 1, _simple("quill_json({0})", "json")),
    "json_valid": (1, 1, _simple("quill_json_valid({0})", "int")),
    "json_type": (1, 2, lambda a: _expr(f"quill_json_type({_text(a[0])}, {_text(a[1]) if len(a) > 1 else chr(39) + '$' + chr(39)})", "text")),
    "json_extract": (2, None, _json_extract),
    "json_array": (0, None, lambda a: _expr("('[' || " + (" || ',' || ".join(member(x) for x in a) or "''") + " || ']')", "json")),
    "json_object": (0, None, _json_object),
    "json_array_length": (1, 2, lambda a: _expr(f"quill_json_array_length({_text(a[0])}, {_text(a[1]) if len(a) > 1 else chr(39) + '$' + chr(39)})", "int")),
    "json_quote": (1, 1, lambda a: _expr(member(a[0]), "json")),
    "json_set": (3, None, _changed("set")),
    "json_insert": (3, None, _changed("insert")),
    "json_replace": (3, None, _changed("replace")),
    "json_remove": (1, None, _json_remove),
    "json_patch": (2, 2, _simple("quill_json_patch({0}, {1})", "json")),
    "date": (1, 1, lambda a: _expr(f"CAST(CAST({a[0].sql} AS DATE) AS STRING)", "text")),
}


def call(name: str, args: list):
    if name not in FUNCTIONS:
        raise SqlError(f"no such function: {name}")
    fewest, most, build = FUNCTIONS[name]
    if len(args) < fewest or most is not None and len(args) > most:
        raise SqlError(f"wrong number of arguments to function {name}()")
    return build(args)
