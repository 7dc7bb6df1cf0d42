"""Aggregate functions, plain and over windows, as Spark SQL."""

from __future__ import annotations

from quillsql import types as ty
from quillsql.errors import SqlError

NAMES = frozenset("count sum total avg min max group_concat string_agg json_group_array json_group_object".split())


def _lower():
    from quillsql.dialect import lower

    return lower


def member(e) -> str:
    """A value as JSON text."""
    if e.kind == "json":
        return f"coalesce({e.sql}, 'null')"
    if e.kind in ("int", "bool"):
        return f"coalesce(CAST({e.sql} AS STRING), 'null')"
    if e.kind == "real":
        return f"coalesce({ty.real_text(e.sql)}, 'null')"
    if e.kind == "null":
        return "'null'"
    text = e.sql if e.kind in ("text", "any") else f"CAST({e.sql} AS STRING)"
    return f"coalesce({json_string(text)}, 'null')"


def json_string(text: str) -> str:
    """A text quoted as JSON; NULL stays NULL."""
    quoted = f"to_json(array({text}))"
    return f"CASE WHEN {text} IS NOT NULL THEN substr({quoted}, 2, length({quoted}) - 2) END"


def _collected(value: str, distinct: bool, by: str | None, desc: bool, tail: str) -> str:
    """An array of the values in order of by, else as they come."""
    if distinct:
        return f"array_distinct(collect_list({value}){tail})"
    if by is None:
        return f"collect_list({value}){tail}"
    rows = f"collect_list(struct({by} AS k, {value} AS v)){tail}"
    ordered = f"array_sort({rows})"
    if desc:
        ordered = f"reverse({ordered})"
    return f"transform({ordered}, r -> r.v)"


def _made(name: str, args: list, distinct: bool, star: bool, by: str | None, desc: bool, tail: str, window: bool):
    lower = _lower()
    expr, d = lower.Expr, "DISTINCT " if distinct and not window else ""
    if name == "count":
        if star or not args:
            return expr(f"count(*){tail}", "int")
        if distinct and window:
            return expr(f"CAST(size(collect_set({args[0].sql}){tail}) AS BIGINT)", "int")
        return expr(f"count({d}{args[0].sql}){tail}", "int")
    if not args:
        raise SqlError(f"wrong number of arguments to function {name}()")
    a = args[0]
    if name in ("sum", "total", "avg"):
        n = lower.numeric(a)
        if distinct and window:
            values = f"collect_set(CAST({n.sql} AS DOUBLE)){tail}"
            total = f"aggregate({values}, CAST(0 AS DOUBLE), (s, x) -> s + x)"
            if name == "avg":
                return expr(f"CASE WHEN size({values}) > 0 THEN {total} / size({values}) END", "real")
            if name == "total":
                return expr(total, "real")
            kept = f"CAST({total} AS BIGINT)" if n.kind == "int" else total
            return expr(f"CASE WHEN size({values}) > 0 THEN {kept} END", n.kind)
        if name == "sum":
            return expr(f"sum({d}{n.sql}){tail}", n.kind)
        if name == "total":
            return expr(f"coalesce(sum({d}CAST({n.sql} AS DOUBLE)){tail}, 0D)", "real")
        return expr(f"avg({d}{n.sql}){tail}", "real" if n.kind != "native" else "native")
    if name in ("min", "max"):
        value = lower.Lowering.collated(a.sql, a.collation)
        if value != a.sql and not window:
            return expr(f"{name}_by({a.sql}, {value}){tail}", a.kind)
        return expr(f"{name}({a.sql}){tail}", a.kind)
    if name in ("group_concat", "string_agg"):
        separator = lower.as_kind(args[1], "text") if len(args) > 1 else "','"
        text = lower.as_kind(a, "text")
        if by is not None and not distinct:
            # a NULL is skipped, though its row stands in the order
            rows = _collected(text, False, by, desc, tail)
            rows = f"filter({rows}, x -> x IS NOT NULL)"
        else:
            rows = _collected(text, distinct, None, False, tail)
        return expr(f"nullif(array_join({rows}, {separator if len(args) < 2 or args[1].is_literal else f'first({separator}){tail}'}), IF(size({rows}) = 0, '', NULL))", "text")
    if name == "json_group_array":
        rows = _collected(member(a), distinct, by, desc, tail)
        return expr(f"('[' || array_join({rows}, ',') || ']')", "json")
    key = f"coalesce({json_string(lower.as_kind(a, 'text'))}, 'null')"
    rows = _collected(f"({key} || ':' || {member(args[1])})", False, by, desc, tail)
    return expr(f"('{{' || array_join({rows}, ',') || '}}')", "json")


def plain(name: str, args: list, distinct: bool, star: bool, by: str | None, desc: bool, condition: str | None):
    return _made(name, args, distinct, star, by, desc, f" FILTER (WHERE {condition})" if condition else "", False)


def windowed(name: str, args: list, distinct: bool, star: bool, window: str, condition: str | None):
    if name not in NAMES:
        raise SqlError(f"no such window function: {name}")
    tail = f" FILTER (WHERE {condition})" if condition else ""
    return _made(name, args, distinct, star, None, False, f"{tail} OVER {window}", True)
