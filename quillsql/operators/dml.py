"""INSERT, UPDATE and DELETE as transforms of snapshots, with constraints, foreign keys and triggers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsql import types as ty
from quillsql.catalog import ROWID, Table
from quillsql.dialect import tree as t
from quillsql.dialect.lower import Column as Name
from quillsql.dialect.lower import Expr, Scope, Source, as_kind
from quillsql.dialect.parser import rebuilt
from quillsql.errors import ConstraintError, SqlError

SEQ = "_seq"


def stored(e: Expr, kind: str) -> str:
    """An expression as it is stored in a column of a kind."""
    if e.kind in ("text", "any") and kind in ("int", "real") and e.is_literal is False:
        # affinity on write: a text that spells no number would stay text, which a typed column can't hold
        return f"CAST({ty.whole_number(e.sql)} AS {ty.SPARK[kind]})"
    if e.kind == "native" and kind in ("text", "any"):
        return f"CAST({e.sql} AS STRING)"
    return f"CAST({as_kind(e, kind)} AS {ty.SPARK[kind]})"


def renamed_columns(node, before: str, after: str):
    def change(n):
        return t.Col(after, n.table, n.quoted) if isinstance(n, t.Col) and n.name.lower() == before.lower() else n

    return rebuilt(node, change)


def rendered(table: Table) -> str:
    """A CREATE TABLE statement of a table as it is now."""
    parts = []
    for c in table.columns:
        words = [f'"{c.name}"' if not c.name.isidentifier() else c.name, c.kind]
        words += ["PRIMARY KEY"] * c.primary + ["NOT NULL"] * c.not_null + ["UNIQUE"] * c.unique
        if c.default_sql is not None:
            words.append(f"DEFAULT {c.default_sql}" if not c.default_sql.startswith("(") else f"DEFAULT {c.default_sql}")
        if c.collation:
            words.append(f"COLLATE {c.collation}")
        parts.append(" ".join(w for w in words if w))
    parts += [f"CHECK ({text})" for _, text in table.checks]
    if table.primary:
        parts.append(f"PRIMARY KEY ({', '.join(table.primary)})")
    parts += [f"UNIQUE ({', '.join(u)})" for u in table.uniques]
    for f in table.foreign:
        targets = f" ({', '.join(f.targets)})" if f.targets else ""
        parts.append(f"FOREIGN KEY ({', '.join(f.columns)}) REFERENCES {f.table}{targets} ON DELETE {f.on_delete} ON UPDATE {f.on_update}")
    return f"CREATE TABLE {table.name}({', '.join(parts)})"


# -- constraints ----------------------------------------------------------------------------------


def with_generated(engine, table: Table, frame: DataFrame) -> DataFrame:
    """frame with generated columns computed, those that others need first."""
    left = {c.name.lower(): c for c in table.columns if c.generated is not None}
    while left:
        ready = []
        for name, c in left.items():
            needs: set = set()
            rebuilt(c.generated, lambda n, needs=needs: (needs.add(n.name.lower()) if isinstance(n, t.Col) else None) or n)
            if not needs & (left.keys() - {name}):
                ready.append(name)
        if not ready:
            raise SqlError("generated column loop")
        for name in ready:
            c = left.pop(name)
            e = engine.lowering().value(c.generated, engine.scope(table))
            frame = frame.withColumn(c.name, F.expr(stored(e, ty.kind_of_declared(c.kind))))
    return frame


def _key_columns(engine, table: Table, key: tuple) -> list[Column]:
    out = []
    for n in key:
        c = table.column(n)
        sql = ty.ident(c.name)
        out.append(F.expr(ty.nocase(sql) if c.collation == "NOCASE" else f"rtrim({sql})" if c.collation == "RTRIM" else sql))
    return out


def _keyed(engine, table: Table, frame: DataFrame, key: tuple, where, prefix: str) -> DataFrame:
    """frame with the key's values as prefix0.., without rows that the key exempts (NULLs, a partial condition)."""
    columns = [c.alias(f"{prefix}{i}") for i, c in enumerate(_key_columns(engine, table, key))]
    if where is not None:
        frame = frame.where(engine.lowering().truth(where, engine.scope(table)))
    kept = frame.select("*", *columns)
    for i in range(len(key)):
        kept = kept.where(F.col(f"{prefix}{i}").isNotNull())
    return kept


def all_keys(engine, table: Table) -> list[tuple[tuple, object]]:
    keys = engine.state.unique_keys(table)
    return ([((table.rowid_alias,), None)] if table.rowid_alias else []) + keys


def check_unique(engine, table: Table, frame: DataFrame, keys: list) -> None:
    """Raise if two rows of frame share a key."""
    for key, where in keys:
        keyed = _keyed(engine, table, frame, key, where, "_k")
        if not keyed.groupBy(*[f"_k{i}" for i in range(len(key))]).count().where("count > 1").isEmpty():
            raise ConstraintError(f"UNIQUE constraint failed: {', '.join(f'{table.name}.{k}' for k in key)}")


def _meets(engine, table: Table, new: DataFrame, base: DataFrame, key: tuple, where, how: str) -> DataFrame:
    """new's rows that have (left_semi) a partner with the same key in base."""
    a = _keyed(engine, table, new, key, where, "_a")
    b = _keyed(engine, table, base, key, where, "_b").select(*[f"_b{i}" for i in range(len(key))])
    test = reduce(lambda x, y: x & y, [F.col(f"_a{i}") == F.col(f"_b{i}") for i in range(len(key))])
    return a.join(b, test, how).drop(*[f"_a{i}" for i in range(len(key))])


def _failing(engine, table: Table) -> list[tuple[Column, str]]:
    """(condition that a bad row meets, message) of NOT NULL and CHECK."""
    found = [(F.col(ty.ident(c.name)).isNull(), f"NOT NULL constraint failed: {table.name}.{c.name}") for c in table.columns if c.not_null and c.name != table.rowid_alias]
    for check, text in table.checks:
        test = engine.lowering().truth(check, engine.scope(table))
        found.append((~F.coalesce(F.expr(test), F.lit(True)), f"CHECK constraint failed: {text}"))
    return found


def check_rows(engine, table: Table, frame: DataFrame) -> None:
    """Raise if a row breaks NOT NULL or CHECK: one aggregate for all of them."""
    failing = _failing(engine, table)
    if not failing:
        return
    counts = frame.agg(*[F.count(F.when(bad, 1)).alias(f"c{i}") for i, (bad, _) in enumerate(failing)]).first()
    for n, (_, message) in zip(counts, failing, strict=True):
        if n:
            raise ConstraintError(message)


# -- foreign keys ---------------------------------------------------------------------------------


def _targets(engine, f: t.ForeignKey) -> tuple:
    parent = engine.state.table(f.table)
    if f.targets:
        return f.targets
    return tuple(parent.primary) or tuple(c.name for c in parent.columns if c.primary)


def check_children(engine, table: Table, rows: DataFrame) -> None:
    """Raise if a row's foreign key has no parent; a NULL in the key exempts it."""
    if not engine.foreign_keys:
        return
    for f in table.foreign:
        child = rows.select(*[F.col(ty.ident(table.column(c).name)).alias(f"_c{i}") for i, c in enumerate(f.columns)]).dropna()
        parent = engine.frame(engine.state.table(f.table)).select(*[F.col(ty.ident(p)).alias(f"_p{i}") for i, p in enumerate(_targets(engine, f))])
        test = reduce(lambda x, y: x & y, [F.col(f"_c{i}") == F.col(f"_p{i}") for i in range(len(f.columns))])
        if not child.join(parent, test, "left_anti").isEmpty():
            raise ConstraintError("FOREIGN KEY constraint failed")


def parents_gone(engine, parent: Table, old: DataFrame, new: DataFrame | None) -> None:
    """Act on the children of parent rows that went (old) or got other keys (old and new by ROWID)."""
    if not engine.foreign_keys:
        return
    for child in list(engine.state.tables.values()):
        for f in child.foreign:
            if f.table.lower() != parent.name.lower():
                continue
            child = engine.state.table(child.name)
            targets = _targets(engine, f)
            lost = old.select(F.col(ROWID).alias("_r"), *[F.col(ty.ident(p)).alias(f"_p{i}") for i, p in enumerate(targets)])
            if new is not None:
                fresh = new.select(F.col(ROWID).alias("_r"), *[F.col(ty.ident(p)).alias(f"_n{i}") for i, p in enumerate(targets)])
                lost = lost.join(fresh, "_r").where(reduce(lambda x, y: x | y, [~F.col(f"_p{i}").eqNullSafe(F.col(f"_n{i}")) for i in range(len(targets))]))
            lost = engine.cut(lost)
            frame = engine.frame(child)
            hit = frame.join(lost, reduce(lambda x, y: x & y, [F.col(ty.ident(child.column(c).name)) == F.col(f"_p{i}") for i, c in enumerate(f.columns)]))
            action = f.on_delete if new is None else f.on_update
            if hit.isEmpty():
                continue
            if action in ("NO ACTION", "RESTRICT"):
                # a row of the same key may be there again
                now = engine.frame(engine.state.table(parent.name)).select(*[F.col(ty.ident(p)).alias(f"_q{i}") for i, p in enumerate(targets)])
                back = reduce(lambda x, y: x & y, [F.col(f"_p{i}") == F.col(f"_q{i}") for i in range(len(targets))])
                if action == "RESTRICT" or not hit.join(now, back, "left_anti").isEmpty():
                    raise ConstraintError("FOREIGN KEY constraint failed")
                continue
            hit = engine.cut(hit.select(ROWID, *([f"_n{i}" for i in range(len(targets))] if new is not None else [])))
            if action == "CASCADE" and new is None:
                remove(engine, child, frame.join(hit.select(ROWID).distinct(), ROWID, "left_semi"))
                continue
            sets = {}
            for i, c in enumerate(f.columns):
                column = child.column(c)
                if action == "CASCADE":
                    sets[column.name] = F.col(f"_n{i}")
                else:
                    default = column.default if action == "SET DEFAULT" and column.default is not None else t.Literal(None)
                    sets[column.name] = F.expr(stored(engine.lowering().value(default, Scope()), ty.kind_of_declared(column.kind)))
            changed = frame.join(hit.dropDuplicates([ROWID]), ROWID)
            changed = changed.select(F.col(ROWID), *[(sets[c.name] if c.name in sets else F.col(ty.ident(c.name))).alias(c.name) for c in child.columns])
            replace_rows(engine, child, engine.cut(with_generated(engine, child, changed)), frame)


# -- writing --------------------------------------------------------------------------------------


def _plain(table: Table, frame: DataFrame) -> DataFrame:
    return frame.select(F.col(ROWID), *[F.col(ty.ident(c.name)) for c in table.columns])


def append(engine, table: Table, rows: DataFrame) -> None:
    part = engine.new_part(table)
    _plain(table, rows).write.parquet(part)
    table.parts = (*table.parts, part)


def _rewrite(engine, table: Table, ids: DataFrame, plus: DataFrame | None) -> None:
    """Take the rows with these ids out, and add others; only parts that hold such rows are written anew."""
    touched = set(table.parts)
    if len(table.parts) > 1:
        marked = engine.frame(table).select(ROWID, F.regexp_extract(F.input_file_name(), "^(.*)/[^/]*$", 1).alias("_part"))
        hit = {r["_part"].rstrip("/").rpartition("/")[2] for r in marked.join(ids, ROWID, "left_semi").select("_part").distinct().collect()}
        touched = {p for p in table.parts if p.rpartition("/")[2] in hit}
    rest = tuple(p for p in table.parts if p not in touched)
    out = None
    if touched:
        out = engine.spark.read.schema(table.schema()).parquet(*touched).join(ids, ROWID, "left_anti")
    if plus is not None:
        plus = _plain(table, plus)
        out = plus if out is None else _plain(table, out).unionAll(plus)
    if out is not None:
        part = engine.new_part(table)
        _plain(table, out).write.parquet(part)
        rest = (*rest, part)
    table.parts = rest


def remove(engine, table: Table, rows: DataFrame, held: bool = False) -> None:
    """Delete rows, with what hangs on them by foreign keys. held: the rows have been written already."""
    gone = rows if held else engine.cut(_plain(table, rows))
    if gone.isEmpty():
        return
    _rewrite(engine, table, gone.select(ROWID), None)
    parents_gone(engine, table, gone, None)


def replace_rows(engine, table: Table, changed: DataFrame, old: DataFrame, conflict: str = "ABORT") -> DataFrame:
    """Put changed rows in place of those with their ids; the rows really changed."""
    check_rows(engine, table, changed)
    before = _plain(table, old.join(changed.select(ROWID), ROWID, "left_semi"))  # parts never change, so this stays what it is
    others = engine.frame(table).join(changed.select(ROWID), ROWID, "left_anti")
    for key, where in all_keys(engine, table):
        if conflict == "IGNORE":
            clash = _meets(engine, table, changed, others, key, where, "left_semi").select(ROWID)
            keyed = _keyed(engine, table, changed, key, where, "_k")
            first = Window.partitionBy(*[f"_k{i}" for i in range(len(key))]).orderBy(ROWID)
            later = keyed.withColumn("_n", F.row_number().over(first)).where("_n > 1").select(ROWID)
            changed = engine.cut(changed.join(clash.unionAll(later), ROWID, "left_anti"))
            before = before.join(changed.select(ROWID), ROWID, "left_semi")
        elif conflict == "REPLACE":
            remove(engine, table, _meets(engine, table, others, changed, key, where, "left_semi"))
            others = engine.frame(table).join(changed.select(ROWID), ROWID, "left_anti")
        else:
            if not _meets(engine, table, changed, others, key, where, "left_semi").isEmpty():
                raise ConstraintError(f"UNIQUE constraint failed: {', '.join(f'{table.name}.{k}' for k in key)}")
            check_unique(engine, table, changed, [(key, where)])
    check_after = changed
    if table.rowid_alias:
        moved = changed.withColumn("_old", F.col(ROWID)).withColumn(ROWID, F.col(ty.ident(table.rowid_alias)))
        _rewrite(engine, table, changed.select(ROWID), moved)
        top = moved.agg(F.max(ROWID)).first()[0]
        table.top = max(table.top, top or 0)
    else:
        _rewrite(engine, table, changed.select(ROWID), changed)
    check_children(engine, table, check_after)
    parents_gone(engine, table, before, changed)
    return changed


# -- triggers -------------------------------------------------------------------------------------


def _triggers(engine, table: str, timing: str, event: str, columns: set | None = None) -> list[t.CreateTrigger]:
    return [
        x
        for x in engine.state.triggers.values()
        if x.table.lower() == table.lower() and x.timing == timing and x.event == event and x.name.lower() not in engine.firing
        and (not x.of or columns is None or {c.lower() for c in x.of} & columns)
    ]


def fire(engine, triggers: list, names: list[str], pairs: DataFrame, params: dict) -> None:
    """Run triggers for every row of pairs (columns old_0.., new_0.. of names, as there are), in ROWID order."""
    from quillsql.engine import MOST_TRIGGERED

    if not triggers:
        return
    rows = pairs.limit(MOST_TRIGGERED + 1).collect()
    if len(rows) > MOST_TRIGGERED:
        raise SqlError(f"triggers run row by row; more than {MOST_TRIGGERED} rows changed")
    for row in rows:
        values = row.asDict()
        constants = {}
        for side in ("old", "new"):
            for i, n in enumerate(names):
                if f"{side}_{i}" in values:
                    constants[f"{side}.{n.lower()}"] = values[f"{side}_{i}"]
            if f"{side}_rowid" in values:
                constants[f"{side}.rowid"] = values[f"{side}_rowid"]
        for x in triggers:
            if x.when is not None:
                test = engine.lowering(params, constants).truth(x.when, Scope())
                if not engine.spark.sql(f"SELECT coalesce({test}, FALSE)").first()[0]:
                    continue
            engine.firing.append(x.name.lower())
            kept = engine.changes, engine.last_rowid
            try:
                for s in x.body:
                    bound = _bind(s, constants)
                    engine.query(bound, params).collect() if isinstance(bound, t.Query) else engine.change(bound, params)
            finally:
                engine.firing.pop()
                engine.changes, engine.last_rowid = kept


def _bind(statement, constants: dict):
    """The statement with NEW and OLD columns as literals."""

    def change(n):
        if isinstance(n, t.Col) and n.table and f"{n.table}.{n.name}".lower() in constants:
            value = constants[f"{n.table}.{n.name}".lower()]
            return t.Literal(bytes(value) if isinstance(value, bytearray) else value)
        return n

    return rebuilt(statement, change)


def _sides(table: Table, old: DataFrame | None, new: DataFrame | None) -> DataFrame:
    def side(frame: DataFrame, name: str) -> DataFrame:
        return frame.select(F.col(ROWID), F.col(ROWID).alias(f"{name}_rowid"), *[F.col(ty.ident(c.name)).alias(f"{name}_{i}") for i, c in enumerate(table.columns)])

    if old is None:
        return side(new, "new").orderBy(ROWID).drop(ROWID)
    if new is None:
        return side(old, "old").orderBy(ROWID).drop(ROWID)
    return side(old, "old").join(side(new, "new"), ROWID).orderBy(ROWID).drop(ROWID)


# -- returning ------------------------------------------------------------------------------------


def returned(engine, table: Table, rows: DataFrame, items: tuple, params: dict) -> DataFrame | None:
    if not items:
        return None
    relation = engine.as_relation(_plain(table, rows), engine.columns(table), ROWID)
    engine.overlay[table.name.lower()] = relation
    try:
        sql, _ = engine.lowering(params).query(t.Query(t.Select(items, t.TableRef(table.name)), (t.Order(t.Col("rowid")),)))
    finally:
        del engine.overlay[table.name.lower()]
    return engine.spark.sql(sql)


# -- INSERT ---------------------------------------------------------------------------------------


def numbered(engine, frame: DataFrame) -> DataFrame:
    """frame, written, with SEQ: its rows numbered from 1 in their order, without a sort or a single task."""
    held = engine.cut(frame.withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_m", 33)
    sizes = sorted(held.groupBy(part.alias("p")).count().collect())
    at, offsets = 0, {}
    for p, n in sizes:
        offsets[p] = at
        at += n
    if not offsets:
        return held.withColumn(SEQ, F.lit(0).cast("long")).drop("_m")
    table = F.create_map(*[F.lit(x) for p, o in offsets.items() for x in (p, o)])
    return held.withColumn(SEQ, F.element_at(table, part) + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_m")


def _source(engine, table: Table, s: t.Insert, params: dict) -> DataFrame:
    """The new rows in the table's columns, numbered; defaults filled in, generated columns not yet."""
    names = [c.name for c in table.columns if c.generated is None]
    targets = [table.column(n).name if not (n.lower() in ("rowid", "_rowid_", "oid") and not table.has(n)) else table.rowid_alias or ROWID for n in s.columns] or names
    for n in targets:
        if n != ROWID and table.column(n).generated is not None:
            raise SqlError(f'cannot INSERT into generated column "{n}"')
    lower = engine.lowering(params)
    if s.query is None:
        given, frame = {}, engine.spark.range(1).select()
    else:
        sql, columns = engine.lowered(s.query, params)
        if len(columns) != len(targets):
            raise SqlError(f"table {table.name} has {len(targets)} columns but {len(columns)} values were supplied" if not s.columns else f"{len(columns)} values for {len(targets)} columns")
        frame = engine.spark.sql(sql).toDF(*[f"c{i}" for i in range(len(columns))])
        given = {n: Expr(f"`c{i}`", k) for i, (n, (_, k, _)) in enumerate(zip(targets, columns, strict=True))}
    out = []
    for c in table.columns:
        kind = ty.kind_of_declared(c.kind)
        if c.name in given:
            e = given[c.name]
        elif c.default is not None:
            e = lower.value(c.default, Scope())
        else:
            e = Expr("NULL", "null")
        out.append(F.expr(stored(e, kind)).alias(c.name))
    out.append((F.expr(given[ROWID].sql).cast("long") if ROWID in given else F.lit(None).cast("long")).alias(ROWID))
    if s.query is None:
        frame = engine.spark.range(1)
    return numbered(engine, frame.select(*out))


def _follow_largest(new: DataFrame, top: int, rows: int = 100_000) -> DataFrame:
    """new with _given: one more than the largest of top and the ids before it in order of SEQ, _w where that isn't null.

    With c missing ids up to a row, that is c more than the largest of top and of w less the missing ones before w.
    Running figures are taken within stretches of SEQ, and carried over by one row for each stretch.
    """
    missing = F.col("_w").isNull().cast("long")
    upto = Window.partitionBy("_b").orderBy(SEQ).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    new = new.withColumn("_b", F.floor(F.col(SEQ) / rows)).withColumn("_c", F.sum(missing).over(upto))
    ends = new.groupBy("_b").agg(F.max("_c").alias("_m"), F.max(F.col("_w") - F.col("_c")).alias("_g"))
    ends = ends.withColumn("_before", F.coalesce(F.sum("_m").over(before), F.lit(0)))
    ends = ends.select("_b", "_before", F.greatest(F.lit(top), F.max(F.col("_g") - F.col("_before")).over(before)).alias("_from"))
    own = F.max(F.col("_w") - F.col("_c")).over(upto)
    new = new.withColumn("_own", own).join(ends, "_b")
    given = F.greatest("_from", F.col("_own") - F.col("_before")) + F.col("_before") + F.col("_c")
    return new.withColumn("_given", given).drop("_b", "_c", "_own", "_before", "_from")


def _with_rowids(engine, table: Table, new: DataFrame) -> DataFrame:
    alias = table.rowid_alias
    wanted = F.col(ty.ident(alias)) if alias else F.col(ROWID)
    counts = new.agg(F.count(F.lit(1)).alias("n"), F.count(wanted).alias("given"), F.max(wanted).alias("top")).first()
    if not any(c.auto for c in table.columns):
        # the next id follows the largest that is there; AUTOINCREMENT follows the largest that ever was
        table.top = engine.frame(table).agg(F.max(ROWID)).first()[0] or 0 if table.parts else 0
    if counts["given"] == 0:
        ids = F.col(SEQ) + table.top
        top = table.top + counts["n"]
    elif counts["given"] == counts["n"]:
        ids, top = wanted, max(table.top, counts["top"])
    else:
        # given ids among missing ones: each missing one follows the largest so far
        new = engine.cut(_follow_largest(new.withColumn("_w", wanted), table.top))
        ids = F.coalesce(F.col("_w"), F.col("_given"))
        top = new.agg(F.max(ids)).first()[0]
    new = new.withColumn(ROWID, ids)
    if alias:
        new = new.withColumn(alias, F.col(ROWID))
    table.top = max(table.top, top or 0)
    return new.drop("_given", "_w")


def _kept_greedily(engine, table: Table, new: DataFrame, keys: list) -> DataFrame:
    """The rows that conflict with no earlier kept one: in each round those that are first by all keys."""
    base = engine.frame(table)
    for key, where in keys:
        new = new.join(_meets(engine, table, new, base, key, where, "left_semi").select(SEQ), SEQ, "left_anti")
    left, kept = engine.cut(new), None
    while not left.isEmpty():
        beaten = None
        for key, where in keys:
            keyed = _keyed(engine, table, left, key, where, "_k")
            rank = Window.partitionBy(*[f"_k{i}" for i in range(len(key))]).orderBy(SEQ)
            later = keyed.withColumn("_n", F.row_number().over(rank)).where("_n > 1").select(SEQ)
            beaten = later if beaten is None else beaten.unionAll(later)
        first = engine.cut(left.join(beaten.distinct(), SEQ, "left_anti") if beaten is not None else left)
        kept = first if kept is None else kept.unionAll(first)
        left = left.join(first.select(SEQ), SEQ, "left_anti")
        for key, where in keys:
            left = left.join(_meets(engine, table, left, first, key, where, "left_semi").select(SEQ), SEQ, "left_anti")
        left = engine.cut(left)
    return new.limit(0) if kept is None else kept


def insert(engine, s: t.Insert, params: dict) -> DataFrame | None:
    if s.table.lower() in engine.state.views:
        return _instead(engine, s, params)
    table = engine.state.table(s.table)
    new = _source(engine, table, s, params)
    new = with_generated(engine, table, _with_rowids(engine, table, new))
    keys = all_keys(engine, table)
    names = [c.name for c in table.columns]
    fire(engine, _triggers(engine, s.table, "BEFORE", "INSERT"), names, _sides(table, None, new), params)
    if s.conflict == "IGNORE":
        for bad, _ in _failing(engine, table):
            new = new.where(~F.coalesce(bad, F.lit(False)))
        new = engine.cut(_kept_greedily(engine, table, new, keys))
    elif s.conflict == "REPLACE":
        new = _replaced(engine, table, new, keys)
    elif s.upserts:
        return _upsert(engine, table, s, new, params)
    check_rows(engine, table, new)
    base = engine.frame(table)
    for key, where in keys:
        if s.conflict == "ABORT" and not (key == (table.rowid_alias,) and _all_new(s, table)):
            if not _meets(engine, table, new, base, key, where, "left_semi").isEmpty():
                raise ConstraintError(f"UNIQUE constraint failed: {', '.join(f'{table.name}.{k}' for k in key)}")
            check_unique(engine, table, new, [(key, where)])
    append(engine, table, new)
    check_children(engine, table, new)
    row = new.agg(F.count(F.lit(1)).alias("n"), F.max_by(ROWID, SEQ).alias("last")).first()
    engine.changes = row["n"]
    engine.last_rowid = row["last"] if row["last"] is not None else engine.last_rowid
    fire(engine, _triggers(engine, s.table, "AFTER", "INSERT"), names, _sides(table, None, new), params)
    return returned(engine, table, new, s.returning, params)


def _all_new(s: t.Insert, table: Table) -> bool:
    """Whether every row id comes from the engine, which never gives one twice."""
    return bool(s.columns) and table.rowid_alias is not None and table.rowid_alias.lower() not in {c.lower() for c in s.columns} and not {"rowid", "_rowid_", "oid"} & {c.lower() for c in s.columns}


def _replaced(engine, table: Table, new: DataFrame, keys: list) -> DataFrame:
    """REPLACE: a NULL in a NOT NULL column takes the default; each row drives out those it conflicts with."""
    for c in table.columns:
        if c.not_null and c.default is not None:
            e = engine.lowering().value(c.default, Scope())
            new = new.withColumn(c.name, F.coalesce(F.col(ty.ident(c.name)), F.expr(stored(e, ty.kind_of_declared(c.kind)))))
    for key, where in keys:
        keyed = _keyed(engine, table, new, key, where, "_k")
        rank = Window.partitionBy(*[f"_k{i}" for i in range(len(key))]).orderBy(F.col(SEQ).desc())
        earlier = keyed.withColumn("_n", F.row_number().over(rank)).where("_n > 1").select(SEQ)
        # what an earlier row drove out stays out, so conflicts with the base count for all new rows
        remove(engine, table, _meets(engine, table, engine.frame(table), new, key, where, "left_semi"))
        new = engine.cut(new.join(earlier, SEQ, "left_anti"))
    return new


def _excluded_only(node) -> bool:
    """Whether an expression is plain arithmetic of values and of the new row's columns."""
    plain = []
    rebuilt(node, lambda n: plain.append(isinstance(n, (t.Literal, t.Param, t.Unary, t.Binary, t.Cast)) or isinstance(n, t.Col) and (n.table or "").lower() == "excluded") or n)
    return all(plain)


def _folds(engine, table: Table, s: t.Insert, keys: list, params: dict) -> dict | None:
    """{column: (whether it is added up, expression of the new row)} if DO UPDATE of any number of rows is one step; None if not.

    That holds for c = c + whole number and for values of the new row alone, where nothing looks at the states between.
    """
    u = s.upserts[0]
    watched = [x for x in engine.state.triggers.values() if x.table.lower() == s.table.lower()]
    if len(s.upserts) > 1 or len(keys) > 1 or keys[0][1] is not None or u.where is not None or watched or table.checks or any(c.generated is not None for c in table.columns):
        return None
    bound = {c.lower() for c in keys[0][0]} | {c.lower() for f in table.foreign for c in f.columns}
    scope = Scope([_excluded(table)])
    found = {}
    for n, e in u.sets or ():
        c = table.column(n)
        if c.name.lower() in bound or c.not_null:
            return None
        sides = [(e.left, e.right), (e.right, e.left)] if isinstance(e, t.Binary) and e.op == "+" else []
        own = [b for a, b in sides if isinstance(a, t.Col) and a.name.lower() == c.name.lower() and (a.table or table.name).lower() == table.name.lower() and _excluded_only(b)]
        if not own and not _excluded_only(e):
            return None
        value = engine.lowering(params).value(own[0] if own else e, scope)
        if own and (value.kind != "int" or ty.kind_of_declared(c.kind) != "int"):
            return None
        found[c.name] = (bool(own), value)
    return found


def _excluded(table: Table) -> Source:
    return Source("excluded", [Name(c.name, ty.kind_of_declared(c.kind), f"`_x_{i}`", c.collation, True) for i, c in enumerate(table.columns)])


def _fold(engine, table: Table, rest: DataFrame, key: tuple, folds: dict) -> DataFrame:
    """Update the table by rows whose keys it has, all rows of a key at once; the changed rows."""
    kinds = {c.name: ty.kind_of_declared(c.kind) for c in table.columns}
    on = [f"_a{i}" for i in range(len(key))]
    new = rest.select(SEQ, *on, *[F.col(ty.ident(c.name)).alias(f"_x_{i}") for i, c in enumerate(table.columns)])
    new = new.select(SEQ, *on, *[F.expr(stored(e, kinds[n])).alias(f"_s_{i}") for i, (n, (_, e)) in enumerate(folds.items())])
    one = F.count(F.lit(1))
    # a missing summand makes the sum missing for good
    steps = [F.when(F.count(f"_s_{i}") == one, F.sum(f"_s_{i}")) if added else F.max_by(f"_s_{i}", SEQ) for i, (added, _) in enumerate(folds.values())]
    totals = new.groupBy(*on).agg(one.alias("_n"), *[x.alias(f"_s_{i}") for i, x in enumerate(steps)])
    base = engine.frame(table)
    test = reduce(lambda x, y: x & y, [F.col(f"_a{i}") == F.col(f"_b{i}") for i in range(len(key))])
    hit = _keyed(engine, table, base, key, None, "_b").join(totals, test)
    value = {n: F.col(ty.ident(n)) + F.col(f"_s_{i}") if added else F.col(f"_s_{i}") for i, (n, (added, _)) in enumerate(folds.items())}
    changed = engine.cut(hit.select(F.col(ROWID), *[value.get(c.name, F.col(ty.ident(c.name))).alias(c.name) for c in table.columns]))
    replace_rows(engine, table, changed, base)
    return changed


def _upsert(engine, table: Table, s: t.Insert, new: DataFrame, params: dict) -> DataFrame | None:
    """Rows that share a key are folded in order: the first of each key, then all others in one step if _folds() allows.

    Else round r takes the r-th of each key.
    """
    keys = all_keys(engine, table)
    check_rows(engine, table, new)
    every = {k: w for k, w in keys}
    clauses = []
    for u in s.upserts:
        target = tuple(table.column(c).name for c in u.target)
        match = [k for k in every if not target or {c.lower() for c in k} == {c.lower() for c in target}]
        if not match:
            raise SqlError("ON CONFLICT clause does not match any PRIMARY KEY or UNIQUE constraint")
        clauses.append((u, match))
    folds = _folds(engine, table, s, keys, params)
    rest = None
    if folds is not None:
        key = clauses[0][1][0]
        on = [f"_a{i}" for i in range(len(key))]
        new = engine.cut(new)
        keyed = _keyed(engine, table, new, key, None, "_a")
        firsts = keyed.groupBy(*on).agg(F.min(SEQ).alias(SEQ)).select(SEQ)
        rest = engine.cut(keyed.join(firsts, SEQ, "left_anti"))
        new = new.join(rest.select(SEQ), SEQ, "left_anti")
    ranks = None
    for _, match in clauses if folds is None else ():
        for key in match:
            keyed = _keyed(engine, table, new, key, every[key], "_k")
            rank = Window.partitionBy(*[f"_k{i}" for i in range(len(key))]).orderBy(SEQ)
            own = keyed.select(SEQ, F.row_number().over(rank).alias("_n"))
            ranks = own if ranks is None else ranks.unionAll(own)
    if ranks is None:
        held = engine.cut(new.withColumn("_round", F.lit(1)))
    else:
        held = engine.cut(new.join(ranks.groupBy(SEQ).agg(F.max("_n").alias("_round")), SEQ, "left").fillna(1, ["_round"]))
    rounds = held.agg(F.max("_round")).first()[0] or 0
    touched, count = None, 0
    names = [c.name for c in table.columns]
    for r in range(1, rounds + 1):
        rows = held.where(F.col("_round") == r).drop("_round")
        for u, match in clauses:
            for key in match:
                base = engine.frame(table)
                a = _keyed(engine, table, rows, key, every[key], "_a")
                excluded = a.select(F.col(SEQ).alias("_x_seq"), *[F.col(ty.ident(c)).alias(f"_x_{i}") for i, c in enumerate(names)], *[f"_a{i}" for i in range(len(key))])
                b = _keyed(engine, table, base, key, every[key], "_b")
                test = reduce(lambda x, y: x & y, [F.col(f"_a{i}") == F.col(f"_b{i}") for i in range(len(key))])
                hit = engine.cut(b.join(excluded, test))
                if hit.isEmpty():
                    continue
                rows = engine.cut(rows.join(hit.select(F.col("_x_seq").alias(SEQ)), SEQ, "left_anti"))
                if u.sets is None:
                    continue
                scope = engine.scope(table)
                scope.sources.append(_excluded(table))
                if u.where is not None:
                    hit = hit.where(engine.lowering(params).truth(u.where, scope))
                sets = {table.column(n).name: engine.lowering(params).value(e, scope) for n, e in u.sets}
                changed = hit.select(
                    F.col(ROWID), *[(F.expr(stored(sets[c.name], ty.kind_of_declared(c.kind))) if c.name in sets else F.col(ty.ident(c.name))).alias(c.name) for c in table.columns]
                )
                changed = engine.cut(with_generated(engine, table, changed))
                old = engine.cut(_plain(table, hit))
                replace_rows(engine, table, changed, base)
                fire(engine, _triggers(engine, s.table, "AFTER", "UPDATE", {n.lower() for n in sets}), names, _sides(table, old, changed), params)
                count += changed.count()
                ids = changed.select(ROWID)
                touched = ids if touched is None else touched.unionAll(ids)
        if not rows.isEmpty():
            base = engine.frame(table)
            for key, where in keys:
                if not _meets(engine, table, rows, base, key, where, "left_semi").isEmpty():
                    raise ConstraintError(f"UNIQUE constraint failed: {', '.join(f'{table.name}.{k}' for k in key)}")
                check_unique(engine, table, rows, [(key, where)])
            append(engine, table, rows)
            check_children(engine, table, rows)
            row = rows.agg(F.count(F.lit(1)).alias("n"), F.max_by(ROWID, SEQ).alias("last")).first()
            count += row["n"]
            engine.last_rowid = row["last"]
            fire(engine, _triggers(engine, s.table, "AFTER", "INSERT"), names, _sides(table, None, rows), params)
            touched = rows.select(ROWID) if touched is None else touched.unionAll(rows.select(ROWID))
    if folds and (more := rest.count()):
        ids = _fold(engine, table, rest, clauses[0][1][0], folds).select(ROWID)
        count += more
        touched = ids if touched is None else touched.unionAll(ids)
    engine.changes = count
    if not s.returning:
        return None
    now = engine.frame(table)
    return returned(engine, table, now.join(touched.distinct(), ROWID, "left_semi") if touched is not None else now.limit(0), s.returning, params)


# -- UPDATE and DELETE ----------------------------------------------------------------------------


def _where(engine, table: Table, where, params: dict) -> DataFrame:
    """The table's rows that meet a condition, which may hold subqueries."""
    if where is None:
        return engine.frame(table)
    items = (t.Item(t.Col("rowid", table.name), "_hit"),)
    sql, _ = engine.lowering(params).query(t.Query(t.Select(items, t.TableRef(table.name), where=where)))
    hit = engine.spark.sql(sql).toDF("_hit")
    return engine.frame(table).join(hit, F.col(ROWID) == F.col("_hit"), "left_semi")


def update(engine, s: t.Update, params: dict) -> DataFrame | None:
    if s.table.lower() in engine.state.views:
        return _instead(engine, s, params)
    table = engine.state.table(s.table)
    sets = {}
    for n, e in s.sets:
        column = table.column(n)
        if column.generated is not None:
            raise SqlError(f'cannot UPDATE generated column "{n}"')
        sets[column.name] = e
    items = [t.Item(t.Col("rowid", table.name), "_hit")] + [t.Item(e, f"_v{i}") for i, e in enumerate(sets.values())]
    sql, columns = engine.lowering(params).query(t.Query(t.Select(tuple(items), t.TableRef(table.name), where=s.where)))
    values = engine.spark.sql(sql).toDF(*[n for n, *_ in columns])
    old = engine.frame(table)
    place = {n: i for i, n in enumerate(sets)}
    joined = old.join(values, F.col(ROWID) == F.col("_hit"))
    changed = joined.select(
        F.col(ROWID),
        *[
            (F.expr(stored(Expr(f"`_v{place[c.name]}`", columns[place[c.name] + 1][1]), ty.kind_of_declared(c.kind))) if c.name in place else F.col(ty.ident(c.name))).alias(c.name)
            for c in table.columns
        ],
    )
    changed = engine.cut(with_generated(engine, table, changed))
    before = _plain(table, old.join(changed.select(ROWID), ROWID, "left_semi"))
    names = [c.name for c in table.columns]
    touched = {n.lower() for n in sets}
    fire(engine, _triggers(engine, s.table, "BEFORE", "UPDATE", touched), names, _sides(table, before, changed), params)
    if s.conflict == "IGNORE":
        for bad, _ in _failing(engine, table):
            changed = changed.where(~F.coalesce(bad, F.lit(False)))
    engine.changes = 0
    if not changed.isEmpty():
        changed = replace_rows(engine, table, changed, old, s.conflict)
        engine.changes = changed.count()
        fire(engine, _triggers(engine, s.table, "AFTER", "UPDATE", touched), names, _sides(table, before, changed), params)
    return returned(engine, table, changed, s.returning, params)


def delete(engine, s: t.Delete, params: dict) -> DataFrame | None:
    if s.table.lower() in engine.state.views:
        return _instead(engine, s, params)
    table = engine.state.table(s.table)
    gone = engine.cut(_plain(table, _where(engine, table, s.where, params)))
    names = [c.name for c in table.columns]
    fire(engine, _triggers(engine, s.table, "BEFORE", "DELETE"), names, _sides(table, gone, None), params)
    count = gone.count()
    if s.where is None and not engine.foreign_keys:
        table.parts = ()
    else:
        remove(engine, table, gone, True)
    engine.changes = count
    fire(engine, _triggers(engine, s.table, "AFTER", "DELETE"), names, _sides(table, gone, None), params)
    return returned(engine, table, gone, s.returning, params)


def _instead(engine, s, params: dict) -> None:
    """INSTEAD OF triggers of a view."""
    view = engine.state.views[s.table.lower()]
    event = type(s).__name__.upper()
    touched = {n.lower() for n, _ in s.sets} if event == "UPDATE" else None
    triggers = _triggers(engine, s.table, "INSTEAD OF", event, touched)
    if not triggers:
        raise SqlError(f"cannot modify {s.table} because it is a view")
    relation = engine.view(view)
    names = [n for n, *_ in relation.columns]
    if event == "INSERT":
        sql, columns = engine.lowered(s.query, params)
        targets = [c.lower() for c in s.columns] or [n.lower() for n in names]
        frame = engine.spark.sql(sql).toDF(*[f"c{i}" for i in range(len(columns))])
        pairs = frame.select(*[(F.col(f"c{targets.index(n.lower())}") if n.lower() in targets else F.lit(None)).alias(f"new_{i}") for i, n in enumerate(names)])
    else:
        items = [t.Item(t.Col(n, s.table), f"old_{i}") for i, n in enumerate(names)]
        if event == "UPDATE":
            sets = {n.lower(): e for n, e in s.sets}
            items += [t.Item(sets.get(n.lower(), t.Col(n, s.table)), f"new_{i}") for i, n in enumerate(names)]
        sql, _ = engine.lowered(t.Query(t.Select(tuple(items), t.TableRef(s.table), where=s.where)), params)
        pairs = engine.spark.sql(sql)
    pairs = engine.cut(pairs)
    fire(engine, triggers, names, pairs, params)
    engine.changes = pairs.count()
    return None
