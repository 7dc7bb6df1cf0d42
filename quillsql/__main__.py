"""A shell: python -m quillsql [PATH [SQL]]. Without SQL it reads statements from standard input."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from quillsql.engine import Engine
from quillsql.errors import SqlError

HELP = ".tables  list tables and views\n.schema [NAME]  show definitions\n.import NAME PATH  register a Parquet file\n.help\n.quit"


def run(engine: Engine, text: str) -> None:
    try:
        out = engine.sql(text)
        if out.columns != ["changes"]:
            out.show(1000, False)
    except SqlError as e:
        print(f"Error: {e}", file=sys.stderr)


def command(engine: Engine, line: str) -> bool:
    """Run a dot command; False ends the shell."""
    name, *args = line.split()
    if name in (".quit", ".exit"):
        return False
    if name == ".tables":
        print("  ".join(sorted([x.name for x in engine.state.tables.values()] + [v.name for v in engine.state.views.values()] + list(engine.external))))
    elif name == ".schema":
        for kind in (engine.state.tables, engine.state.indexes, engine.state.views, engine.state.triggers):
            for x in kind.values():
                if not args or x.name.lower() == args[0].lower():
                    print(f"{x.sql};")
    elif name == ".import" and len(args) == 2:
        engine.register_parquet(*args)
    else:
        print(HELP)
    return True


def main(args: list[str]) -> None:
    spark = SparkSession.builder.appName("quillsql").getOrCreate()
    engine = Engine(spark, args[0] if args and args[0] != ":memory:" else None)
    if len(args) > 1:
        run(engine, " ".join(args[1:]))
        return
    pending = ""
    for line in sys.stdin:
        if not pending and line.strip().startswith("."):
            if not command(engine, line.strip()):
                return
            continue
        pending += line
        if pending.strip().endswith(";"):
            run(engine, pending)
            pending = ""
    if pending.strip():
        run(engine, pending)


if __name__ == "__main__":
    main(sys.argv[1:])
