"""Files as read-only tables, and query results as files."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quillsql.errors import SqlError

FORMATS = ("parquet", "orc", "csv", "json", "text")


def register(engine, name: str, path: str, kind: str = "parquet", schema: str | None = None, **options) -> None:
    """Make a file or folder known to an engine as a table. Give csv and json a schema; without one they are read twice."""
    if kind not in FORMATS:
        raise SqlError(f"unknown file format: {kind}")
    reader = engine.spark.read.format(kind).options(**options)
    engine.register(name, (reader.schema(schema) if schema else reader).load(path))


def register_folder(engine, folder: str, names: tuple[str, ...]) -> None:
    """Register folder/NAME.parquet for each name."""
    for name in names:
        engine.register_parquet(name, f"{folder}/{name}.parquet")


def export(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "errorifexists", **options) -> None:
    """Write a result in parallel, a folder of files."""
    if kind not in FORMATS:
        raise SqlError(f"unknown file format: {kind}")
    df.write.format(kind).mode(mode).options(**options).partitionBy(*partition_by).save(path)
