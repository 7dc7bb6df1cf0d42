"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables, by any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one is set only where the cluster names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = have.get() if have.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "/tmp/checkpoints/quillsql"
    return found.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a table in the shared folder and read it back: survives lost executors, unlike localCheckpoint."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the table that cut_lineage() wrote for df, once nothing reads it any more."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
        if path.getName().startswith("cut-"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python is sent so many rows at a time: for actions on tables of large rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def free_prefix(df: DataFrame) -> str:
    """A prefix that none of df's column names has."""
    prefix = "_own"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def text_or_empty(name: str) -> Column:
    """The column as a string, null as the empty string."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
