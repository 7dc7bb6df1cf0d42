"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsql.llm.common import cut_lineage, drop_cut


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, root) for every end of the edges (a, b): root is the least of its component, itself included.

    Each round is two aggregates by end and two equi-joins back, of constant-size rows, so a hub is no
    group in one task; tables of the shared folder cut the lineage. Null ends are left out.
    """
    now = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = cut_lineage(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = cut_lineage(small.unionAll(least.select("a", F.col("m").alias("b"))).distinct())
        new = _state(after)
        drop_cut(now)
        now, same = after, new == state
        state = new
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select("a", F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("a"), F.col("b").alias("root")).distinct())
