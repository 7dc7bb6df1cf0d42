"""Results read row by row, without being held whole.

The dialect has no streams; what it has is lazy iteration over a result. Here that is a local iterator
that fetches one partition at a time while Spark prepares the next.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame


def rows(df: DataFrame, prefetch: bool = True) -> Iterator[tuple]:
    for row in df.toLocalIterator(prefetchPartitions=prefetch):
        yield tuple(row)


def batches(df: DataFrame, size: int = 10_000) -> Iterator[list[tuple]]:
    """Rows in lists of size."""
    held: list[tuple] = []
    for row in rows(df):
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
