"""Numbers of tasks that follow the rows.

Adaptive execution joins shuffle partitions by their compressed bytes, so a task may get rows that fill
many times as much memory once they are sorted or hashed.  A number of partitions given with
``repartition`` is kept, and the operators after it work on so many rows a task at any size of the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ROWS = 1 << 17  # rows a task, before lists unfold


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks for ``rows`` rows: one per ``ROWS``, and no core idle."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS))


def dealt(df: DataFrame, keys: list[str], tasks: int | None) -> DataFrame:
    """Rows hashed by ``keys`` over ``tasks`` partitions; without a number they stay where they are."""
    return df if tasks is None else df.repartition(tasks, *keys)
