"""Parallelism for expensive row work on small inputs, and bounded tasks on large ones."""

from __future__ import annotations

from pyspark.sql import DataFrame

SPLIT_BYTES = 128 * 1024 * 1024
TASK_ROWS = 250_000  # rows whose groups or sort one task holds at a time


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when the input is too small to have a split for each; larger inputs stay as they are.

    Decided from the planner's size estimate, without running anything.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPLIT_BYTES else df


def portions(df: DataFrame, *keys: str, rows: int = TASK_ROWS) -> DataFrame:
    """Rows by hash of the keys in as many tasks as their number asks for, so that what a task holds does not grow with the input.

    Aggregates and windows over these keys (and more) need no shuffle of their own then. Where all cores together hold no more
    than ``rows`` each, nothing is changed. Meant for tables that are cheap to count and keys that hardly repeat: a
    key's rows go to one task, which reads them as a stream.
    """
    parts = -(-df.count() // rows)
    return df.repartition(parts, *keys) if parts > df.sparkSession.sparkContext.defaultParallelism else df
