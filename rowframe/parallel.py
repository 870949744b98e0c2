"""Python work on the executors: one call, or a list of items in chunks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import SparkSession


def process_in_worker(spark: SparkSession, fn: Callable[[Any], Any], data: Any) -> Any:
    """fn(data) on an executor."""
    return spark.sparkContext.parallelize([data], 1).map(fn).collect()[0]


def process_in_parallel(spark: SparkSession, items: Sequence[Any], fn: Callable[[Any], Any], max_workers: int | None = None, chunk_size: int | None = None) -> list[Any]:
    """fn of each item, in the items' order; up to ten items run in place."""
    items = list(items)
    if len(items) <= 10:
        return [fn(x) for x in items]
    slices = -(-len(items) // chunk_size) if chunk_size else max_workers or spark.sparkContext.defaultParallelism
    return spark.sparkContext.parallelize(items, slices).mapPartitions(lambda part: [fn(x) for x in part]).collect()
