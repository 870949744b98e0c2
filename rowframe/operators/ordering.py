"""Sorting, slices, samples and iteration."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowframe.durable import durable
from rowframe.functions import coerce as C
from rowframe.operators.base import HIDDEN, Key, PyFn
from rowframe.operators.columns import q
from rowframe.operators.grouping import GroupOperators

DIRECTIONS = ("asc", "desc")


class OrderOperators(GroupOperators):
    def sort_by(self, column: str, direction: str = "asc"):
        """A stable sort: numbers by value, all else by Unicode collation of its text.

        NULL sorts as the text ``null``; among numbers that is last ascending, first descending.
        """
        kind = self._kind(column)
        if isinstance(kind, T.NumericType | T.DateType | T.TimestampType):
            key = q(column)
        else:
            key = C.collation_key(q(column), kind) if column in self.columns else F.lit(0)
        return self._sorted(key, direction, nulls_first=direction == "desc")

    def sort_by_async(self, column: str | Callable | PyFn, direction: str = "asc", **_: Any):
        """As sort_by(), NULLs first ascending and last descending; or by a key callback. Sorting is always parallel."""
        if not isinstance(column, str):
            return self._sorted(self._value(column), direction, nulls_first=direction == "asc")
        kind = self._kind(column)
        key = F.collate(C.dyn_string(q(column), kind), "UNICODE") if isinstance(kind, T.StringType) else q(column)
        return self._sorted(F.when(q(column).isNotNull(), key), direction, nulls_first=direction == "asc")

    def _sorted(self, key, direction: str, nulls_first: bool):
        if direction not in DIRECTIONS:
            raise ValueError(f"unknown direction: {direction}")
        return self._select([q(c) for c in self.columns], [(key, direction == "desc", nulls_first)])

    def merge_sorted(self, others, column: str, direction: str = "asc"):
        """This frame and others, each sorted by the column, as one sorted frame: a range-partitioned sort."""
        out = self
        for other in others:
            out = out.append(other)
        return out.sort_by(column, direction)

    def head(self, n: int = 10):
        """The first n rows; a negative n leaves out that many at the end."""
        if n < 0:
            n = max(0, self.count() + n)
        return self._with((self._df.orderBy(*self.order) if self._keys else self._df).limit(n))

    take = head

    def tail(self, n: int = 10):
        """The last n rows, in order; none for n = 0."""
        if n < 0:
            n = max(0, self.count() + n)
        return self._with(self._df.orderBy(*[k.sort(turned=True) for k in self._keys]).limit(n) if n else self._df.limit(0))

    def sample(self, n: int = 1, seed: int | None = None):
        """n rows at random without replacement; none for n <= 0, all if there are no more."""
        return self._with(self._df.orderBy(F.rand() if seed is None else F.rand(seed)).limit(n) if n > 0 else self._df.limit(0))

    def with_row_index(self, name: str = "index"):
        """Each row's place (from 0) as a column, by range partitions and the counts before them: no single-task window.

        The sorted rows are kept in a checkpoint, as counts and places have to be of the same partitions: a second run
        of the sort may cut its ranges elsewhere.
        """
        sorted_df = self._df.orderBy(*self.order) if self._keys else self._df
        placed = durable(sorted_df.withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id()))
        sizes = {r["__p"]: r["count"] for r in placed.groupBy("__p").count().collect()}
        before, total = {}, 0
        for p in sorted(sizes):
            before[p], total = total, total + sizes[p]
        if not before:
            return self._with(self._df.withColumn(name, F.lit(0).cast("long")))
        start = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])
        index = (F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)) + F.element_at(start, F.col("__p"))).cast("long")
        indexed = placed.withColumn(name, index).drop("__p", "__m", *[k.name for k in self._keys])
        return self._with(indexed.withColumn(f"{HIDDEN}0", F.col(name)), [Key(f"{HIDDEN}0")])

    def __iter__(self) -> Iterator[dict[str, Any]]:
        """Rows in order, streamed partition by partition."""
        return (r.asDict(recursive=True) for r in self.ordered().toLocalIterator(prefetchPartitions=True))

    def for_each(self, fn: Callable[[dict[str, Any]], Any]) -> None:
        """A side effect for each row, in order, on the driver."""
        for row in self:
            fn(row)

    def for_each_async(self, fn: Callable[[dict[str, Any]], Any], concurrency: int | None = None) -> None:
        """A side effect for each row on the executors, partitions at a time."""
        own = self.df if concurrency is None else self.df.repartition(concurrency)
        own.foreachPartition(lambda rows: [fn(r.asDict(recursive=True)) for r in rows] and None)

    def map_async(self, fn: PyFn | Callable, name: str = "value"):
        """map(); order is kept by the keys, whatever the tasks' order."""
        return self.map(fn, name)
