"""Aggregates, groups, distinct values, pivots and folds."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce as fold
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowframe.durable import durable, remove, shared_folder
from rowframe.errors import RowFrameError
from rowframe.functions import coerce as C
from rowframe.operators.base import HIDDEN, Columns, Key, as_column, quote_name
from rowframe.operators.columns import q
from rowframe.operators.joins import JoinOperators

#: Rows that a fold of expressions gathers at a time.
FOLD_ROWS = 100_000

AGGREGATES: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}


def _by_order(a: Column, b: Column) -> Column:
    return F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)


class Groups:
    """Rows grouped by the text of a key, as a plan: nothing is gathered until asked."""

    def __init__(self, frame, key: Column, name: str):
        self._frame, self._key, self.name = frame, key, name

    def agg(self, **aggregates: Column) -> DataFrame:
        """One row a group with the aggregates; partial sums are built before the shuffle."""
        return self._frame._df.groupBy(self._key.alias(self.name)).agg(*[v.alias(k) for k, v in aggregates.items()])

    def counts(self) -> DataFrame:
        return self.agg(count=F.count("*"))

    def group(self, key: str):
        """The rows of one group, in order."""
        return self._frame._with(self._frame._df.filter(self._key == key))

    def keys(self) -> list[str]:
        """The groups' keys by first appearance."""
        first = self._frame._least()
        return [r[0] for r in self._frame._df.groupBy(self._key.alias("k")).agg(self._frame._earliest(first).alias("f")).orderBy(F.col("f").desc() if self._frame._flipped() else F.col("f")).select("k").collect()]

    def rows(self) -> DataFrame:
        """key, rows (array of struct, in order). A group is one value here; agg() and group() have no such bound."""
        cells = F.struct(*[q(c) for c in self._frame.columns])
        gathered = F.array_sort(F.collect_list(F.struct(self._frame._least().alias("o"), cells.alias("r"))), self._frame._in_order)
        return self._frame._df.groupBy(self._key.alias(self.name)).agg(F.transform(gathered, lambda x: x["r"]).alias("rows"))

    def to_dict(self) -> dict[str, list[dict[str, Any]]]:
        """{key: rows}, keys by first appearance. Meant for results that fit the driver."""
        out: dict[str, list] = {}
        keyed = self._frame._select([self._key.alias("__key"), *[q(c) for c in self._frame.columns]])
        for r in keyed.ordered().collect():
            row = r.asDict(recursive=True)
            out.setdefault(row.pop("__key"), []).append(row)
        return out


class GroupOperators(JoinOperators):
    def _least(self) -> Column:
        """A struct that sorts as the rows do (ascending, NULLs first), or the other way round if _flipped()."""
        turned, flipped = [], self._flipped()
        for k in self._keys:
            c = F.col(k.name)
            if k.descending != flipped:
                if not self._numeric(k):
                    raise RowFrameError("this operator cannot follow an order by several texts in unlike directions")
                c = -c
            turned.append((c.isNull() if k.nulls_first == flipped else c.isNotNull()).alias(f"n{len(turned)}"))
            turned.append(c.alias(f"o{len(turned)}"))
        return F.struct(*turned) if turned else F.struct(F.lit(0).alias("o0"))

    def _numeric(self, key: Key) -> bool:
        return self._df.schema[key.name].dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")

    def _flipped(self) -> bool:
        """Whether _least() sorts the other way round: a descending text cannot be negated, all else can."""
        return any(k.descending and not self._numeric(k) for k in self._keys)

    def _earliest(self, order: Column) -> Column:
        """The place of a group's first row, by _least()."""
        return F.max(order) if self._flipped() else F.min(order)

    def _in_order(self, a: Column, b: Column) -> Column:
        return _by_order(b, a) if self._flipped() else _by_order(a, b)

    def aggregate(self, column: str, operation: str = "sum") -> float | int:
        """sum, avg, min, max or count of a column's cells read as numbers; cells that are none are left out."""
        if operation not in AGGREGATES:
            raise ValueError(f"unknown aggregate: {operation}")
        number = self.number(column)
        got = self._df.agg(AGGREGATES[operation](number).alias("v"), F.count(number).alias("n")).first()
        if operation == "count":
            return got["n"]
        if not got["n"]:
            raise RowFrameError(f"no numeric values in column {column}")
        return got["v"]

    def number(self, column: str) -> Column:
        """A column's cells read as numbers."""
        return C.dyn_number(q(column), self._kind(column)) if column in self.columns else F.lit(None).cast("double")

    def group_by(self, column: str) -> Groups:
        """Rows by the text of a cell."""
        return Groups(self, self._text(column), column)

    def group_by_field(self, path: str) -> Groups:
        """Rows by the text at a nested path; a missing value is the group ``undefined``."""
        c = F.col(".".join(quote_name(p) for p in path.split(".")))
        kind = self._df.select(c).schema[0].dataType
        return Groups(self, F.when(c.isNull(), "undefined").otherwise(C.dyn_string(c, kind)), "key")

    def distinct(self, column: str):
        """The values of a column, each once, by first appearance."""
        return self._firsts(self._df.groupBy(q(column).alias(column)).agg(self._earliest(self._least()).alias(f"{HIDDEN}0")))

    def _firsts(self, df: DataFrame):
        return self._with(df, [Key(f"{HIDDEN}0", self._flipped(), not self._flipped())])

    def pivot(self, row: str, column: str, value: str, values: Sequence[str] | None = None):
        """A row for each row text (by first appearance), a column for each column text; the last row's value wins.

        ``values`` names the columns; without it they are found by a job of their own.
        """
        keyed = self._df.select(self._text(row).alias("__r"), self._text(column).alias("__c"), q(value).alias("__v"), self._least().alias("__o"))
        wide = keyed.groupBy("__r").pivot("__c", list(values) if values is not None else None).agg((F.min_by if self._flipped() else F.max_by)(F.struct("__v"), "__o").alias("v"))
        first = keyed.groupBy("__r").agg(self._earliest(F.col("__o")).alias(f"{HIDDEN}0"))
        cells = [F.col(quote_name(c))["__v"].alias(c) for c in wide.columns if c != "__r"]
        joined = wide.join(first, "__r").select(F.col("__r").alias(row), *cells, f"{HIDDEN}0")
        return self._firsts(joined)

    def reduce(self, fn: Callable[[Any, dict[str, Any]], Any], initial: Any) -> Any:
        """An ordered left fold in Python over streamed rows (the slow path; see agg() for known aggregates)."""
        return fold(fn, (r.asDict(recursive=True) for r in self.ordered().toLocalIterator(prefetchPartitions=True)), initial)

    def reduce_column(self, merge: Callable[[Column, Columns], Column], initial: Any) -> Any:
        """An ordered fold of Column expressions, inside the JVM.

        A fold is a sequence by nature, so a task gathers FOLD_ROWS rows at most: a larger table is written in chunks of
        its order, and each chunk is folded from the result of the one before it.
        """
        if self._df.limit(FOLD_ROWS + 1).count() <= FOLD_ROWS:
            return self._folded(self._df, self._least(), self._in_order, merge, as_column(initial)).first()["v"]
        folder = f"{shared_folder(self.spark).rstrip('/')}/fold-{uuid.uuid4().hex}"
        placed = self.with_row_index(f"{HIDDEN}at")._df
        try:
            placed.withColumn(f"{HIDDEN}chunk", F.expr(f"{quote_name(HIDDEN + 'at')} div {FOLD_ROWS}")).write.partitionBy(f"{HIDDEN}chunk").parquet(folder)
            chunks = self.spark.read.parquet(folder)
            state = self.spark.range(1).select(as_column(initial).alias("v"))
            for k in range(-(-placed.count() // FOLD_ROWS)):
                chunk = chunks.where(F.col(f"{HIDDEN}chunk") == k)
                state = durable(self._folded(chunk, F.col(f"{HIDDEN}at"), _by_order, merge, state.scalar()))
            return state.first()["v"]
        finally:
            remove(self.spark, folder)

    def _folded(self, df: DataFrame, place: Column, compare: Callable[[Column, Column], Column], merge: Callable, start: Column) -> DataFrame:
        """One row, v: the fold of the rows of ``df`` by their places."""
        rows = F.array_sort(F.collect_list(F.struct(place.alias("o"), F.struct(*[q(c) for c in self.columns]).alias("r"))), compare)
        return df.agg(rows.alias("rows")).select("rows", start.alias("start")).select(F.aggregate("rows", F.col("start"), lambda acc, x: merge(acc, x["r"])).alias("v"))

    def reduce_parallel(self, fn: Callable[[Any, dict[str, Any]], Any], merge: Callable[[Any, Any], Any], zero: Any) -> Any:
        """Partitions folded by ``fn`` from ``zero``, their results by ``merge`` in a tree; order holds within partitions."""

        def part(rows):
            yield fold(fn, (r.asDict(recursive=True) for r in rows), zero)

        return self.ordered().rdd.mapPartitions(part).treeReduce(merge)

    def agg(self, **aggregates: Column) -> dict[str, Any]:
        """Named aggregate expressions over the whole table, in one pass."""
        return self._df.agg(*[v.alias(k) for k, v in aggregates.items()]).first().asDict()

