"""The ordered table at the core of the library.

A frame is a DataFrame plus a list of hidden key columns that state the rows' order. Projections and filters carry the
keys along, sorts put new ones in front, appends and joins compose them; nothing is renumbered and no window runs over
the whole table. Operators whose result does not depend on order never touch the keys, and Catalyst prunes them.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowframe.errors import RowFrameError

HIDDEN = "__ord"


@dataclass(frozen=True)
class Key:
    """One hidden order key."""

    name: str
    descending: bool = False
    nulls_first: bool = True

    def sort(self, turned: bool = False) -> Column:
        c, down, first = F.col(self.name), self.descending != turned, self.nulls_first != turned
        if down:
            return c.desc_nulls_first() if first else c.desc_nulls_last()
        return c.asc_nulls_first() if first else c.asc_nulls_last()


class Columns:
    """Column access inside callbacks: ``row.price``, ``row["unit price"]``."""

    def __init__(self, names: Sequence[str], prefix: str = ""):
        self._names, self._prefix = tuple(names), prefix

    def __getitem__(self, name: str) -> Column:
        return F.col(f"{self._prefix}`{name}`") if name in self._names else F.lit(None)

    def __getattr__(self, name: str) -> Column:
        if name.startswith("__"):
            raise AttributeError(name)
        return self[name]

    def __contains__(self, name: str) -> bool:
        return name in self._names

    def __iter__(self):
        return iter(self._names)


@dataclass(frozen=True)
class PyFn:
    """A Python row callback, the slow path: it runs in Arrow batches outside the JVM.

    ``fn`` receives a dict of the row's cells; ``returns`` is the DDL of its result.
    """

    fn: Callable[[dict[str, Any]], Any]
    returns: str

    def column(self, names: Sequence[str]) -> Column:
        fn = self.fn
        call = F.udf(lambda row: fn(row.asDict(recursive=True)), self.returns, useArrow=True)
        return call(F.struct(*[F.col(f"`{n}`") for n in names]))


def python(returns: str) -> Callable[[Callable], PyFn]:
    """Marks a Python callback: ``@python("double")``."""
    return lambda fn: PyFn(fn, returns)


class BaseFrame:
    """An immutable, totally ordered table."""

    def __init__(self, df: DataFrame, keys: Sequence[Key] = (), preamble: str = "", validation: DataFrame | None = None):
        self._df, self._keys, self.preamble, self.validation_results = df, tuple(keys), preamble, validation

    # ---- construction

    @classmethod
    def from_df(cls, df: DataFrame, order_by: str | Sequence[str] = (), preamble: str = ""):
        """A DataFrame with the columns that order it; without any, its rows have no stated order."""
        by = [order_by] if isinstance(order_by, str) else list(order_by)
        names = [f"{HIDDEN}{k}" for k in range(len(by))]
        return cls(df.select("*", *[F.col(quote_name(b)).alias(n) for b, n in zip(by, names, strict=True)]), [Key(n) for n in names], preamble)

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str, order_by: str | Sequence[str] = ()):
        """A Parquet table; without ``order_by`` its order is that of files and rows."""
        df = spark.read.parquet(path)
        if order_by:
            return cls.from_df(df, order_by)
        keyed = df.select("*", F.col("_metadata.file_path").alias(f"{HIDDEN}0"), F.col("_metadata.row_index").alias(f"{HIDDEN}1"))
        return cls(keyed, [Key(f"{HIDDEN}0"), Key(f"{HIDDEN}1")])

    @classmethod
    def from_data(cls, spark: SparkSession, rows: Iterable[Mapping | Row], schema: T.StructType | str | None = None):
        """Row dicts, in their order; a missing key is NULL. ``schema`` may be left out where the values show it."""
        rows = [r.asDict(recursive=True) if isinstance(r, Row) else dict(r) for r in rows] if isinstance(rows, Iterable) and not isinstance(rows, str | bytes | Mapping) else []
        if schema is None:
            names = list(dict.fromkeys(n for r in rows for n in r))
            if not names:
                return cls(spark.createDataFrame([], T.StructType([T.StructField(f"{HIDDEN}0", T.LongType())])), [Key(f"{HIDDEN}0")])
            known = [n for n in names if any(r.get(n) is not None for r in rows)]
            found = {f.name: f.dataType for f in spark.createDataFrame([tuple(r.get(n) for n in known) for r in rows], known).schema} if known else {}
            kind = T.StructType([T.StructField(n, found.get(n, T.StringType()), True) for n in names])
        else:
            kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        numbered = T.StructType([*kind.fields, T.StructField(f"{HIDDEN}0", T.LongType(), False)])
        data = [(*(r.get(f.name) for f in kind), k) for k, r in enumerate(rows)]
        return cls(spark.createDataFrame(data, numbered), [Key(f"{HIDDEN}0")])

    # ---- views

    @property
    def spark(self) -> SparkSession:
        return self._df.sparkSession

    @property
    def columns(self) -> list[str]:
        return [c for c in self._df.columns if not c.startswith(HIDDEN)]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([f for f in self._df.schema if not f.name.startswith(HIDDEN)])

    @property
    def df(self) -> DataFrame:
        """The visible columns; rows in no stated order."""
        return self._df.select(*[F.col(quote_name(c)) for c in self.columns])

    @property
    def order(self) -> list[Column]:
        return [k.sort() for k in self._keys]

    def ordered(self) -> DataFrame:
        """The visible columns, sorted."""
        return (self._df.orderBy(*self.order) if self._keys else self._df).select(*[F.col(quote_name(c)) for c in self.columns])

    def to_array(self) -> list[dict[str, Any]]:
        """All rows as dicts, in order. Meant for results that fit the driver."""
        return [r.asDict(recursive=True) for r in self.ordered().collect()]

    def count(self) -> int:
        return self._df.count()

    def base_row(self, defaults: Mapping[str, Any] | None = None) -> dict[str, Any]:
        """A dict with every column (None, or its default)."""
        if not self.columns or self._df.limit(1).count() == 0:
            raise RowFrameError("a table without rows has no base row")
        return {**dict.fromkeys(self.columns), **(defaults or {})}

    def create_row(self, data: Mapping[str, Any] | None = None) -> dict[str, Any]:
        """base_row() with ``data`` filled in."""
        return self.base_row(data)

    def explain(self, mode: str = "formatted") -> None:
        self._df.explain(mode)

    # ---- building results

    def _with(self, df: DataFrame, keys: Sequence[Key] | None = None):
        return type(self)(df, self._keys if keys is None else keys, self.preamble)

    def _select(self, visible: Sequence[Column], more_keys: Sequence[tuple[Column, bool, bool]] = (), df: DataFrame | None = None):
        """The visible columns, with ``more_keys`` (column, descending, nulls first) in front of the order so far."""
        source = self._df if df is None else df
        new = [Key(f"{HIDDEN}{k}", d, n) for k, (_, d, n) in enumerate(more_keys)]
        old = [Key(f"{HIDDEN}{k + len(new)}", key.descending, key.nulls_first) for k, key in enumerate(self._keys)]
        hidden = [c.alias(k.name) for k, (c, _, _) in zip(new, more_keys, strict=True)] + [F.col(k.name).alias(n.name) for k, n in zip(self._keys, old, strict=True)]
        return self._with(source.select(*visible, *hidden), [*new, *old])

    def _kind(self, name: str) -> T.DataType | None:
        return self._df.schema[name].dataType if name in self.columns else None

    def _value(self, value: Any) -> Column:
        """A Column from a literal, a Column, a PyFn or a callback over Columns."""
        if isinstance(value, PyFn):
            return value.column(self.columns)
        if callable(value) and not isinstance(value, Column):
            value = value(Columns(self.columns))
        return as_column(value)

    def _condition(self, condition: Any) -> Column:
        """A boolean Column from a Column, SQL text, PyFn or callback, as it is, so that scans can take filters."""
        c = F.expr(condition) if isinstance(condition, str) else self._value(condition)
        return c.cast("boolean")


def quote_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def as_column(value: Any) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, Mapping):
        return F.struct(*[as_column(v).alias(k) for k, v in value.items()])
    if isinstance(value, list | tuple):
        return F.array(*[as_column(v) for v in value])
    return F.lit(value)


def takes(fn: Callable) -> int:
    """How many positional arguments a callback takes."""
    return len([p for p in inspect.signature(fn).parameters.values() if p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD)])
