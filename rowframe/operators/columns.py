"""Operators that change columns: projections, updates, casts, cleaning, reshaping to long form."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowframe.functions import coerce as C
from rowframe.functions.text import normalize
from rowframe.operators.base import HIDDEN, BaseFrame, Columns, Key, PyFn, as_column, quote_name

CASTS = ("string", "number", "boolean", "date")


def q(name: str) -> Column:
    return F.col(quote_name(name))


class ColumnOperators(BaseFrame):
    def _replace(self, changes: Mapping[str, Column]):
        """Columns replaced in place; new ones at the end."""
        kept = [changes[c].alias(c) if c in changes else q(c) for c in self.columns]
        return self._select([*kept, *[v.alias(k) for k, v in changes.items() if k not in self.columns]])

    def add_column(self, name: str, value: Any):
        """A literal, a Column or a callback's value in every row; an existing column is overwritten where it stands."""
        if name in self.columns:
            warnings.warn(f"column {name} is overwritten", stacklevel=2)
        return self._replace({name: self._value(value)})

    def remove_column(self, names: str | Sequence[str]):
        """Without the named columns; names that are not there are ignored."""
        gone = {names} if isinstance(names, str) else set(names)
        return self._select([q(c) for c in self.columns if c not in gone])

    def rename_column(self, old: str, new: str):
        """The renamed column stands last, or in the place of ``new`` where that exists; a missing ``old`` adds NULLs."""
        if old == new:
            warnings.warn(f"column {old} is renamed to itself", stacklevel=2)
            return self._select([q(c) for c in self.columns])
        value = q(old) if old in self.columns else F.lit(None).cast("string")
        if old not in self.columns and new in self.columns:
            return self._select([q(c) for c in self.columns])
        if new in self.columns:
            return self._select([value.alias(new) if c == new else q(c) for c in self.columns if c != old])
        return self._select([*[q(c) for c in self.columns if c != old], value.alias(new)])

    def reorder_columns(self, names: Sequence[str]):
        """The named columns first (once each, unknown ones ignored), the rest as they were."""
        first = [n for n in dict.fromkeys(names) if n in self.columns]
        return self._select([q(c) for c in [*first, *[c for c in self.columns if c not in first]]])

    def cast_column_type(self, name: str, to: str):
        """To ``string`` (NULL: empty), ``number``, ``boolean`` or ``date``; what does not convert is NULL."""
        if to not in CASTS:
            raise ValueError(f"unknown type: {to}")
        if name not in self.columns:
            warnings.warn(f"no column {name}", stacklevel=2)
            return self._select([q(c) for c in self.columns])
        c, kind = q(name), self._kind(name)
        new = {"string": lambda: F.when(c.isNull(), "").otherwise(C.dyn_string(c, kind)), "number": lambda: C.cast_number(c, kind), "boolean": lambda: C.dyn_bool(c, kind), "date": lambda: C.dyn_date(c, kind)}[to]()
        return self._replace({name: new})

    def update(self, changes: Mapping[str, Any] | Callable[[Columns], Mapping[str, Any]]):
        """Changes merged into every row."""
        return self._replace(self._changes(changes))

    def update_where(self, condition: Any, changes: Mapping[str, Any] | Callable[[Columns], Mapping[str, Any]]):
        """Changes merged where the condition holds; a new column is NULL elsewhere."""
        test = self._condition(condition)
        return self._replace({k: F.when(test, v).otherwise(q(k) if k in self.columns else F.lit(None)) for k, v in self._changes(changes).items()})

    def _changes(self, changes: Any) -> dict[str, Column]:
        given = changes(Columns(self.columns)) if callable(changes) else changes
        return {k: self._value(v) for k, v in given.items()}

    def update_column(self, name: str, value: Any):
        """One column set to a value, or to callback(current, row)."""
        if callable(value) and not isinstance(value, Column | PyFn):
            current = q(name) if name in self.columns else F.lit(None)
            return self._replace({name: as_column(value(current, Columns(self.columns)))})
        return self._replace({name: self._value(value)})

    def transform(self, fn: Callable[[Columns], Mapping[str, Any]] | PyFn):
        """Rows of a new shape: a callback giving {column: value}, or a PyFn that returns a struct."""
        if isinstance(fn, PyFn):
            kind = T._parse_datatype_string(fn.returns)
            one = self._select([fn.column(self.columns).alias("__row")])
            return one._select([F.col("__row")[f.name].alias(f.name) for f in kind])
        shape = fn(Columns(self.columns))
        return self._select([self._value(v).alias(k) for k, v in shape.items()])

    def map(self, fn: Any, name: str = "value"):
        """A frame of one column holding the callback's value of each row."""
        return self._select([self._value(fn).alias(name)])

    def fill_missing_values(self, name: str, value: Any):
        """NULLs of a column replaced (an empty text is not missing); adds the column where absent."""
        new = self._value(value)
        return self._replace({name: F.coalesce(q(name), new) if name in self.columns else new})

    def normalize_text(self, name: str, how: str):
        """``lowercase``, ``uppercase`` or ``capitalize`` on a text column; other columns stay as they are."""
        if not isinstance(self._kind(name), T.StringType):
            return self._select([q(c) for c in self.columns])
        return self._replace({name: normalize(q(name), how)})

    def trim_whitespace(self, names: Sequence[str] | None = None):
        """Unicode white space off both ends of the text columns (all, or those named)."""
        return self._replace({c: C.dyn_trim(q(c)) for c in (self.columns if names is None else names) if isinstance(self._kind(c), T.StringType)})

    def unpivot(self, id_columns: str | Sequence[str], value_columns: str | Sequence[str], variable: str = "variable", value: str = "value"):
        """A row for each row and value column, in that order; NULLs stay, absent columns are skipped with a warning.

        Value columns of unlike types become texts.
        """
        ids = [id_columns] if isinstance(id_columns, str) else list(id_columns)
        wanted = [value_columns] if isinstance(value_columns, str) else list(value_columns)
        if not ids and not wanted:
            return self
        ids = [c for c in ids if c in self.columns]
        if not wanted:
            return self._select([q(c) for c in ids])
        there = [c for c in wanted if c in self.columns]
        for c in set(wanted) - set(there):
            warnings.warn(f"no column {c} to unpivot", stacklevel=2)
        kinds = {self._kind(c).simpleString() for c in there}
        cell = (lambda c: q(c)) if len(kinds) < 2 else (lambda c: q(c).cast("string"))
        rows = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("c"), cell(c).alias("v")) for k, c in enumerate(there)])
        long = self._df.select(*[q(c) for c in ids], F.explode(rows).alias("__cell"), *[F.col(k.name) for k in self._keys])
        new = self._with(long)._select([*[q(c) for c in ids], F.col("__cell.c").alias(variable), F.col("__cell.v").alias(value), F.col("__cell.k").alias("__place")])
        place = new._df.withColumnRenamed("__place", f"{HIDDEN}{len(new._keys)}")

        return new._with(place, [*new._keys, Key(f"{HIDDEN}{len(new._keys)}")])
