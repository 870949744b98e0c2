"""Operators that choose rows: predicates, lookups, similarity, deduplication, partition, set union."""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any, NamedTuple

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowframe.functions import coerce as C
from rowframe.functions.text import edit_distance
from rowframe.operators.base import HIDDEN, Key
from rowframe.operators.columns import ColumnOperators, q


class Split(NamedTuple):
    passed: Any
    failed: Any


class RowOperators(ColumnOperators):
    def find_rows_where(self, condition: Any):
        """The rows for which the condition holds."""
        return self._with(self._df.filter(self._condition(condition)))

    filter = find_rows_where

    def find_row_where(self, condition: Any) -> dict[str, Any] | None:
        """The first row for which the condition holds, or None."""
        return self.find_rows_where(condition)._first()

    def _first(self) -> dict[str, Any] | None:
        found = self.head(1).to_array()
        return found[0] if found else None

    def _text(self, column: str) -> Column:
        return C.dyn_string(q(column), self._kind(column)) if column in self.columns else F.lit("undefined")

    def find_row(self, value: Any, column: str = "id") -> dict[str, Any] | None:
        """The first row whose trimmed cell text equals the trimmed text of ``value``."""
        return self.find_row_where(C.dyn_trim(self._text(column)) == _literal_text(value).strip())

    def find_row_by_regex(self, pattern: str | re.Pattern, column: str = "id") -> dict[str, Any] | None:
        """The first row whose trimmed cell text the pattern finds a match in."""
        return self.find_row_where(C.dyn_trim(self._text(column)).rlike(_jvm_pattern(pattern)))

    def find_rows(self, value: Any, column: str = "id"):
        """The rows whose cell text contains the text of ``value``."""
        return self.find_rows_where(self._text(column).contains(_literal_text(value)))

    def find_similar_rows(self, text: str, column: str):
        """All rows as ``row`` with their edit distance ``dist`` to ``text``, nearest first."""
        row = F.struct(*[q(c) for c in self.columns]).alias("row")
        dist = edit_distance(self._text(column), text)
        return self._select([row, dist.alias("dist")], [(dist, False, False)])

    def find_most_similar_row(self, text: str, column: str) -> dict[str, Any] | None:
        """The nearest row with its distance (a top-1, not a full sort)."""
        return self.find_similar_rows(text, column)._first()

    def remove_where(self, condition: Any):
        """The rows for which the condition does not hold; one for which it is NULL stays."""
        return self._with(self._df.filter(~F.coalesce(self._condition(condition), F.lit(False))))

    def split(self, condition: Any) -> Split:
        """Rows for which the condition holds, and all others; each in order."""
        return Split(self.find_rows_where(condition), self.remove_where(condition))

    def deduplicate(self, columns: list[str] | None = None):
        """The first row of each combination of the columns' texts (all columns by default).

        One shuffle on the texts; the window keeps a group's least row on the map side before it.
        """
        names = self.columns if columns is None else [c for c in columns if c in self.columns]
        first = Window.partitionBy(*[self._text(c) for c in names]).orderBy(*self.order or [F.lit(0)])
        numbered = self._df.withColumn("__place", F.row_number().over(first)).filter("__place = 1").drop("__place")
        return self._with(numbered)

    def append(self, *rows: Mapping[str, Any]):
        """Row dicts, or another frame's rows, at the end; a column that one side lacks is NULL there."""
        if len(rows) == 1 and isinstance(rows[0], RowOperators):
            other = rows[0]
        else:
            fields = {f.name: f.dataType for f in self.schema}
            names = list(dict.fromkeys(n for r in rows for n in r))
            known = T.StructType([T.StructField(n, fields[n]) for n in names if n in fields])
            other = type(self).from_data(self.spark, rows, known) if len(known) == len(names) else type(self).from_data(self.spark, rows)
        return self._append_frame(other)

    def _append_frame(self, other):
        a, b = _sourced(self, 0), _sourced(other, 1, before=len(self._keys))
        own = [Key(f"{HIDDEN}{1 + k}", key.descending, key.nulls_first) for k, key in enumerate((*self._keys, *other._keys))]
        return self._with(a.unionByName(b, allowMissingColumns=True), [Key(f"{HIDDEN}0"), *own])


def _sourced(frame, source: int, before: int = 0):
    """Columns, the number of the source, and the source's own keys after ``before`` keys of the other one."""
    own = [F.col(k.name).alias(f"{HIDDEN}{1 + before + i}") for i, k in enumerate(frame._keys)]
    return frame._df.select(*[q(c) for c in frame.columns], F.lit(source).alias(f"{HIDDEN}0"), *own)


def _literal_text(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    return str(value)


def _jvm_pattern(pattern: str | re.Pattern) -> str:
    if isinstance(pattern, str):
        return pattern
    flags = "".join(f for f, bit in (("i", re.I), ("m", re.M), ("s", re.S)) if pattern.flags & bit)
    return f"(?{flags}){pattern.pattern}" if flags else pattern.pattern
