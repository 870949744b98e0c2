"""Joins on one key, and the one-to-one merge."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rowframe.errors import RowFrameError
from rowframe.operators.base import HIDDEN, Columns, Key, as_column
from rowframe.operators.columns import q
from rowframe.operators.rows import RowOperators
from rowframe.ship import ship

JOINS = {"inner": "inner", "left": "left", "right": "right", "outer": "full"}


def _same_kind(a: T.DataType | None, b: T.DataType | None) -> bool:
    """Whether values of two types can be equal: numbers with numbers, otherwise the same type."""
    return (isinstance(a, T.NumericType) and isinstance(b, T.NumericType)) or type(a) is type(b)


def _never(left, right) -> Column:
    """A condition that no two rows meet, by keys that spread both sides evenly: no side is sent whole."""

    def key(frame, side: str) -> Column:
        return F.concat(F.lit(side), F.xxhash64(*[F.col(f"{side}.`{c}`") for c in frame.columns]).cast("string"))

    return key(left, "l") == key(right, "r")


class _Side:
    """One side of a join inside a projection: its columns, NULL where the side has no row."""

    def __init__(self, frame, hit: str):
        self.columns = Columns(frame.columns, f"{hit}.")
        self.hit = F.col(f"{hit}.__hit").isNotNull()


class JoinOperators(RowOperators):
    def join(self, other, left: str, right: str, how: str = "inner", select: Callable[[Columns, Columns], Mapping[str, Any]] | None = None):
        """An equi-join, many to many; NULL keys meet, keys of unlike types never do.

        Left rows come in their order, each with its matches in the right order, then unmatched right rows. By default
        columns of both sides, the right one winning a shared name wherever a right row exists. ``select`` gives the
        columns from both sides' columns (all NULL on a side without a row).
        """
        if how not in JOINS:
            raise ValueError(f"unknown join: {how}")
        l_hidden = [F.col(k.name).alias(f"__l{i}") for i, k in enumerate(self._keys)]
        r_hidden = [F.col(k.name).alias(f"__r{i}") for i, k in enumerate(other._keys)]
        a = self._df.select(*[q(c) for c in self.columns], F.lit(True).alias("__hit"), *l_hidden).alias("l")
        b = other._df.select(*[q(c) for c in other.columns], F.lit(True).alias("__hit"), *r_hidden).alias("r")
        meets = F.col(f"l.`{left}`").eqNullSafe(F.col(f"r.`{right}`")) if _same_kind(self._kind(left), other._kind(right)) else _never(self, other)
        joined = a.join(b, meets, JOINS[how])
        mine, theirs = _Side(self, "l"), _Side(other, "r")
        if select:
            visible = [as_column(v).alias(k) for k, v in select(mine.columns, theirs.columns).items()]
        else:
            visible = [F.when(theirs.hit, theirs.columns[c]).otherwise(mine.columns[c]).alias(c) if c in other.columns else mine.columns[c].alias(c) for c in self.columns]
            visible += [theirs.columns[c].alias(c) for c in other.columns if c not in self.columns]
        late = F.when(mine.hit, 0).otherwise(1)
        names = [late, *[F.col(f"l.__l{i}") for i in range(len(self._keys))], *[F.col(f"r.__r{i}") for i in range(len(other._keys))]]
        keys = [Key(f"{HIDDEN}0"), *[Key(f"{HIDDEN}{1 + k}", key.descending, key.nulls_first) for k, key in enumerate((*self._keys, *other._keys))]]
        return self._with(joined.select(*visible, *[c.alias(k.name) for c, k in zip(names, keys, strict=True)]), keys)

    def merge_with(self, other, on: str | Sequence[str] | Callable[[dict, dict], bool], merge: Callable | None = None, limit: int = 10_000, within: str | Sequence[str] = ()):
        """A full one-to-one merge: each row takes the first unused equal row of ``other``; what is left over stays.

        ``on``: columns whose equality decides; then equal rows are numbered on both sides and meet in one full join.
        An arbitrary test on row dicts is inherently a sequential pass: both sides come to the driver, which refuses
        more than ``limit`` rows. With ``within``, only rows equal in those columns are tested with each other: each such
        group is a pass of its own on the executors, of any number of groups. ``merge`` combines two matched rows (Columns, or dicts with a test); by default the
        right side's values win.
        """
        if callable(on):
            names = [within] if isinstance(within, str) else list(within)
            return self._merge_within(other, on, merge, names) if names else self._merge_by_test(other, on, merge, limit)
        names = [on] if isinstance(on, str) else list(on)
        a, b = self._numbered(names, "__l"), other._numbered(names, "__r")
        test = F.lit(True)
        for n in [*names, "__nth"]:
            test = test & F.col(f"l.`{n}`").eqNullSafe(F.col(f"r.`{n}`"))
        joined = a.alias("l").join(b.alias("r"), test, "full")
        mine, theirs = _Side(self, "l"), _Side(other, "r")
        every = [*self.columns, *[c for c in other.columns if c not in self.columns]]
        if merge:
            both = {k: as_column(v) for k, v in merge(mine.columns, theirs.columns).items()}
            every += [k for k in both if k not in every]
        else:
            both = {c: (theirs.columns[c] if c in other.columns else mine.columns[c]) for c in every}

        def cell(c: str) -> Column:
            of_both = both.get(c, F.lit(None))
            return F.when(mine.hit & theirs.hit, of_both).when(mine.hit, mine.columns[c]).otherwise(theirs.columns[c]).alias(c)

        order = [F.when(mine.hit, 0).otherwise(1), *[F.col(f"l.__l{i}") for i in range(len(self._keys))], *[F.col(f"r.__r{i}") for i in range(len(other._keys))]]
        keys = [Key(f"{HIDDEN}0"), *[Key(f"{HIDDEN}{1 + k}", key.descending, key.nulls_first) for k, key in enumerate((*self._keys, *other._keys))]]
        return self._with(joined.select(*[cell(c) for c in every], *[c.alias(k.name) for c, k in zip(order, keys, strict=True)]), keys)

    def _numbered(self, names: Sequence[str], prefix: str):
        """Visible columns, __hit, the row's number among rows of equal ``names``, and its order keys."""
        nth = F.row_number().over(Window.partitionBy(*[q(n) for n in names]).orderBy(*self.order or [F.lit(0)]))
        hidden = [F.col(k.name).alias(f"{prefix}{i}") for i, k in enumerate(self._keys)]
        return self._df.select(*[q(c) for c in self.columns], F.lit(True).alias("__hit"), nth.alias("__nth"), *hidden)

    def _merge_within(self, other, test: Callable[[dict, dict], bool], merge: Callable | None, names: list[str]):
        """_merge_by_test() in every group of rows that are equal in ``names``; left rows first, then what is left over."""
        ship(self.spark)
        fields = {f.name: f for f in [*other.schema, *self.schema]}
        visible = T.StructType([fields[n] for n in dict.fromkeys([*self.columns, *other.columns])])
        order = [T.StructField(f"{HIDDEN}{k}", T.LongType()) for k in range(2)]
        combine = merge or (lambda a, b: {**a, **b})
        arrow = to_arrow_schema(T.StructType([*visible.fields, *order]))
        left, right = self.with_row_index("__at"), other.with_row_index("__at")

        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            mine, theirs = (sorted(t.to_pylist(), key=lambda r: r["__at"]) for t in (a, b))
            out = []
            for row in mine:
                at = next((k for k, r in enumerate(theirs) if test(row, r)), None)
                made = dict(row) if at is None else dict(combine(row, theirs.pop(at)))
                out.append({**made, f"{HIDDEN}0": 0, f"{HIDDEN}1": row["__at"]})
            out += [{**r, f"{HIDDEN}0": 1, f"{HIDDEN}1": r["__at"]} for r in theirs]
            return pa.Table.from_pylist([{f.name: r.get(f.name) for f in arrow} for r in out], schema=arrow)

        met = left.df.groupBy(*[q(n) for n in names]).cogroup(right.df.groupBy(*[q(n) for n in names]))
        return self._with(met.applyInArrow(run, T.StructType([*visible.fields, *order])), [Key(f"{HIDDEN}0"), Key(f"{HIDDEN}1")])

    def _merge_by_test(self, other, test: Callable[[dict, dict], bool], merge: Callable | None, limit: int):
        sides = []
        for frame in (self, other):
            rows = [r.asDict(recursive=True) for r in frame.ordered().limit(limit + 1).collect()]
            if len(rows) > limit:
                raise RowFrameError(f"a merge by an arbitrary test takes at most {limit} rows a side; name key columns instead")
            sides.append(rows)
        left, right = sides
        free, out = list(right), []
        for row in left:
            at = next((k for k, r in enumerate(free) if test(row, r)), None)
            out.append(row if at is None else (merge or (lambda a, b: {**a, **b}))(row, free.pop(at)))
        fields = {f.name: f for f in [*other.schema, *self.schema]}
        made = list(dict.fromkeys(n for r in [*out, *free] for n in r))
        schema = T.StructType([fields[n] for n in made]) if all(n in fields for n in made) else None
        return type(self).from_data(self.spark, [*out, *free], schema)
