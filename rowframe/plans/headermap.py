"""Header maps: declarative mapping between flat columns and nested structs and arrays.

A map is compiled once on the driver against the schema, into the expressions of one projection.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowframe.errors import RowFrameError
from rowframe.functions import coerce as C
from rowframe.functions.text import to_json_text
from rowframe.operators.base import Columns, as_column, quote_name

MergeFn = Callable[[str, Column], Column]


@dataclass(frozen=True)
class ToArray:
    """Columns collected into an array at ``target``: those listed, or those whose names the pattern matches (it wins).

    ``sort_by``: key of a column name (by default, the order of the list or of appearance). ``keep``: predicate on a
    cell's Column. ``empty``: ``skip`` leaves out NULLs and blanks, ``keep`` has them as NULL. ``value``: maps a cell.
    """

    target: str
    columns: Sequence[str] = ()
    pattern: str | re.Pattern | None = None
    sort_by: Callable[[str], Any] | None = None
    keep: Callable[[Column], Column] | None = None
    empty: str = "skip"
    value: Callable[[Column], Column] | None = None

    def sources(self, names: Sequence[str]) -> list[str]:
        found = [n for n in names if re.search(self.pattern, n)] if self.pattern is not None else [n for n in self.columns if n in names]
        return sorted(found, key=self.sort_by) if self.sort_by else found


@dataclass(frozen=True)
class FromArray:
    """An array spread over columns: those named, or ``prefix`` 1, 2, ... up to ``max_columns`` (or the longest array).

    A missing element shows as ``empty_cell``. ``drop_empty`` leaves out NULL and blank elements first.
    """

    columns: Sequence[str] = ()
    prefix: str | None = None
    max_columns: int | None = None
    empty_cell: str = ""
    drop_empty: bool = False


HeaderMap = Mapping[str | int, Any]


def _checked(header_map: HeaderMap | None) -> HeaderMap:
    if not header_map:
        raise RowFrameError("a header map must name at least one column")
    return header_map


class _Tree(dict):
    """Paths as nested structs."""

    def put(self, path: str, value: Column) -> None:
        at, *parts = self, *path.split(".")
        for p in parts[:-1]:
            below = at.get(p)
            if not isinstance(below, _Tree):
                below = at[p] = _Tree()
            at = below
        at[parts[-1]] = value

    def columns(self) -> list[Column]:
        return [(F.struct(*v.columns()) if isinstance(v, _Tree) else v).alias(k) for k, v in self.items()]


def compile_read(header_map: HeaderMap, names: Sequence[str], merge: MergeFn | None = None, keep_unmapped: bool = False) -> list[Column]:
    """The projection that turns flat columns into the map's shape.

    Keys are column names, or places (int). Values are a dotted path, a ToArray, or a callback over Columns that gives
    {path: value}. Columns without an entry are dropped unless ``keep_unmapped``.
    """
    tree, used = _Tree(), set()
    merged = merge or (lambda path, c: c)
    for key, to in _checked(header_map).items():
        name = names[key] if isinstance(key, int) and key < len(names) else key
        if isinstance(to, ToArray):
            own = to.sources(names)
            used.update(own)
            tree.put(to.target, _gathered(to, own, merged))
            continue
        if name not in names:
            continue
        used.add(name)
        cell = F.col(quote_name(name))
        if callable(to):
            for path, value in to(cell, Columns(names)).items():
                tree.put(path, as_column(value))
        else:
            tree.put(to, merged(to, cell))
    if keep_unmapped:
        for n in names:
            if n not in used and n not in tree:
                tree[n] = F.col(quote_name(n))
    return tree.columns()


def _gathered(to: ToArray, names: Sequence[str], merged: MergeFn) -> Column:
    if not names:
        return F.lit(None).cast("array<string>")
    cells = F.array(*[F.col(quote_name(n)) for n in names])
    blank = lambda c: c.isNull() | (C.dyn_trim(c.cast("string")) == "")
    if to.empty == "skip":
        cells = F.filter(cells, lambda c: ~blank(c))
    else:
        cells = F.transform(cells, lambda c: F.when(~blank(c), c))
    if to.keep:
        cells = F.filter(cells, lambda c: F.coalesce(to.keep(c), F.lit(False)))
    if to.value:
        cells = F.transform(cells, to.value)
    cells = F.transform(cells, lambda c: merged(to.target, c))
    return F.when(F.size(cells) > 0, cells)


def map_rows(frame, header_map: HeaderMap, merge: MergeFn | None = None, keep_unmapped: bool = False):
    """A frame in the map's shape."""
    return frame._select(compile_read(header_map, frame.columns, merge, keep_unmapped))


def _cell(c: Column, kind: T.DataType) -> Column:
    """A cell as text: nested values as JSON, NULL empty."""
    if isinstance(kind, T.StructType | T.ArrayType | T.MapType):
        return F.coalesce(to_json_text(c), F.lit(""))
    return F.when(c.isNull(), "").otherwise(C.dyn_string(c, kind))


def _at(schema: T.StructType, path: str) -> T.DataType | None:
    kind: Any = schema
    for p in path.split("."):
        if not isinstance(kind, T.StructType) or p not in kind.fieldNames():
            return None
        kind = kind[p].dataType
    return kind


def compile_write(frame, header_map: Mapping[str, Any]) -> list[Column]:
    """The projection that turns nested rows into flat text columns.

    Keys are dotted paths; values a column name, a place (int), or a FromArray. What is missing is an empty cell.
    """
    schema, out, placed = frame.schema, [], {}
    for path, to in _checked(header_map).items():
        kind = _at(schema, path)
        c = F.col(".".join(quote_name(p) for p in path.split("."))) if kind is not None else F.lit("")
        kind = kind or T.StringType()
        if isinstance(to, FromArray):
            out += _spread(frame, to, c, kind)
        elif isinstance(to, int):
            placed[to] = _cell(c, kind)
        else:
            out.append(_cell(c, kind).alias(to))
    return [placed[k].alias(str(k)) if k in placed else F.lit("").alias(str(k)) for k in range(max(placed, default=-1) + 1)] + out


def _spread(frame, to: FromArray, c: Column, kind: T.DataType) -> list[Column]:
    inner = kind.elementType if isinstance(kind, T.ArrayType) else T.StringType()
    items = c if isinstance(kind, T.ArrayType) else F.lit(None).cast("array<string>")
    if to.drop_empty:
        items = F.filter(items, lambda x: x.isNotNull() & (x.cast("string") != ""))
    if to.columns:
        names = list(to.columns)[: to.max_columns]
    else:
        width = to.max_columns
        if width is None:
            width = frame._df.agg(F.max(F.size(items))).first()[0] or 0
        names = [f"{to.prefix or ''}{k}" for k in range(1, max(0, width) + 1)]
    return [F.when(F.get(items, F.lit(k)).isNull(), to.empty_cell).otherwise(_cell(F.get(items, F.lit(k)), inner)).alias(n) for k, n in enumerate(names)]


def unmap_rows(frame, header_map: Mapping[str, Any]):
    """A frame of flat text columns, by a write map."""
    return frame._select(compile_write(frame, header_map))


def invert(header_map: Mapping[str, str]) -> dict[str, str]:
    """The write map of a read map of names to paths, one to one."""
    out = {v: k for k, v in header_map.items() if isinstance(v, str)}
    if len(out) != len(header_map):
        raise RowFrameError("only a one-to-one map of names to paths can be inverted")
    return out


def rows_to_objects(frame_class, spark, rows: Iterable[Sequence | Mapping], header_map: HeaderMap, header: Sequence[str] | None = None, merge: MergeFn | None = None):
    """Arrays or dicts as a frame in the map's shape; arrays are read by place, or by ``header``'s names."""
    rows = list(rows)
    arrays = bool(rows) and not isinstance(rows[0], Mapping)
    if arrays and header is None and any(isinstance(k, str) for k in header_map):
        raise RowFrameError("arrays need a header row where the map names columns")
    if arrays:
        width = max(map(len, rows))
        names = list(header) if header else [str(k) for k in range(width)]
        rows = [dict(zip(names, r, strict=False)) for r in rows]
    return map_rows(frame_class.from_data(spark, rows), _checked(header_map), merge)


def objects_to_rows(frame, header_map: Mapping[str, Any], headers: Sequence[str] | None = None, include_headers: bool = False) -> list[list[str]]:
    """The rows as lists of texts in the order of ``headers`` (or of the map)."""
    flat = unmap_rows(frame, header_map)
    names = list(headers) if headers else flat.columns
    rows = [[r.get(n, "") for n in names] for r in flat.to_array()]
    return [names, *rows] if include_headers else rows
