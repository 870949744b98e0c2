"""Custom casts of cells: tested and parsed by Column expressions, by column or for all columns.

A column has one type in a plan, so the rule "first caster whose test passes" is decided inside one CASE per cell for
column rules, and per column for global definitions: a global definition is used on a column when every non-NULL cell
passes its test (one aggregate over all columns finds out).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowframe.functions import coerce as C
from rowframe.operators.base import quote_name

#: The order in which global definitions are tried.
GLOBAL_ORDER = ("null", "boolean", "number", "date", "object", "array", "string")


@dataclass(frozen=True)
class CastContext:
    """What a caster may ask about its cell: its column, the column's place, and whether it is a header (never)."""

    column: str
    index: int
    header: bool = False


@dataclass(frozen=True)
class Caster:
    """``test`` and ``parse`` map a cell's Column (and its context) to Columns; parse gives NULL where it fails."""

    test: Callable[..., Column]
    parse: Callable[..., Column]

    def tests(self, c: Column, context: CastContext) -> Column:
        return F.coalesce(_call(self.test, c, context), F.lit(False))

    def parses(self, c: Column, context: CastContext) -> Column:
        return _call(self.parse, c, context)


def _call(fn: Callable, c: Column, context: CastContext) -> Column:
    from rowframe.operators.base import takes

    return fn(c, context) if takes(fn) > 1 else fn(c)


def python_caster(test: Callable[[Any], bool], parse: Callable[[Any], Any], returns: str) -> Caster:
    """A caster of Python callables, run in Arrow batches; an exception in ``parse`` is a failed cast."""

    def safe(value: Any) -> Any:
        try:
            return parse(value)
        except Exception:
            return None

    tests, parses = F.udf(lambda v: bool(test(v)), "boolean", useArrow=True), F.udf(safe, returns, useArrow=True)
    return Caster(lambda c: tests(c), lambda c: parses(c))


def _json(kind: str) -> Callable[[Column], Column]:
    return lambda c: F.when(C.dyn_trim(c).rlike(r"(?s)^\{.*\}$" if kind == "object" else r"(?s)^\[.*\]$"), F.try_parse_json(c))


#: Casters of the named types, for rules that name a type without a definition.
DEFAULTS: dict[str, Caster] = {
    "string": Caster(lambda c: c.isNotNull(), lambda c: c.cast("string")),
    "number": Caster(lambda c: C.cast_number(c).isNotNull(), C.cast_number),
    "boolean": Caster(lambda c: C.dyn_bool(c).isNotNull() & (C.dyn_trim(c.cast("string")) != ""), C.dyn_bool),
    "date": Caster(lambda c: C.dyn_date(c).isNotNull(), C.dyn_date),
    "object": Caster(lambda c: _json("object")(c).isNotNull(), _json("object")),
    "array": Caster(lambda c: _json("array")(c).isNotNull(), _json("array")),
    "null": Caster(lambda c: C.dyn_trim(c.cast("string")).isin("", "null", "NULL"), lambda c: F.lit(None).cast("string")),
}


@dataclass(frozen=True)
class CustomCasts:
    """``definitions``: casters by name; ``columns``: a name, a caster or a list of them for a column (or nested path).

    ``on_error``: ``error`` raises when the plan runs, ``null`` gives NULL, ``original`` keeps the cell (as text, if the
    caster's type is another).
    """

    definitions: Mapping[str, Caster] = field(default_factory=dict)
    columns: Mapping[str, str | Caster | Sequence[str | Caster]] = field(default_factory=dict)
    on_error: str = "error"


def _rules(casts: CustomCasts, given: Any) -> list[Caster]:
    listed = given if isinstance(given, list | tuple) else [given]
    found = [casts.definitions.get(g) or DEFAULTS.get(g) if isinstance(g, str) else g for g in listed]
    return [f for f in found if f is not None]


def _failed(casts: CustomCasts, c: Column, name: str, kind: T.DataType, own: T.DataType) -> Column:
    if casts.on_error == "null":
        return F.lit(None).cast(kind)
    if casts.on_error == "original":
        return c if kind == own else c.cast("string")
    return F.raise_error(F.concat(F.lit(f"column {name} cannot be cast: "), F.coalesce(c.cast("string"), F.lit("null")))).cast(kind)


def _cast_column(frame, casts: CustomCasts, name: str, c: Column, own: T.DataType, rules: list[Caster], index: int) -> Column:
    """The first rule whose test passes parses the cell; where none passes, or parsing fails, on_error decides."""
    context = CastContext(name, index)
    parsed = [r.parses(c, context) for r in rules]
    kinds = [frame._df.select(p.alias("p")).schema[0].dataType for p in parsed]
    kind = kinds[0] if all(k == kinds[0] for k in kinds) and not (casts.on_error == "original" and kinds[0] != own) else T.StringType()
    result = None
    for r, p in zip(rules, parsed, strict=True):
        p = p.cast("string") if kind != frame._df.select(p.alias("p")).schema[0].dataType else p
        value = F.coalesce(p, F.when(p.isNull(), _failed(casts, c, name, kind, own)))
        result = F.when(r.tests(c, context), value) if result is None else result.when(r.tests(c, context), value)
    untouched = c if own == kind else F.lit(None).cast(kind) if casts.on_error == "null" else _failed(casts, c, name, kind, own) if casts.on_error == "error" else c.cast(kind)
    return F.when(c.isNull(), F.lit(None).cast(kind)).otherwise(result.otherwise(untouched))


def apply_casts(frame, casts: CustomCasts):
    """The frame with its cells cast; column rules first, then global definitions on the columns without one."""
    if casts.on_error not in ("error", "null", "original"):
        raise ValueError(f"unknown on_error: {casts.on_error}")
    columns: dict[str, Column] = {}
    for path, given in casts.columns.items():
        name, *rest = path.split(".")
        rules = _rules(casts, given)
        if name not in frame.columns or not rules:
            continue
        c = F.col(".".join(quote_name(p) for p in path.split(".")))
        own = frame._df.select(c.alias("c")).schema[0].dataType
        cast = _cast_column(frame, casts, path, c, own, rules, frame.columns.index(name))
        columns[name] = columns.get(name, F.col(quote_name(name))).withField(".".join(quote_name(p) for p in rest), cast) if rest else cast
    named = [n for n in GLOBAL_ORDER if n in casts.definitions]
    free = [c for c in frame.columns if c not in columns]
    if named and free:
        passes = [F.coalesce(F.bool_and(casts.definitions[n].tests(F.col(quote_name(c)), CastContext(c, k)) | F.col(quote_name(c)).isNull()), F.lit(False)).alias(f"p{k}_{n}") for k, c in enumerate(free) for n in named]
        found = frame._df.agg(*passes).first().asDict()
        for k, c in enumerate(free):
            n = next((n for n in named if found[f"p{k}_{n}"]), None)
            if n:
                columns[c] = _cast_column(frame, casts, c, F.col(quote_name(c)), frame._kind(c), [casts.definitions[n]], frame.columns.index(c))
    return frame._replace(columns) if columns else frame


__all__ = ["DEFAULTS", "GLOBAL_ORDER", "CastContext", "Caster", "CustomCasts", "apply_casts", "python_caster"]
