"""Schema validation of rows, as expressions.

A field has checks (and may coerce its value); a row schema has fields and checks over several columns. Issues of a row
are collected in the plan; the modes are: ``error`` (one aggregate, then raise), ``filter`` (keep valid rows) and
``keep`` (all rows; what was found is in ``validation_results``). Column schemas run first, then the row schema.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from rowframe.errors import RowFrameError
from rowframe.functions import coerce as C
from rowframe.operators.base import Columns, quote_name
from rowframe.ship import ship

MODES = ("error", "filter", "keep")
_ISSUES = "array<struct<message: string, path: string>>"


@runtime_checkable
class StandardValidator(Protocol):
    """A validator object: validate(value) gives {"value": ...} or {"issues": [{"message": ..., "path": ...}]}."""

    def validate(self, value: Any) -> Mapping[str, Any]: ...


def try_validate(schema: StandardValidator, value: Any) -> Mapping[str, Any]:
    """The validator's result; an exception counts as an issue."""
    try:
        return schema.validate(value)
    except Exception as e:
        return {"issues": [{"message": str(e)}]}


@dataclass(frozen=True)
class Check:
    """A condition on a value's Column and what is said where it does not hold (NULL: does not hold)."""

    test: Callable[[Column], Column]
    message: str


@dataclass(frozen=True)
class Field:
    """Checks of one value. ``coerce`` maps it before the checks; ``optional`` lets NULL and blank pass.

    ``validator``: a Python validator instead of checks, run in Arrow batches; ``returns`` is the DDL of its value.
    """

    checks: Sequence[Check] = ()
    coerce: Callable[[Column], Column] | None = None
    optional: bool = False
    validator: StandardValidator | None = None
    returns: str = "string"

    def outcome(self, c: Column, path: str) -> tuple[Column, Column]:
        """The coerced value, and its issues."""
        if self.validator is not None:
            got = _validator(self.validator, self.returns, path)(c)
            return got["value"], got["issues"]
        value = self.coerce(c) if self.coerce else c
        found = F.array_compact(F.array(*[F.when(~F.coalesce(k.test(value), F.lit(False)), F.struct(F.lit(k.message).alias("message"), F.lit(path).alias("path"))) for k in self.checks])) if self.checks else F.array()
        found = found.cast(_ISSUES)
        if self.optional:
            found = F.when(c.isNull() | (C.dyn_trim(c.cast("string")) == ""), F.array().cast(_ISSUES)).otherwise(found)
        return value, found


def _validator(validator: StandardValidator, returns: str, path: str):
    def run(value: Any) -> dict[str, Any]:
        got = try_validate(validator, value)
        issues = got.get("issues") or []
        return {"value": None if issues else got.get("value", value), "issues": [{"message": str(i.get("message", "")), "path": str(i.get("path") or path)} for i in issues]}

    ship(SparkSession.active())
    return F.udf(run, f"struct<value: {returns}, issues: {_ISSUES}>", useArrow=True)


@dataclass(frozen=True)
class RowSchema:
    """Fields by name, and checks over the row: (condition of the row's Columns, message, path)."""

    fields: Mapping[str, Field] = field(default_factory=dict)
    checks: Sequence[tuple[Callable[[Columns], Column], str, str]] = ()


@dataclass(frozen=True)
class SchemaConfig:
    """What to validate and what to do with invalid rows."""

    row: RowSchema | None = None
    columns: Mapping[str, Field] = field(default_factory=dict)
    mode: str = "error"


def validate(frame, config: SchemaConfig):
    """The frame with values coerced where valid, by the config's mode; ``keep`` attaches validation_results.

    validation_results: original_row, validated_row (NULL where invalid), valid, row_issues, column_issues (by column).
    """
    if config.mode not in MODES:
        raise ValueError(f"unknown mode: {config.mode}")
    names = frame.columns
    if not names:
        return frame
    own = lambda n: F.col(quote_name(n)) if n in names else F.lit(None).cast("string")
    values, by_column, by_row = {}, {}, []
    for n, f in config.columns.items():
        values[n], by_column[n] = f.outcome(own(n), n)
    for n, f in (config.row.fields if config.row else {}).items():
        values[n], found = f.outcome(values.get(n, own(n)), n)
        by_row.append(found)
    for test, message, path in config.row.checks if config.row else ():
        by_row.append(F.when(~F.coalesce(test(Columns(names)), F.lit(False)), F.array(F.struct(F.lit(message).alias("message"), F.lit(path).alias("path")))).otherwise(F.array().cast(_ISSUES)))
    column_issues = F.map_filter(F.create_map(*[x for n, c in by_column.items() for x in (F.lit(n), c)]), lambda _, v: F.size(v) > 0) if by_column else F.create_map().cast(f"map<string, {_ISSUES}>")
    row_issues = F.concat(*by_row).cast(_ISSUES) if by_row else F.array().cast(_ISSUES)
    valid = (F.size(row_issues) == 0) & (F.size(column_issues) == 0)
    every = [*names, *[n for n in values if n not in names]]
    found = frame._df.select(
        F.struct(*[own(n).alias(n) for n in names]).alias("original_row"),
        F.struct(*[(values[n] if n in values else own(n)).alias(n) for n in every]).alias("__values"),
        valid.alias("valid"),
        row_issues.alias("row_issues"),
        column_issues.alias("column_issues"),
        *[k.name for k in frame._keys],
    )
    keys = [F.col(k.name) for k in frame._keys]
    if config.mode == "error":
        bad = found.where("NOT valid").limit(1).collect()
        if bad:
            issues = [i["message"] for i in bad[0]["row_issues"]] + [f"{k}: {i['message']}" for k, v in bad[0]["column_issues"].items() for i in v]
            raise RowFrameError("validation failed: " + "; ".join(issues))
    if config.mode != "keep":
        kept = found.where("valid") if config.mode == "filter" else found
        return frame._with(kept.select("__values.*", *keys))
    results = found.select("original_row", F.when(F.col("valid"), F.col("__values")).alias("validated_row"), "valid", "row_issues", "column_issues", *keys)
    kept = found.select(*[F.when(F.col("valid"), F.col("__values")[n]).otherwise(F.col("original_row")[n] if n in names else F.lit(None)).alias(n) if _same_type(found, n, names) else F.col("original_row")[n].alias(n) for n in every], *keys)
    out = frame._with(kept)
    out.validation_results = results.orderBy(*[k.sort() for k in frame._keys]).drop(*[k.name for k in frame._keys]) if frame._keys else results
    return out


def _same_type(found, n: str, names: Sequence[str]) -> bool:
    """Whether a coerced value may stand in the column beside original ones, or the column keeps its originals."""
    values, own = found.schema["__values"].dataType, found.schema["original_row"].dataType
    return n not in names or values[n].dataType == own[n].dataType


def with_mode(config: SchemaConfig, mode: str) -> SchemaConfig:
    return replace(config, mode=mode)
