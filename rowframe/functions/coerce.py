"""Coercions of dynamically typed cells as Column expressions.

Cells come from delimited text and loosely typed records, so operators compare and convert them by the rules of a dynamic
language rather than by SQL casts: every value has a text, a blank counts as the number 0, a failed conversion is NULL.
All of them are safe under ANSI mode and stay in whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: All Unicode white space, the no-break spaces and the byte order mark.
_BLANKS = r"[\s ﻿\p{Z}]"
_TRIM = f"^{_BLANKS}+|{_BLANKS}+$"
_DECIMAL = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"

#: What reads as true and as false.
TRUE_TEXTS = ("true", "1", "yes", "on", "t")
FALSE_TEXTS = ("false", "0", "no", "off", "f", "")

#: Date and time patterns that are tried in turn after the ISO forms.
DATE_PATTERNS = ("MM/dd/yyyy", "M/d/yyyy", "MM/dd/yyyy HH:mm:ss", "yyyy/MM/dd", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMM yyyy HH:mm:ss z")


def dyn_trim(c: Column) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.regexp_replace(c, _TRIM, "")


def _number_text(c: Column) -> Column:
    """A double's shortest text: no ``.0``; exponents only outside 1e-6 .. 1e21, written ``1e+21``."""
    spark = c.cast("string")
    whole = F.when((F.abs(c) < 1e15) & (c == F.floor(c)), c.cast("long").cast("string"))
    wide = F.when((F.abs(c) < 1e21) & (F.abs(c) >= 1e7), F.regexp_replace(c.cast("decimal(38,10)").cast("string"), r"\.?0+$", ""))
    exponent = F.regexp_replace(F.regexp_replace(F.regexp_replace(spark, r"\.0E", "E"), "E(?=[0-9])", "e+"), "E-", "e-")
    small = F.when((F.abs(c) >= 1e-6) & (F.abs(c) < 1e-3), F.regexp_replace(c.cast("decimal(38,22)").cast("string"), r"\.?0+$", ""))
    named = F.when(F.isnan(c), "NaN").when(c == float("inf"), "Infinity").when(c == float("-inf"), "-Infinity")
    return F.coalesce(named, whole, wide, small, F.when(spark.contains("E"), exponent), spark)


def dyn_string(c: Column, kind: T.DataType | None = None) -> Column:
    """The text of a value: NULL is ``null``, 100.0 is ``100``, true is ``true``. ``kind``: the column's type if known."""
    if isinstance(kind, T.DoubleType | T.FloatType):
        text = _number_text(c.cast("double"))
    elif isinstance(kind, T.StructType | T.ArrayType | T.MapType):
        text = F.to_json(c)
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("null"))


def dyn_number(c: Column, kind: T.DataType | None = None) -> Column:
    """The number a value reads as: blank and NULL are 0, booleans 0 or 1, hexadecimal and exponents count; else NULL."""
    if isinstance(kind, T.NumericType):
        return F.coalesce(F.when(~F.isnan(c.cast("double")), c.cast("double")), F.when(c.isNull(), 0.0))
    if isinstance(kind, T.BooleanType):
        return F.coalesce(c.cast("int").cast("double"), F.lit(0.0))
    if isinstance(kind, T.TimestampType):
        return F.coalesce(F.unix_millis(c).cast("double"), F.lit(0.0))
    t = dyn_trim(c.cast("string"))
    return (
        F.when(c.isNull() | (t == ""), 0.0)
        .when(t.rlike(_DECIMAL), t.try_cast("double"))
        .when(t.rlike("^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substring(t, 3, 15), 16, 10).try_cast("double"))
        .when(t == "Infinity", float("inf"))
        .when(t == "-Infinity", float("-inf"))
    )


def cast_number(c: Column, kind: T.DataType | None = None) -> Column:
    """A column cast to number: as dyn_number(), but blank, NULL and booleans are NULL."""
    if isinstance(kind, T.NumericType):
        return F.when(~F.isnan(c.cast("double")), c.cast("double"))
    if isinstance(kind, T.BooleanType):
        return F.lit(None).cast("double")
    return F.when(c.isNotNull() & (dyn_trim(c.cast("string")) != ""), dyn_number(c, kind))


def dyn_bool(c: Column, kind: T.DataType | None = None) -> Column:
    """true or false for the texts that read so (in any case, trimmed), else NULL."""
    if isinstance(kind, T.BooleanType):
        return c
    t = F.lower(dyn_trim(dyn_string(c, kind)))
    return F.when(c.isNull(), F.lit(None).cast("boolean")).when(t.isin(*TRUE_TEXTS), True).when(t.isin(*FALSE_TEXTS), False)


def dyn_date(c: Column, kind: T.DataType | None = None) -> Column:
    """The instant a value reads as: timestamps stay, numbers are milliseconds, ISO and common forms are parsed; else NULL."""
    if isinstance(kind, T.TimestampType):
        return c
    if isinstance(kind, T.DateType):
        return c.cast("timestamp")
    if isinstance(kind, T.NumericType):
        return F.timestamp_millis(c.cast("long"))
    t = dyn_trim(c.cast("string"))
    iso = F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?([T ].*)?$"), F.try_to_timestamp(t))
    bare = F.regexp_replace(t, "^[A-Za-z]{3}, ", "")
    return F.coalesce(iso, *[F.when(bare != "", F.try_to_timestamp(bare, F.lit(p))) for p in DATE_PATTERNS])


def collation_key(c: Column, kind: T.DataType | None = None) -> Column:
    """What texts sort by: Unicode collation, NULL as the text ``null``."""
    return F.collate(dyn_string(c, kind), "UNICODE")
