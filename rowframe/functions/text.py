"""Text and nested-value functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORMALIZATIONS = ("lowercase", "uppercase", "capitalize")


def capitalize_words(c: Column) -> Column:
    """Each word between single spaces: first character upper case, the rest lower case."""
    words = F.transform(F.split(c, " ", -1), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30))))
    return F.array_join(words, " ")


def normalize(c: Column, how: str) -> Column:
    """``lowercase``, ``uppercase`` or ``capitalize``."""
    if how not in NORMALIZATIONS:
        raise ValueError(f"unknown normalisation: {how}")
    return {"lowercase": F.lower, "uppercase": F.upper, "capitalize": capitalize_words}[how](c)


def edit_distance(c: Column, text: str) -> Column:
    """Levenshtein distance of the cell's text to ``text``."""
    return F.levenshtein(c.cast("string"), F.lit(text))


def to_json_text(c: Column) -> Column:
    """JSON of a nested value, with NULL fields written."""
    return F.to_json(c, {"ignoreNullFields": "false"})


def quote(path: str) -> str:
    """A dotted path whose parts are quoted names."""
    return ".".join(f"`{p}`" for p in path.split("."))


def get_path(path: str) -> Column:
    """The value at a dotted path."""
    return F.col(quote(path))


def set_path(c: Column, path: str, value: Column) -> Column:
    """A struct with the field at a dotted path replaced or added."""
    return c.withField(quote(path), value)
