"""Dialects of delimited text, and options of reading and writing."""

from __future__ import annotations

import csv
import io
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import chain, islice
from typing import Any, TypeVar

from rowframe.errors import RowFrameError

A = TypeVar("A")


@dataclass(frozen=True)
class Dialect:
    """How a delimited text is written.

    ``columns``: True takes names from the first record, a list gives them, a callable maps the first record's names,
    False leaves records as arrays. ``from_line`` counts lines from 1, ``to_record`` limits records. With ``nulls`` an empty
    cell is NULL without quotes and an empty text within them; else both are empty texts.
    """

    delimiter: str = ","
    quote: str = '"'
    escape: str = '"'
    comment: str | None = None
    skip_empty_lines: bool = True
    trim: bool = False
    bom: bool = True
    encoding: str = "utf-8"
    relax_column_count: bool = False
    columns: bool | list[str] | Callable[[list[str]], list[str]] = True
    from_line: int = 1
    to_record: int | None = None
    multiline: bool = True
    nulls: bool = False

    def reader_options(self) -> dict[str, Any]:
        """Spark reader options of this dialect."""
        own = {
            "sep": self.delimiter,
            "quote": self.quote,
            "escape": self.escape,
            "encoding": self.encoding,
            "multiLine": self.multiline,
            "ignoreLeadingWhiteSpace": self.trim,
            "ignoreTrailingWhiteSpace": self.trim,
            "emptyValue": "",
            "mode": "PERMISSIVE" if self.relax_column_count else "FAILFAST",
            "columnPruning": False,
            "enforceSchema": True,
        }
        if self.escape == self.quote:  # else Spark's parser takes a NUL beside a quote for an escape
            own["charToEscapeQuoteEscaping"] = self.quote
        return own | ({"comment": self.comment} if self.comment else {})


def dialect(**given: Any) -> Dialect:
    """A Dialect; ``from_``, ``fromLine`` and ``to``, ``to_line``, ``toLine`` are other names of the line window."""
    for other in ("from_", "from", "fromLine"):
        if other in given:
            given.setdefault("from_line", given.pop(other))
    for other in ("to", "to_line", "toLine"):
        if other in given:
            given.setdefault("to_record", given.pop(other))
    return Dialect(**given)


@dataclass(frozen=True)
class Retry:
    """Attempts after the first, the first wait in seconds (doubled each time), and what is told of a failure."""

    max_retries: int = 3
    base_delay: float = 0.1
    log: Callable[[str], None] | None = None

    def run(self, action: Callable[[], A], what: str) -> A:
        for attempt in range(self.max_retries + 1):
            try:
                return action()
            except Exception as e:
                if attempt == self.max_retries:
                    raise RowFrameError(f"{what} failed after {attempt + 1} attempts: {e}", e) from e
                if self.log:
                    self.log(f"{what}: attempt {attempt + 1} failed: {e}")
                time.sleep(self.base_delay * 2**attempt)
        raise AssertionError


def records(text: str, d: Dialect) -> Iterator[list[str]]:
    """The records of a text, without comments and, if so asked, blank lines."""
    kind = {"delimiter": d.delimiter, "quotechar": d.quote, "doublequote": d.escape == d.quote, "escapechar": None if d.escape == d.quote else d.escape, "skipinitialspace": False, "strict": True, "quoting": csv.QUOTE_NOTNULL if d.nulls else csv.QUOTE_MINIMAL}
    lines = io.StringIO(text.removeprefix("﻿") if d.bom else text, newline="")
    try:
        for cells in csv.reader((x for x in lines if not (d.comment and x.startswith(d.comment))), **kind):
            if d.skip_empty_lines and not any(c and c.strip() for c in cells):
                continue
            yield [c and c.strip() for c in cells] if d.trim else cells
    except csv.Error as e:
        raise RowFrameError(f"the text cannot be parsed: {e}", e) from e


def cut_lines(text: str, first: int) -> tuple[str, str]:
    """The lines before line ``first`` (from 1), as they are, and the rest."""
    lines = text.splitlines(keepends=True)
    return "".join(lines[: first - 1]), "".join(lines[first - 1 :])


def parse(text: str, d: Dialect) -> tuple[list[str], list[list[str]]]:
    """Column names and rows. Rows of another length are an error unless the dialect is relaxed (then cut or filled)."""
    rows = records(cut_lines(text, d.from_line)[1], d)
    if isinstance(d.columns, list):
        names: list[str] = list(d.columns)
    else:
        first = next(rows, None)
        if first is None:
            return [], []
        if d.columns is False:
            names, rows = [str(k) for k in range(len(first))], chain([first], rows)
        else:
            first = [c or "" for c in first]
            names = d.columns(first) if callable(d.columns) else first
    out = []
    for k, row in enumerate(islice(rows, d.to_record)):
        if len(row) != len(names):
            if not d.relax_column_count:
                raise RowFrameError(f"inconsistent column count: record {k + 1} has {len(row)} cells, the header {len(names)}")
            row = (row + [None] * len(names))[: len(names)]
        out.append(row)
    return names, out


def is_valid_csv(text: str, d: Dialect | None = None) -> bool:
    """Whether the first five records parse, all of one length; a text of one column is valid."""
    try:
        parse(text, replace(d or Dialect(), to_record=5))
    except RowFrameError:
        return False
    return True


__all__ = ["Dialect", "Retry", "cut_lines", "dialect", "is_valid_csv", "parse", "records"]
