"""Writing delimited text: one ordered file with preamble and byte order mark, folders of parts, and strings."""

from __future__ import annotations

import codecs
import csv
import io
import os
import re
import sys
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from typing import IO, Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowframe.durable import remove, shared_folder
from rowframe.errors import RowFrameError
from rowframe.functions import coerce as C
from rowframe.functions.text import to_json_text
from rowframe.operators.base import quote_name
from rowframe.plans.headermap import unmap_rows
from rowframe.sources.dialect import Dialect, Retry


def output_cell(c: Column, kind: T.DataType) -> Column:
    """A cell's text in a file: true is 1, false and NULL are empty, instants are milliseconds, nested values JSON."""
    if isinstance(kind, T.BooleanType):
        return F.when(c, "1").otherwise("")
    if isinstance(kind, T.TimestampType):
        return F.coalesce(F.unix_millis(c).cast("string"), F.lit(""))
    if isinstance(kind, T.StructType | T.ArrayType | T.MapType):
        return F.coalesce(to_json_text(c), F.lit(""))
    return F.when(c.isNull(), "").otherwise(C.dyn_string(c, kind))


def _texts(frame, nulls: bool = False):
    """The frame with its cells' texts; NULL stays NULL where the dialect tells it from an empty text."""
    if nulls and len(frame.columns) == 1:
        raise RowFrameError("a file of one column cannot tell NULL from a blank line")
    cells = [(F.col(quote_name(f.name)), f) for f in frame.schema]
    return frame._select([(F.when(c.isNotNull(), output_cell(c, f.dataType)) if nulls else output_cell(c, f.dataType)).alias(f.name) for c, f in cells])


class _Lines:
    """A csv writer that hands out its lines."""

    def __init__(self, d: Dialect, quoted: bool = False):
        self.buffer = io.StringIO()
        self.writer = csv.writer(self.buffer, delimiter=d.delimiter, quotechar=d.quote, doublequote=d.escape == d.quote, escapechar=None if d.escape == d.quote else d.escape, lineterminator="\n", quoting=csv.QUOTE_ALL if quoted else csv.QUOTE_NOTNULL if d.nulls else csv.QUOTE_MINIMAL)

    def line(self, cells: Sequence[Any]) -> str:
        self.writer.writerow(cells)
        text = self.buffer.getvalue()
        self.buffer.seek(0)
        self.buffer.truncate()
        return text


def _line(names: Sequence[str], d: Dialect, quoted: bool = False) -> Column:
    """The line of a row of text cells, without its end, as _Lines writes it."""
    double, cells = d.escape == d.quote, []
    for name in names:
        c = body = F.col(quote_name(name))
        for x in (d.quote,) if double else (d.escape, d.quote):
            body = F.replace(body, F.lit(x), F.lit(d.escape + x))
        apart = F.lit(quoted)
        for x in (d.delimiter, "\n", "\r", *((d.quote,) if double else ())):
            apart = apart | c.contains(x)
        if d.nulls or len(names) == 1:
            apart = apart | (c == "")
        cells.append(F.coalesce(F.when(apart, F.concat(F.lit(d.quote), body, F.lit(d.quote))).otherwise(body), F.lit("")))
    return F.concat_ws(d.delimiter, *cells)


def _planned(frame, dialect: Dialect | None = None, header: bool | Sequence[str] = True, header_map: Mapping | None = None, preamble: str | None = None, quoted: bool = False) -> tuple[list[str], DataFrame]:
    """What stands before the rows (preamble, header), and the rows' lines in order, without their ends."""
    d = dialect or Dialect()
    flat = unmap_rows(frame, header_map) if header_map else _texts(frame, d.nulls)
    before = frame.preamble if preamble is None else preamble
    head = [before if before.endswith("\n") else before + "\n"] if before else []
    if header:
        head.append(_Lines(d, quoted).line(flat.columns if header is True else list(header)))
    return head, flat.ordered().select(_line(flat.columns, d, quoted).alias("value"))


def lines_of(frame, **options: Any) -> Iterator[str]:
    """The file's lines in order, streamed: preamble, header, rows; options as of _planned()."""
    head, rows = _planned(frame, **options)
    yield from head
    for row in rows.toLocalIterator(prefetchPartitions=True):
        yield row["value"] + "\n"


def to_string(frame, **options: Any) -> str:
    """The whole table as text, with a header by default."""
    return "".join(lines_of(frame, **{"preamble": ""} | options))


def _is_local(spark, path: str) -> bool:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return "://" not in path and not path.startswith("file:") and (conf.get("fs.defaultFS") or "file:").startswith("file:")


def _stream(spark, path: str) -> Any:
    """The JVM's output stream into a path."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    if _is_local(spark, path):
        return jvm.java.io.FileOutputStream(os.path.abspath(path))
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(conf).create(at, True)


def _open(spark, path: str) -> IO[bytes]:
    """A binary sink for a local path, or for any path that Hadoop's file systems know."""
    if _is_local(spark, path):
        return open(path, "wb")
    stream = _stream(spark, path)

    class Sink(io.RawIOBase):
        def writable(self) -> bool:
            return True

        def write(self, data) -> int:
            stream.write(bytearray(data), 0, len(data))
            return len(data)

        def close(self) -> None:
            if not self.closed:
                stream.close()
            super().close()

    return io.BufferedWriter(Sink(), 1 << 20)


#: Encodings that begin with a byte order mark, and how a file goes on after it.
MARKED = {"utf-8-sig": "utf-8", "utf-16": f"utf-16-{sys.byteorder[0]}e", "utf-32": f"utf-32-{sys.byteorder[0]}e"}


def _write_lines(rows: DataFrame, folder: str, encoding: str) -> None:
    """Lines as part files in an encoding, each with its end."""
    name = codecs.lookup(encoding).name
    name = MARKED.get(name, name)
    if name != "utf-8":
        rows = rows.select(F.udf(lambda line: line.encode(name), "binary")("value").cast("string").alias("value"))
    rows.write.options(lineSep="\n".encode(name).decode("latin-1"), compression="none").text(folder)


def _join_parts(spark, head: bytes, folder: str, target: str) -> None:
    """One file of ``head`` and the folder's parts in their order; a part goes as soon as it is copied."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(conf)
    found = ((re.match(r"part-(\d+).*?(?:-c(\d+))?\.\w+$", s.getPath().getName()), s.getPath()) for s in fs.listStatus(at))
    parts = sorted(((int(m[1]), int(m[2] or 0)), k, p) for k, (m, p) in enumerate(found) if m)
    sink = _stream(spark, target)
    try:
        sink.write(bytearray(head), 0, len(head))
        for _, _, part in parts:
            source = fs.open(part)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, sink, 1 << 20, False)
            finally:
                source.close()
            fs.delete(part, False)
    finally:
        sink.close()


def write_file(frame, path: str, *, bom: bool = False, suffix: bool = True, retry: Retry | None = None, encoding: str = "utf-8", **options: Any) -> str:
    """One file, in order; ``.csv`` is added if absent.

    Executors write the lines as parts in the shared folder, and the driver's JVM copies the parts' bytes into the file,
    a buffer at a time: no rows come to the driver. For tables that one file should not hold, see write_folder().
    """
    target = path if not suffix or path.endswith(".csv") else path + ".csv"

    def write() -> str:
        head, rows = _planned(frame, **options)
        folder = f"{shared_folder(frame.spark).rstrip('/')}/{uuid.uuid4().hex}"
        try:
            _write_lines(rows, folder, encoding)
            _join_parts(frame.spark, "".join(["﻿"] * bom + head).encode(encoding), folder, target)
        finally:
            remove(frame.spark, folder)
        return target

    return retry.run(write, f"writing {target}") if retry else write()


def write_folder(frame, path: str, dialect: Dialect | None = None, header: bool = True, header_map: Mapping | None = None, mode: str = "errorifexists") -> str:
    """A folder of part files written in parallel; parts are range-sorted, so their names follow the order."""
    d = dialect or Dialect()
    flat = unmap_rows(frame, header_map) if header_map else _texts(frame, d.nulls)
    empty = d.quote * 2 if d.nulls or len(flat.columns) == 1 else ""  # a blank line is no record
    whole = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}  # Spark's writer trims cells by default
    flat.ordered().write.mode(mode).options(header=header, sep=d.delimiter, quote=d.quote, escape=d.escape, emptyValue=empty, encoding=d.encoding, **whole).csv(path)
    return path


def write_rows(path: str, rows: Iterable[Mapping[str, Any]], header: Sequence[str] | None = None, dialect: Dialect | None = None, preamble: str = "", transform: Callable[[Mapping], Mapping] | None = None) -> int:
    """Row dicts from a generator written to a file as they come, on any file system that Spark knows; their number."""
    out, n = _Lines(dialect or Dialect()), 0
    with io.TextIOWrapper(_open(SparkSession.active(), path), encoding="utf-8", newline="") as sink:
        if preamble:
            sink.write(preamble if preamble.endswith("\n") else preamble + "\n")
        names = list(header) if header else None
        if names:
            sink.write(out.line(names))
        for row in rows:
            row = transform(row) if transform else row
            if names is None:
                names = list(row)
                sink.write(out.line(names))
            sink.write(out.line([row.get(k) for k in names]))
            n += 1
    return n
