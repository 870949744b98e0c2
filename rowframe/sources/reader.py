"""Reading delimited text: scan, preamble, names, header map, casts, structural checks, validation.

A plain file is one lazy Spark scan. A line window or preamble on a file without quoted line feeds is a text scan whose
first lines are filtered out by their place, so it stays splittable. Only a raw-text hook, or a line window together with
quoted line feeds, needs whole files in one task each.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import replace
from typing import IO, Any
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowframe.errors import RowFrameError
from rowframe.frame import Frame
from rowframe.operators.base import HIDDEN, Key, quote_name
from rowframe.plans.casting import CustomCasts, apply_casts
from rowframe.plans.headermap import HeaderMap, map_rows
from rowframe.plans.validate import SchemaConfig, validate
from rowframe.ship import ship
from rowframe.sources.dialect import Dialect, Retry, cut_lines, parse


def _strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _files(spark: SparkSession, path: str) -> list[str]:
    """The files that a path stands for, sorted; from Spark's listing, without reading them."""
    return sorted(unquote(f) for f in spark.read.text(path).inputFiles())


def _first_lines(spark: SparkSession, path: str, n: int, d: Dialect) -> list[str]:
    """The first n lines of a file, or of a folder's first file that has any: one small task, whatever the size."""
    for file in _files(spark, path):
        head = spark.read.option("encoding", d.encoding).text(file).where(F.col("_metadata.file_block_start") == 0).select("value").limit(n).collect()
        if head:
            return [r["value"].removesuffix("\r") for r in head]
    return []


def _keyed(df: DataFrame) -> tuple[DataFrame, list[Key]]:
    """File, block and place in the block as order keys; to be taken right above a file scan."""
    places = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
    keys = [Key(f"{HIDDEN}{k}") for k in range(3)]
    return df.select("*", *[c.alias(k.name) for c, k in zip(places, keys, strict=True)]), keys


#: Files whose first places are sent to all executors; more of them meet their lines in a join.
BROADCAST_FILES = 100_000


def _without_first_lines(lines: DataFrame, n: int, n_files: int) -> DataFrame:
    """The lines of a keyed scan without the first n of each file.

    Spark packs several files into a partition; a line's place in its file is counted from that file's first line, which
    one pass finds where there are several files.
    """
    at, block = F.col(f"{HIDDEN}2"), F.col(f"{HIDDEN}1")
    if n_files <= 1:
        return lines.where((block != 0) | (at.bitwiseAND(F.lit((1 << 33) - 1)) >= n))
    firsts = lines.where(block == 0).groupBy(f"{HIDDEN}0").agg(F.min(at).alias("__first"))
    joined = lines.join(F.broadcast(firsts) if n_files <= BROADCAST_FILES else firsts, f"{HIDDEN}0", "left")
    return joined.where((block != 0) | (at >= F.col("__first") + n)).select(*lines.columns)


#: Lines in which the first record is looked for at first, and at most: comments and quoted line feeds may stand before its end.
FEW_LINES, HEADER_LINES = 50, 50 << 12


def _first_record(spark: SparkSession, path: str, d: Dialect) -> list[str]:
    """The cells of the first record, from as many lines as it takes; none if there is no record."""
    n = FEW_LINES
    while True:
        lines = _first_lines(spark, path, n, d)
        last = len(lines) < n
        try:
            head = parse("\n".join(lines), replace(d, columns=False, to_record=1, relax_column_count=True))[1]
        except RowFrameError:
            if last:
                raise
            head = []
        if head or last:
            return head[0] if head else []
        if n >= HEADER_LINES:
            raise RowFrameError(f"no record ends within the first {n} lines of {path}")
        n *= 16


def _names(first: list[str], d: Dialect) -> list[str]:
    if isinstance(d.columns, list):
        return list(d.columns)
    if d.columns is False:
        return [str(k) for k in range(len(first))]
    return d.columns(first) if callable(d.columns) else first


def _scan(spark: SparkSession, path: str, d: Dialect) -> tuple[DataFrame, list[Key]]:
    """The lazy scan of a file or folder in dialect ``d``: string columns and order keys."""
    named = not isinstance(d.columns, list) and d.columns is not False
    if d.from_line > 1 and not d.multiline:
        header = _first_lines(spark, path, d.from_line, d)[d.from_line - 1 :]
        if not header:
            return spark.createDataFrame([], T.StructType([T.StructField(f"{HIDDEN}0", T.LongType())])), [Key(f"{HIDDEN}0")]
        names = _names(parse(header[0], replace(d, from_line=1, columns=False, to_record=1))[1][0], d)
        skipped = d.from_line - 1 + named
        lines, keys = _keyed(spark.read.option("encoding", d.encoding).text(path))
        kept = _without_first_lines(lines, skipped, len(_files(spark, path))).where(F.trim("value") != "")
        cells = F.from_csv(F.col("value"), ", ".join(f"{quote_name(n)} string" for n in names), {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in d.reader_options().items() if k in ("sep", "quote", "escape", "charToEscapeQuoteEscaping", "emptyValue", "mode")})
        return kept.select(cells.alias("c"), *[k.name for k in keys]).select("c.*", *[k.name for k in keys]), keys
    if d.from_line > 1:
        return _whole_files(spark, path, d, None)
    head = _first_record(spark, path, d)
    if not head:
        return spark.createDataFrame([], T.StructType([T.StructField(f"{HIDDEN}0", T.LongType())])), [Key(f"{HIDDEN}0")]
    names = _names(head, d)
    options = d.reader_options()
    if d.nulls:  # Spark's parser takes an empty text for NULL, so one in quotes comes as a text that no file holds
        options["emptyValue"] = uuid.uuid4().hex
    rows = spark.read.options(**options).option("header", named).schema(_strings(names)).csv(path)
    keyed, keys = _keyed(rows)
    if d.nulls:
        cells = [F.when(F.col(q) == options["emptyValue"], "").otherwise(F.col(q)).alias(n) for n, q in zip(names, map(quote_name, names), strict=True)]
        return keyed.select(*cells, *[k.name for k in keys]), keys
    return keyed.na.fill("", names), keys


def _whole_files(spark: SparkSession, path: str, d: Dialect, hook: Callable[[str], str] | None) -> tuple[DataFrame, list[Key]]:
    """Files parsed whole, one a task: for raw-text hooks, and for line windows over quoted line feeds."""
    ship(spark)
    files = spark.read.option("encoding", d.encoding).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("f"), "value")
    prepared = lambda text: hook(text.strip()) if hook else text
    listed = _files(spark, path)
    first = spark.read.option("encoding", d.encoding).text(listed[0], wholetext=True).collect() if listed else []
    names = parse(prepared(first[0]["value"]), replace(d, to_record=1, relax_column_count=True))[0] if first else []

    def rows(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        for batch in batches:
            for f, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = parse(prepared(text), d)[1]
                columns = [pa.array([r[k] if k < len(r) else None for r in own], pa.string()) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([f] * len(own), pa.string()), pa.array(range(len(own)), pa.int64())], names=[*names, f"{HIDDEN}0", f"{HIDDEN}1"])

    schema = T.StructType([*_strings(names).fields, T.StructField(f"{HIDDEN}0", T.StringType()), T.StructField(f"{HIDDEN}1", T.LongType())])
    return files.mapInArrow(rows, schema), [Key(f"{HIDDEN}0"), Key(f"{HIDDEN}1")]


def _preamble(spark: SparkSession, path: str, save: bool | int, d: Dialect) -> tuple[str, Dialect]:
    """The preamble's lines, as they are, and the dialect whose lines start after them."""
    n = max(0, d.from_line - 1) if save is True else int(save)
    if not n:
        return "", d
    lines = _first_lines(spark, path, n, d)
    text = "\n".join(lines) if any(x.strip() for x in lines) else ""
    return text, replace(d, from_line=max(d.from_line, n + 1))


def _checked(frame: Frame, allow_empty: bool, strict: bool) -> Frame:
    """Raises where cells are empty and may not be, or where records have unlike lengths (found by one pass)."""
    try:
        if not allow_empty and frame.columns:
            blank = F.lit(False)
            for f in frame.schema:
                if isinstance(f.dataType, T.StringType):
                    blank = blank | (F.coalesce(F.col(quote_name(f.name)), F.lit("")) == "")
            if frame._df.where(blank).limit(1).count():
                raise RowFrameError("empty values are not allowed")
        elif strict:
            frame._df.write.format("noop").mode("overwrite").save()
    except RowFrameError:
        raise
    except Exception as e:
        raise RowFrameError(f"inconsistent column count or malformed record: {str(e).splitlines()[0]}", e) from e
    return frame


def shaped(frame: Frame, header_map: HeaderMap | None, casts: CustomCasts | None, schema: SchemaConfig | None, allow_empty: bool = True, strict: bool = False, keep_unmapped: bool = False) -> Frame:
    """The row-shaping stages in their order: structure, header map, casts, validation."""
    if strict or not allow_empty:
        frame = _checked(frame, allow_empty, strict)
    if header_map:
        frame = map_rows(frame, header_map, keep_unmapped=keep_unmapped)
    if casts:
        frame = apply_casts(frame, casts)
    return validate(frame, schema) if schema else frame


def from_file(
    spark: SparkSession,
    path: str,
    dialect: Dialect | None = None,
    *,
    transform: Callable[[str], str] | None = None,
    header_map: HeaderMap | None = None,
    keep_unmapped: bool = False,
    casts: CustomCasts | None = None,
    schema: SchemaConfig | None = None,
    validate_data: bool = False,
    allow_empty_values: bool = True,
    save_additional_header: bool | int = False,
    additional_header_dialect: Dialect | None = None,
    retry: Retry | None = None,
) -> Frame:
    """A file or folder as a lazy frame; ``save_additional_header`` keeps the lines before the data as its preamble."""
    d = dialect or Dialect()

    def read() -> Frame:
        own, text = d, ""
        if save_additional_header:
            text, own = _preamble(spark, path, save_additional_header, replace(d, encoding=(additional_header_dialect or d).encoding))
        df, keys = _whole_files(spark, path, own, transform) if transform else _scan(spark, path, own)
        frame = Frame(df, keys, text)
        if own.to_record is not None and not transform:
            frame = frame.head(own.to_record)
        return shaped(frame, header_map, casts, schema, allow_empty_values, validate_data and not own.relax_column_count, keep_unmapped)

    if retry:
        return retry.run(read, f"reading {path}")
    try:
        return read()
    except RowFrameError:
        raise
    except Exception as e:
        raise RowFrameError(f"{path} cannot be read: {str(e).splitlines()[0] if str(e) else type(e).__name__}", e) from e


def from_string(spark: SparkSession, text: str, dialect: Dialect | None = None, *, header_map: HeaderMap | None = None, casts: CustomCasts | None = None, schema: SchemaConfig | None = None, save_additional_header: bool | int = False, keep_unmapped: bool = False) -> Frame:
    """A text as a frame; it is parsed on the driver, where it already is."""
    d, preamble = dialect or Dialect(), ""
    if save_additional_header:
        n = max(0, d.from_line - 1) if save_additional_header is True else int(save_additional_header)
        preamble, _ = cut_lines(text, n + 1)
        preamble, d = preamble.rstrip("\r\n") if preamble.strip() else "", replace(d, from_line=max(d.from_line, n + 1))
    names, rows = parse(text, d)
    frame = Frame.from_data(spark, [dict(zip(names, r, strict=True)) for r in rows], _strings(names)) if names else Frame.from_data(spark, [])
    return shaped(Frame(frame._df, frame._keys, preamble), header_map, casts, schema, keep_unmapped=keep_unmapped)


def from_stream(spark: SparkSession, stream: IO | Iterable[str | bytes], dialect: Dialect | None = None, **options: Any) -> Frame:
    """A file-like object or chunks of text, read to the end."""
    d = dialect or Dialect()
    whole = stream.read() if hasattr(stream, "read") else "".join(x.decode(d.encoding) if isinstance(x, bytes) else x for x in stream)
    return from_string(spark, whole.decode(d.encoding) if isinstance(whole, bytes) else whole, d, **options)


def rows_of(spark: SparkSession, path: str, dialect: Dialect | None = None, *, transform: Callable[[dict], Any] | None = None, header_map: HeaderMap | None = None) -> Iterator[Any]:
    """The rows of a file as dicts, in order, streamed partition by partition."""
    for row in from_file(spark, path, dialect, header_map=header_map):
        yield transform(row) if transform else row


def batches_of(spark: SparkSession, path: str, batch_size: int = 100, **options: Any) -> Iterator[list[Any]]:
    """rows_of() in lists of ``batch_size``; the last may be shorter."""
    batch: list[Any] = []
    for row in rows_of(spark, path, **options):
        batch.append(row)
        if len(batch) == batch_size:
            yield batch
            batch = []
    if batch:
        yield batch
