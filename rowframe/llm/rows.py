"""Row-wise Arrow operators: every column of the input passes through, new columns are appended."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rowframe.ship import ship


def add_columns(df: DataFrame, added: str, compute: Callable[[pa.Table], list[pa.Array]], needs: list[str], keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` plus the columns of the DDL ``added``, computed by Arrow batch from the columns ``needs``.

    ``keep`` names the columns that pass (all by default): what is not asked for does not cross back into the JVM. A
    column of ``df`` whose name is among the added ones (in any case) gives way. Each batch is handled on its own, so
    memory is bounded by the batch and a lost task is simply run again.
    """
    ship(df.sparkSession)
    new = T._parse_datatype_string(added)
    taken = {f.name.lower() for f in new}
    passed = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    kept = df.select(*[df[f"`{c}`"] for c in passed], *[df[f"`{c}`"].alias(f"__in_{k}") for k, c in enumerate(needs)])
    fields = kept.schema.fields[: len(passed)]
    out = T.StructType([T.StructField(f.name, f.dataType, True) for f in [*fields, *new.fields]])
    arrow = to_arrow_schema(out)
    n = len(passed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.table([batch.column(n + k) for k in range(len(needs))], names=needs)
            columns = [batch.column(k) for k in range(n)] + list(compute(table))
            yield pa.RecordBatch.from_arrays([_as(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
        release()

    return kept.mapInArrow(run, out)


def set_aside(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns, and all of ``df``'s in one struct: names that an operator adds meet none of them."""
    return df.select(*[F.col(f"`{c}`") for c in columns], F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__own"))


def brought_back(df: DataFrame, names: Sequence[str], **changed: Column) -> DataFrame:
    """The columns ``names`` out of the struct of set_aside(), some of them changed."""
    return df.select(*[(changed[c] if c in changed else F.col("__own").getField(c)).alias(c) for c in names])


def release() -> None:
    """Gives back to the machine what a finished task has freed: idle workers stand beside the next stage's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _as(column: pa.Array, kind: pa.DataType) -> pa.Array:
    return column if column.type == kind else column.cast(kind)
