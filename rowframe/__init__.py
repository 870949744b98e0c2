"""rowframe: a DataFrame-native engine for delimited files and record-shaped data."""

from rowframe.errors import RowFrameError
from rowframe.frame import Frame
from rowframe.operators.base import Columns, PyFn, python
from rowframe.plans.casting import Caster, CustomCasts, python_caster
from rowframe.plans.headermap import FromArray, ToArray, invert, map_rows, unmap_rows
from rowframe.plans.validate import Check, Field, RowSchema, SchemaConfig, validate
from rowframe.sources.dialect import Dialect, Retry, dialect, is_valid_csv
from rowframe.sources.reader import batches_of, from_file, from_stream, from_string, rows_of
from rowframe.sources.writer import to_string, write_file, write_folder, write_rows
from rowframe.streaming.pipeline import Pipeline

__all__ = [
    "Caster", "Check", "Columns", "CustomCasts", "Dialect", "Field", "Frame", "FromArray", "Pipeline", "PyFn", "Retry", "RowFrameError", "RowSchema", "SchemaConfig", "ToArray",
    "batches_of", "dialect", "from_file", "from_stream", "from_string", "invert", "is_valid_csv", "map_rows", "python", "python_caster", "rows_of", "to_string", "unmap_rows", "validate", "write_file", "write_folder", "write_rows",
]
