"""The operators as functions over a frame, a DataFrame or row dicts."""

from __future__ import annotations

import copy
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from rowframe.frame import Frame
from rowframe.plans import headermap
from rowframe.plans.validate import SchemaConfig
from rowframe.plans.validate import validate as _validate
from rowframe.sources.writer import to_string as _to_string

Data = Any


def frame_of(data: Data) -> Frame:
    """A frame as it is, a DataFrame without a stated order, or row dicts in theirs (in the active session)."""
    if isinstance(data, Frame):
        return data
    if isinstance(data, DataFrame):
        return Frame.from_df(data)
    return Frame.from_data(SparkSession.active(), data)


def _function(name: str) -> Callable:
    method = getattr(Frame, name)

    def call(data: Data, *args: Any, **kwargs: Any) -> Any:
        return getattr(frame_of(data), name)(*args, **kwargs)

    call.__name__ = name
    call.__doc__ = method.__doc__
    return call


add_column = _function("add_column")
remove_column = _function("remove_column")
rename_column = _function("rename_column")
reorder_columns = _function("reorder_columns")
cast_column_type = _function("cast_column_type")
deduplicate = _function("deduplicate")
split = _function("split")
unpivot = _function("unpivot")
fill_missing_values = _function("fill_missing_values")
normalize_text = _function("normalize_text")
trim_whitespace = _function("trim_whitespace")
find_row = _function("find_row")
find_row_by_regex = _function("find_row_by_regex")
find_rows = _function("find_rows")
find_row_where = _function("find_row_where")
find_rows_where = _function("find_rows_where")
find_similar_rows = _function("find_similar_rows")
find_most_similar_row = _function("find_most_similar_row")
group_by = _function("group_by")
group_by_field = _function("group_by_field")
update = _function("update")
update_where = _function("update_where")
update_column = _function("update_column")
transform = _function("transform")
remove_where = _function("remove_where")
append = _function("append")
sort_by = _function("sort_by")
sort_by_async = _function("sort_by_async")
aggregate = _function("aggregate")
distinct = _function("distinct")
pivot = _function("pivot")
sample = _function("sample")
head = _function("head")
take = _function("take")
tail = _function("tail")
get_base_row = _function("base_row")
create_row = _function("create_row")
map_data = _function("map")
filter_data = _function("find_rows_where")
reduce_data = _function("reduce")
count = _function("count")
for_each = _function("for_each")
for_each_async = _function("for_each_async")
merge_sorted = _function("merge_sorted")
map_async = _function("map_async")
reduce_async = _function("reduce_parallel")


def join(data: Data, other: Data, on: Mapping[str, str], select: Callable | None = None) -> Frame:
    """``on``: left and right column, and ``type`` (inner by default)."""
    return frame_of(data).join(frame_of(other), on["left"], on["right"], on.get("type", "inner"), select)


def merge(data: Data, other: Data, on: Any, merge: Callable | None = None) -> Frame:
    """The one-to-one merge."""
    return frame_of(data).merge_with(frame_of(other), on, merge)


def validate(data: Data, config: SchemaConfig) -> Frame:
    """Validation by the config's mode."""
    return _validate(frame_of(data), config)


def to_string(data: Data, **options: Any) -> str:
    """Delimited text with a header."""
    return _to_string(frame_of(data), **options)


def clone(value: Any) -> Any:
    """A deep copy of a driver-side value."""
    return copy.deepcopy(value)


class array_transformations:
    """Mapping between arrays and objects, and grouping by a nested field."""

    array_to_objects = staticmethod(lambda spark, rows, header_map, header=None, merge=None: headermap.rows_to_objects(Frame, spark, rows, header_map, header, merge))
    objects_to_array = staticmethod(headermap.objects_to_rows)
    group_by_field = staticmethod(group_by_field)
