"""Column functions: dynamic-value coercions and text functions, all inside the JVM."""

from rowframe.functions.coerce import (
    collation_key,
    dyn_bool,
    dyn_date,
    dyn_number,
    dyn_string,
    dyn_trim,
)
from rowframe.functions.text import capitalize_words, edit_distance, get_path, normalize, set_path, to_json_text

__all__ = ["capitalize_words", "collation_key", "dyn_bool", "dyn_date", "dyn_number", "dyn_string", "dyn_trim", "edit_distance", "get_path", "normalize", "set_path", "to_json_text"]
