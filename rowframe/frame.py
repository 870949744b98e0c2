"""The table class with all operators, sources and sinks."""

from __future__ import annotations

from typing import Any

from rowframe.operators.ordering import OrderOperators


class Frame(OrderOperators):
    """An immutable, ordered table of records; every operator returns a new one and is a plan until an action runs."""

    @classmethod
    def from_file(cls, spark, path: str, dialect=None, **options: Any) -> Frame:
        from rowframe.sources import reader

        return reader.from_file(spark, path, dialect, **options)

    @classmethod
    def from_string(cls, spark, text: str, dialect=None, **options: Any) -> Frame:
        from rowframe.sources import reader

        return reader.from_string(spark, text, dialect, **options)

    @classmethod
    def from_stream(cls, spark, stream, dialect=None, **options: Any) -> Frame:
        from rowframe.sources import reader

        return reader.from_stream(spark, stream, dialect, **options)

    def validate(self, config) -> Frame:
        from rowframe.plans.validate import validate

        return validate(self, config)

    def to_string(self, **options: Any) -> str:
        from rowframe.sources.writer import to_string

        return to_string(self, **options)

    def write_file(self, path: str, **options: Any) -> str:
        from rowframe.sources.writer import write_file

        return write_file(self, path, **options)
