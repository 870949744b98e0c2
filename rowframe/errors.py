"""The library's error type."""

from __future__ import annotations


class RowFrameError(Exception):
    """An error of reading, mapping, validating or writing; ``cause`` is the error beneath it, if any."""

    def __init__(self, message: str, cause: BaseException | None = None):
        super().__init__(message)
        self.cause = cause
        self.__cause__ = cause
