"""Errors of the query language; each has the code of its kind."""

from __future__ import annotations


class QueryError(ValueError):
    def __init__(self, code: str, message: str, at: int | None = None):
        super().__init__(f"{code}: {message}" + (f" (at {at})" if at is not None else ""))
        self.code, self.at = code, at
