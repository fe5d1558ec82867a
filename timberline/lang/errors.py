"""Errors of the query language, with the offset they were found at."""

from __future__ import annotations


class QueryError(ValueError):
    """What is wrong with a query, and where."""

    def __init__(self, message: str, position: int = 0) -> None:
        super().__init__(f"{message} (at {position})")
        self.message, self.position = message, position
