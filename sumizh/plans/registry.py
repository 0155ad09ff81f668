"""Registry of named queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, and for those that SQL can say as well, the SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(function: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"there are two queries {name}")
            self.queries[name] = function
            if sql:
                self.sql[name] = sql
            return function

        return keep


registry = Registry()
