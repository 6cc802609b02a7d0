"""Pairs of a DataFrame query and the SQL statement with the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .sqltext import Fragments

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.fragments = Fragments()
        self.queries: dict[str, Query] = {}
        self._sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        def register(fn: Query) -> Query:
            self.queries[fn.__name__] = fn
            if sql is not None:
                self._sql[fn.__name__] = sql
            return fn

        return register

    def sql(self) -> dict[str, str]:
        return {name: self.fragments.statement(text) for name, text in self._sql.items()}
