"""A small register of named queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortloom.sources.tables import table

Tables = Callable[[str], DataFrame]


class Register:
    """Queries by name; a query gets a function that reads a table by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def add(f: Callable[[Tables], DataFrame]):
            def run(spark: SparkSession, d: str) -> DataFrame:
                return f(lambda t: table(spark, d, t))

            run.__doc__ = f.__doc__
            self.queries[name] = run
            if sql:
                self.sql[name] = sql
            return f

        return add
