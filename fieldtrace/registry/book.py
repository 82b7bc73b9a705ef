"""Collects queries: a name, a function (spark, sf_dir) -> DataFrame and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        if name in self.queries:
            raise ValueError(f"query {name} is registered twice")

        def add(fn: Query) -> Query:
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return add


BOOK = Book()


def r6(c) -> Column:
    """Six digits, without negative zero: sums and roots may differ in the last bits between engines."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def rounded(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def q6(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0::DOUBLE AS {name}"


def joined(c) -> Column:
    """Array of numbers as comma text, so that both engines print it alike."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(c.cast("array<string>"), ",")
