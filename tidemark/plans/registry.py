"""Where queries and their SQL twins are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column

from ..sources.tables import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    """Register a function (spark, folder) -> DataFrame under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def projection(name: str, source: str, columns: Callable[[], dict[str, Column]], sql: str, where: Callable[[], Column] | None = None) -> None:
    """Register a query that computes columns of one table; they are made when the query runs, as a session is needed."""

    def run(spark, folder):
        df = table(spark, folder, source)
        return (df if where is None else df.where(where())).select(*[c.alias(n) for n, c in columns().items()])

    QUERIES[name], ORACLE[name] = run, sql
