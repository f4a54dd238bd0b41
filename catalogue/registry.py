"""Collects the queries of a module together with their DuckDB text (none for rows-only queries)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from strictasof.session import tune


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, run: Callable, sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"query {name} is registered twice")
        self.queries[name] = lambda spark, folder: run(tune(spark, folder), folder)
        if sql is not None:
            self.oracles[name] = sql

    def query(self, name: str, sql: str | None = None):
        def register(run):
            self.add(name, run, sql)
            return run
        return register


def r6(value: str | Column, name: str | None = None, digits: int = 6) -> Column:
    """Rounding in the form the oracle texts use (see :func:`catalogue.oracle.rnd`)."""
    column = F.col(value) if isinstance(value, str) else value
    scale = 10 ** digits
    return (F.floor(column * scale + 0.5003) / F.lit(scale)).alias(name or value)
