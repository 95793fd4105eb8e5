"""Named queries over the given tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scorelake.session import use_utc

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, **types: str) -> Callable[[Query], Query]:
    """Registers a query; ``types`` are SQL column types to cast to, where they differ."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(use_utc(spark), sf_dir)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql:
            casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in types.items())
            ORACLES[name] = f"SELECT * REPLACE ({casts}) FROM ({sql})" if casts else sql
        return fn

    return register
