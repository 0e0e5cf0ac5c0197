"""All queries of the engine with their DuckDB counterparts."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keelson.session import ship

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under ``name``, with DuckDB SQL that returns the same rows."""

    def register(function: Query) -> Query:
        @functools.wraps(function)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)  # some queries have functions in Python
            return function(spark, sf_dir)

        _QUERIES[name] = run
        if oracle:
            _ORACLES[name] = oracle
        return run

    return register


def _load() -> None:
    from keelson import catalog  # noqa: F401


def queries() -> dict[str, Query]:
    """Name to query."""
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL."""
    _load()
    return _ORACLES
