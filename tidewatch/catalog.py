"""The catalogue of operators: an id, a function of Tables, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.tables import NOW, Tables, ctes

OPERATORS: dict[str, Callable[[Tables], DataFrame]] = {}
SQL: dict[str, str] = {}


def _seconds(sql: str) -> str:
    """sec(x), however x nests, as whole seconds."""
    while found := re.search(r"\bsec\(", sql):
        depth, end = 1, found.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[: found.start()]}CAST(floor(epoch({sql[found.end() : end - 1]})) AS BIGINT){sql[end:]}"
    return sql


def operator(key: str, sql: str | None = None):
    """Register a function of Tables as operator key. In sql, :now is the time of evaluation,
    sec(x) whole seconds since 1970 of a timestamp; texts in other engines' names stay as they are."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if key in OPERATORS:
            raise ValueError(f"{key} is registered twice")
        OPERATORS[key] = f
        if sql is not None:
            SQL[key] = ctes(_seconds(sql.replace(":now", NOW)))
        return f

    return add


def bound(key: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return OPERATORS[key](Tables(spark, sf_dir))

    run.__name__ = key
    return run
