"""All queries of the analytics engine: name -> callable, name -> DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch import catalog
from tidewatch.operators import MODULES
from tidewatch.tables import Tables

assert MODULES


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.OPERATORS["agg_04"](Tables(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {key: catalog.bound(key) for key in catalog.OPERATORS}


def oracle_sql() -> dict[str, str]:
    return dict(catalog.SQL)
