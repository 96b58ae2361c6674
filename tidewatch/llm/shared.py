"""Helpers that every operator of this subpackage uses: shared tables, ASCII lower case, block ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.storage import dropped, new_path, stored  # noqa: F401  the operators take them from here

KEY = "_tidewatch_row"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def unused(docs: DataFrame, name: str) -> str:
    """name, or name with so many underscores added that docs has no such column, in either case of letters."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for every row, stored, so that it names the same row in every later scan; and the
    number's column, which is none of docs."""
    key = unused(docs, KEY)
    return stored(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


HOT_SHARE = 200


def joined(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with groups (one row of each key, with the number of its rows as size).

    Keys with more than total / HOT_SHARE rows, which are HOT_SHARE at most, are sent to the rows;
    all other keys meet by shuffle, so no task gets a large group whole. how: inner or left.
    """
    most = total // HOT_SHARE
    hot = groups.where(F.col(size) > most).limit(HOT_SHARE + 1).collect()
    if not hot:
        return rows.join(groups, keys, how)
    if len(hot) > HOT_SHARE:
        raise ValueError("sizes of groups pass the number of rows")
    few = F.broadcast(rows.sparkSession.createDataFrame(hot, groups.schema))
    names = few.select(*keys)
    first = rows.join(few, keys)
    return first.unionByName(rows.join(names, keys, "left_anti").join(groups.where(F.col(size) <= most), keys, how))


def trimmed() -> None:
    """Give a worker's freed memory back, so that idle workers stay small beside the next stage."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
