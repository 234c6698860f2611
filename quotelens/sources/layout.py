"""Tables in folders by ranges of a key, so that a read opens the ranges it needs only.

The folder column is named ``<key>_by_<width>`` and holds ``floor(key / width)``: the
name alone says what it means, so nothing has to be told again on reading.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAME = re.compile(r"(.+)_by_([1-9][0-9]*)")


def range_column(df: DataFrame, key: str) -> tuple[str, int] | None:
    """The range column of ``key`` that ``df`` has, with its width."""
    for name in df.columns:
        found = NAME.fullmatch(name)
        if found and found[1] == key:
            return name, int(found[2])
    return None


def write_ranges(df: DataFrame, path: str, key: str, width: int) -> None:
    """Write ``df`` with a folder for each range of ``width`` values of ``key``, sorted by it.

    ``key`` is a whole number that grows with time, as table ids do, so that rows asked
    for together lie together. Rows are range-partitioned by key and row, so each task
    writes to the few folders that its keys span, and a key that many rows have is
    written by as many tasks as they fill. Null keys have a folder of their own, which
    no read for keys opens. A range column of ``key`` that is there already is refused.
    """
    if width < 1:
        raise ValueError(f"a range of {width} values holds nothing")
    if (there := range_column(df, key)) is not None:
        raise ValueError(f"there is a range column {there[0]} already")
    part = f"{key}_by_{width}"
    # ``div`` is exact for any id, and rounds towards zero where ranges go down.
    ranges = F.expr(f"(`{key}` - pmod(`{key}`, {width}L)) div {width}L")
    (
        df.repartitionByRange(F.col(key), F.xxhash64(*df.columns))
        .withColumn(part, ranges.cast("long"))
        .sortWithinPartitions(part, key)
        .write.partitionBy(part)
        .parquet(path)
    )


def within_ranges(df: DataFrame, key: str, least: object, greatest: object) -> DataFrame:
    """Rows of ``df`` with keys from ``least`` to ``greatest``, read from their folders only.

    No such row is lost, as a row's folder follows from its key. The range column
    goes; a frame without one is filtered by its key alone.
    """
    held = df.filter(F.col(key).between(least, greatest))
    found = range_column(df, key)
    if found is None or not isinstance(df.schema[key].dataType, T.IntegralType):
        return held
    name, width = found
    return held.filter(F.col(name).between(int(least) // width, int(greatest) // width)).drop(name)
