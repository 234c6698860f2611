"""Unions and constant columns."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_disjoint(*frames: DataFrame) -> DataFrame:
    """Union of inputs known to share no row: no shuffle."""
    return reduce(DataFrame.unionByName, frames)


def union_distinct(*frames: DataFrame) -> DataFrame:
    """Union with equal rows merged, nulls comparing equal."""
    return union_disjoint(*frames).distinct()


def with_constants(df: DataFrame, constants: Mapping[str, tuple]) -> DataFrame:
    """Add constant columns from ``{name: (value, type)}``; a null needs its type too."""
    return df.withColumns({n: _typed(v, t) for n, (v, t) in constants.items()})


def _typed(value, type_name: str) -> Column:
    return F.lit(value).cast(type_name)
