"""Totals of children per parent, and per-label extremes in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType

from quotelens.functions.exprs import ColumnLike, col, guarded_ratio

STATS = ("min", "avg", "max")


class Measure(NamedTuple):
    """One value column of the rows carrying one label."""

    name: str
    label: str
    value: str


def shared_scale(*kinds: DataType) -> int | None:
    """Decimal places shared by amounts that whole numbers can stand for, else None.

    Spark adds decimals of more than eight digits as objects. As whole numbers of
    the last digit they are added in place, several times faster, and shuffle at
    half the size.
    """
    scales = {k.scale if isinstance(k, DecimalType) and k.precision <= 15 else None for k in kinds}
    return scales.pop() if len(scales) == 1 else None


def to_units(amount: ColumnLike, scale: int | None) -> Column:
    """A decimal as a whole number of its last digit; unchanged without a scale.

    Up to 15 digits the way over a double is exact: its error stays below half a
    unit.
    """
    if scale is None:
        return col(amount)
    return F.rint(col(amount).cast("double") * F.lit(10.0**scale)).cast("long")


def from_units(amount: ColumnLike, scale: int | None) -> Column:
    """A sum of :func:`to_units` values as a double, the one nearest to the exact sum."""
    number = col(amount).cast("double")
    return number if scale is None else number / F.lit(10.0**scale)


def child_totals(
    parents: DataFrame,
    parent_key: str,
    children: DataFrame,
    child_key: str,
    sums: Sequence[str],
    counts: Mapping[str, str] | None = None,
) -> DataFrame:
    """Each parent with the sums of its children's columns.

    Children are summed before the join, so every parent meets one row. A parent
    without children keeps null sums and gets 0 for each non-null count, given
    as ``{child column: output column}``.
    """
    counts = dict(counts or {})
    totals = children.groupBy(F.col(child_key).alias("__child_key")).agg(
        *[F.sum(c).alias(c) for c in sums],
        *[F.count(c).alias(out) for c, out in counts.items()],
    )
    joined = parents.join(totals, parents[parent_key] == totals["__child_key"], "left")
    zero_filled = [F.coalesce(out, F.lit(0)).alias(out) for out in counts.values()]
    return joined.select(*parents.columns, *sums, *zero_filled)


def label_extremes(
    df: DataFrame,
    key: str,
    label_col: str,
    measures: Sequence[Measure],
    stats: Sequence[str] = ("max",),
) -> DataFrame:
    """One row per key with ``<measure>_<stat>`` columns, in a single aggregation.

    For ``avg`` it leaves the parts (sum, non-null count, rows per label) that
    :func:`rollup_extremes` needs one level up.
    """
    aggregates = []
    for m in measures:
        value = F.when(F.col(label_col) == m.label, F.col(m.value))
        if "min" in stats:
            aggregates.append(F.min(value).alias(f"{m.name}_min"))
        if "max" in stats:
            aggregates.append(F.max(value).alias(f"{m.name}_max"))
        if "avg" in stats:
            aggregates.append(F.sum(value).cast("double").alias(f"{m.name}_sum"))
            aggregates.append(F.count(value).cast("double").alias(f"{m.name}_cnt"))
    if "avg" in stats:
        for label in _labels(measures):
            rows = F.count_if(F.col(label_col) == label).cast("double")
            aggregates.append(rows.alias(f"{label}_rows"))
    return df.groupBy(key).agg(*aggregates)


def rollup_extremes(
    df: DataFrame,
    key: str,
    measures: Sequence[Measure],
    stats: Sequence[str] = ("max",),
) -> DataFrame:
    """Merge :func:`label_extremes` rows of several children under one parent.

    The average is that of one join per label put side by side, in which a value
    is repeated once for every combination of the child's rows under the other
    labels. The repeat count is the product of those row counts, so no such
    combination is ever built.
    """
    labels = _labels(measures)

    def repeats(label: str) -> Column:
        others = [F.greatest(F.lit(1.0), F.col(f"{o}_rows")) for o in labels if o != label]
        return reduce(lambda a, b: a * b, others, F.lit(1.0))

    aggregates = []
    for m in measures:
        if "min" in stats:
            aggregates.append(F.min(f"{m.name}_min").alias(f"{m.name}_min"))
        if "avg" in stats:
            weighted = F.sum(repeats(m.label) * F.col(f"{m.name}_sum"))
            weight = F.sum(repeats(m.label) * F.col(f"{m.name}_cnt"))
            aggregates.append(guarded_ratio(weighted, weight).alias(f"{m.name}_avg"))
        if "max" in stats:
            aggregates.append(F.max(f"{m.name}_max").alias(f"{m.name}_max"))
    return df.groupBy(key).agg(*aggregates)


def _labels(measures: Sequence[Measure]) -> list[str]:
    return list(dict.fromkeys(m.label for m in measures))
