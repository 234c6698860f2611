"""Pick or number rows within a key.

Nulls sort as the largest value: last ascending, first descending. Spark's
default is the opposite, so every order here states its null placement.
Tie-breakers run in the same direction as the order column.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotelens.functions.exprs import ColumnLike, col
from quotelens.sources.staging import Staging

_RANK = "__rank"


def _ordering(columns: Sequence[ColumnLike], descending: bool) -> list[Column]:
    if descending:
        return [col(c).desc_nulls_first() for c in columns]
    return [col(c).asc_nulls_last() for c in columns]


def nth_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order_col: ColumnLike,
    n: int,
    descending: bool = True,
    tie_breakers: Sequence[ColumnLike] = (),
) -> DataFrame:
    """The ``n``-th row of each key; keys with fewer rows give none.

    The rank filter sits right on the window, so Spark keeps at most ``n`` rows
    per key in each map task before the shuffle: a key holding a large share of
    the rows sends ``n`` rows per task, not all of them.
    """
    order = _ordering([order_col, *tie_breakers], descending)
    ranked = df.withColumn(_RANK, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(_RANK) == n).drop(_RANK)


def latest_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order_col: ColumnLike,
    tie_breakers: Sequence[ColumnLike] = (),
) -> DataFrame:
    """Newest row of each key; a null in ``order_col`` counts as newest."""
    return nth_per_key(df, keys, order_col, 1, True, tie_breakers)


def first_by_rank(
    df: DataFrame,
    keys: Sequence[str],
    rank_col: ColumnLike,
    tie_breakers: Sequence[ColumnLike] = (),
) -> DataFrame:
    """Lowest-ranked row of each key; an unranked (null) row wins only alone."""
    return nth_per_key(df, keys, rank_col, 1, False, tie_breakers)


def sequence_index(
    df: DataFrame,
    keys: Sequence[str],
    order_col: ColumnLike,
    start: int = 0,
    out: str = "sequence_index",
    tie_breakers: Sequence[ColumnLike] = (),
    staging: Staging | None = None,
    one_task_bytes: int | None = None,
) -> DataFrame:
    """Number all rows of each key in ascending order, from ``start``.

    Numbering keeps every row, so a window over the keys alone would sort a hot key
    in one task. With ``staging`` rows are range-partitioned by key and order, so
    that a key spans as many partitions as it fills, and written with the number of
    theirs; writing keeps the numbers right when a task runs again. The window then
    runs over key and partition, and a key that goes on from an earlier partition
    adds the rows it has there. Of those there is one per partition at most, which
    bounds what is broadcast by the number of partitions. Every key, hot or not,
    takes this way. Only a table that Spark takes to be of ``one_task_bytes`` in all,
    by default what it gives to one task, has no key too large for a window, nor has
    one a way around it without a shared folder: these take the plain window.

    Rows equal in keys, order and tie-breakers are numbered in any order, and lie
    in one partition.
    """
    keys, order = list(keys), _ordering([order_col, *tie_breakers], False)
    if one_task_bytes is None:
        given = df.sparkSession._jsparkSession.sessionState().conf()
        one_task_bytes = given.getConfString("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64MB")
        one_task_bytes = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(one_task_bytes)
    if staging is None or not staging.enabled or planned_bytes(df) <= one_task_bytes:
        window = Window.partitionBy(*keys).orderBy(*order)
        return df.select(*df.columns, (F.row_number().over(window) + (start - 1)).cast("long").alias(out))
    part, edge, before, rows = free_names(df.columns, "part", "edge", "before", "rows")
    hidden = free_names(df.columns, *[f"of_{k}" for k in keys])
    by_key = [F.col(k) for k in keys]
    placed = staging.table(
        df.repartitionByRange(*by_key, *order).withColumn(part, F.spark_partition_id()), "placed_rows"
    )

    def same_key(left: DataFrame, right: DataFrame) -> Column:
        pairs = [left[k].eqNullSafe(right[h]) for k, h in zip(keys, hidden)]
        return reduce(lambda a, b: a & b, pairs)

    renamed = [F.col(k).alias(h) for k, h in zip(keys, hidden)]
    # A key in several partitions is the lowest or the highest of each of them.
    key = F.struct(*renamed)
    ends = placed.groupBy(part).agg(F.min(key).alias("lowest"), F.max(key).alias("highest"))
    spread = (
        ends.select(part, F.explode(F.array_distinct(F.array("lowest", "highest"))).alias(edge))
        .groupBy(edge)
        .agg(F.count(F.lit(1)).alias(rows))
        .filter(F.col(rows) > 1)
        .select(f"{edge}.*")
    )
    runs = (
        placed.select(part, *keys)
        .join(F.broadcast(spread), same_key(placed, spread), "left_semi")
        .groupBy(*renamed, F.col(part).alias(edge))
        .agg(F.count(F.lit(1)).alias(rows))
    )
    earlier = Window.partitionBy(*hidden).orderBy(edge).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*hidden, edge, F.sum(rows).over(earlier).alias(before)).filter(F.col(before).isNotNull())
    window = Window.partitionBy(*keys, part).orderBy(*order)
    on = same_key(placed, runs) & (placed[part] == runs[edge])
    index = F.row_number().over(window) + F.coalesce(before, F.lit(0)) + (start - 1)
    return placed.join(F.broadcast(runs), on, "left").select(
        *[placed[c] for c in df.columns], index.cast("long").alias(out)
    )


def planned_bytes(df: DataFrame) -> int:
    """The size that Spark plans with: that of the files, less the columns not read."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def free_names(taken: Sequence[str], *names: str) -> list[str]:
    """``names``, each with as many underscores before it as make it new."""
    used = {c.lower() for c in taken}
    found = []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        found.append(name)
    return found
