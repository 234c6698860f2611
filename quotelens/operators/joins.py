"""Existence splits and key filters."""

from __future__ import annotations

from collections.abc import Sequence
from threading import Lock

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotelens.operators.ranking import free_names
from quotelens.session import fit_filters
from quotelens.sources.layout import within_ranges
from quotelens.sources.staging import Staging


def key_set(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Distinct non-null values of one column.

    The values are combined in each map task before the shuffle, so a value that
    fills a large share of the rows costs one row per task.
    """
    name = name or column
    return df.filter(F.col(column).isNotNull()).select(F.col(column).alias(name)).distinct()


def split_by_existence(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str
) -> tuple[DataFrame, DataFrame]:
    """Rows of ``left`` with, and without, a partner in ``right``.

    No row is multiplied by several partners; a null key has no partner.
    """
    present = key_set(right, right_key, "__present")
    on = left[left_key] == present["__present"]
    return left.join(present, on, "left_semi"), left.join(present, on, "left_anti")


def heavy_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys with more than a fair share of the rows, and the ``parts`` that each makes.

    ``df`` is one whose rows are written, as they are counted here. A fair share is the rows by the session's shuffle partitions, so there are fewer
    heavy keys than partitions: what joins broadcast of them is bounded by that.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("heavy")).agg(F.count(F.lit(1)).alias("rows"))
    fair = max(1, -(-df.count() // partitions))
    parts = F.ceil(F.col("rows") / fair).cast("int").alias("parts")
    return counts.filter(F.col("rows") > fair).select("heavy", parts)


def spread_join(
    left: DataFrame, right: DataFrame, key: str, heavy: DataFrame, how: str = "inner", *more: DataFrame
) -> DataFrame:
    """The join on ``key``, inner or left, the rows of heavy keys dealt over many tasks.

    What is joined to ``more`` frames after ``right`` is dealt, and shuffled, once for all.
    ``heavy`` is that of :func:`heavy_keys` for ``left``. A left row of a heavy key
    goes to one of the key's parts, by a hash of the row, so that a task that runs
    again sends it to the same; a right row goes to every part. Other keys have one
    part. Each pair of rows meets in one part, so the rows are those of a plain join.
    """
    part, parts, whose = free_names([c for df in (left, right, *more) for c in df.columns], "part", "parts", "heavy")
    named = heavy.select(F.col("heavy").alias(whose), F.col("parts").alias(parts))

    def with_parts(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(named), df[key] == F.col(whose), "left").drop(whose)

    dealt = with_parts(left).withColumn(part, F.pmod(F.hash(*left.columns), F.coalesce(parts, F.lit(1)))).drop(parts)
    for other in (right, *more):
        copied = with_parts(other).withColumn(part, F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1)))
        dealt = dealt.join(copied.drop(parts), [key, part], how)
    return dealt.drop(part)


def _ordered_alike(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> bool:
    """Whether a range of one key means the same of the other: text and numbers sort differently."""
    a, b = left.schema[left_key].dataType, right.schema[right_key].dataType
    return a == b or (isinstance(a, T.NumericType) and isinstance(b, T.NumericType))


class KeyFilter:
    """Cuts large tables down to the keys a driving table needs.

    The distinct keys are written once for all the tables that they cut, with their
    least and greatest. A table is first held to that range, which its Parquet
    statistics prune files and row groups by where ids grow with time, and then
    semi-joined to the keys, at any size and without a hint: Spark broadcasts the keys
    while they are few, and else puts a Bloom filter of them, whose size
    :func:`quotelens.session.fit_filters` fits to their number, over the scan of the
    large table, so that most rows without a partner are never shuffled.

    Where no folder is shared nothing is written, and the semi-join stands alone.
    ``name`` tells the tables written for this filter from those of others.
    """

    def __init__(self, driving: DataFrame, staging: Staging | None, name: str = "driving"):
        self._driving = driving
        self._staging = staging
        self._name = name
        self._wanted: dict[tuple[str, ...], tuple[DataFrame, dict | None]] = {}
        self._locks: dict[tuple[str, ...], Lock] = {}
        self._lock = Lock()

    def _keys(self, columns: tuple[str, ...]) -> tuple[DataFrame, dict | None]:
        """The distinct keys of some driving columns, and their range where they are written."""
        with self._lock:
            lock = self._locks.setdefault(columns, Lock())
        # Tables that ask for the same keys wait for them; other keys are written meanwhile.
        with lock:
            if columns not in self._wanted:
                self._wanted[columns] = self._write(columns)
            return self._wanted[columns]

    def _write(self, columns: tuple[str, ...]) -> tuple[DataFrame, dict | None]:
        every = F.col(columns[0]) if len(columns) == 1 else F.explode(F.array(*columns))
        wanted = key_set(self._driving.select(every.alias("__wanted")), "__wanted")
        if self._staging is None or not self._staging.enabled:
            return wanted, None
        name = "-".join(["keys", self._name, *columns])
        ends = [F.min("__wanted").alias("least"), F.max("__wanted").alias("greatest"), F.count("__wanted").alias("keys")]
        seen = Observation()
        staged = self._staging.table(wanted.observe(seen, *ends), name)
        # Keys that an earlier run wrote were not seen in this one.
        found = staged.agg(*ends).first().asDict() if name in self._staging.resumed else seen.get
        fit_filters(staged.sparkSession, found["keys"], at_least=True)
        return staged, found

    def apply(self, df: DataFrame, key: str, driving_cols: Sequence[str] = ()) -> DataFrame:
        """Rows of ``df`` whose ``key`` is in some driving column (its namesake by default).

        Null keys have no partner. A table that :func:`quotelens.sources.layout.write_ranges`
        wrote by ranges of ``key`` is read from the folders of wanted ranges only.
        """
        wanted, ends = self._keys(tuple(driving_cols or [key]))
        if ends is not None and ends["least"] is not None and _ordered_alike(df, key, wanted, "__wanted"):
            # On both sides: Spark makes Bloom filters of keys that a predicate chose.
            wanted = wanted.filter(F.col("__wanted").between(ends["least"], ends["greatest"]))
            df = within_ranges(df, key, ends["least"], ends["greatest"])
        return df.join(wanted, df[key] == wanted["__wanted"], "left_semi")

    def joined(self, df: DataFrame, key: str) -> DataFrame:
        """``df`` joined, inner, to the rows of the driving table, whose rows are written, on their common ``key``.

        For what would be cut and then joined to the same rows: it is shuffled once, and
        where ``df`` is a union Spark would put the cut into each of its parts.
        """
        least, greatest, keys = self._driving.agg(F.min(key), F.max(key), F.count(key)).first()
        fit_filters(df.sparkSession, keys, at_least=True)
        driving = self._driving
        if least is not None and _ordered_alike(df, key, driving, key):
            driving = driving.filter(F.col(key).between(least, greatest))
            df = within_ranges(df, key, least, greatest)
        return df.join(driving, key)

    def below(self, df: DataFrame, name: str) -> KeyFilter:
        """The filter that ``df``, whose rows are written already, makes for tables one level below."""
        return KeyFilter(df, self._staging, name)

    def through(self, df: DataFrame, name: str) -> tuple[DataFrame, KeyFilter]:
        """``df``, already cut, and the filter it makes for tables one level below.

        It is staged, since its keys are read before it is joined.
        """
        staged = self._staging.table(df, name)
        return staged, KeyFilter(staged, self._staging, name)
