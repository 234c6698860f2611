"""Load the source tables from Parquet files or from the catalog."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import partial
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quotelens.sources.layout import range_column
from quotelens.sources.schemas import SCHEMAS, database_of


class LazyTables(Mapping[str, DataFrame]):
    """Tables by name, each opened when first asked for."""

    def __init__(self, openers: Mapping[str, Callable[[], DataFrame]]):
        self._openers = dict(openers)
        self._opened: dict[str, DataFrame] = {}
        self._locks = {name: Lock() for name in self._openers}

    def __getitem__(self, name: str) -> DataFrame:
        with self._locks[name]:
            if name not in self._opened:
                self._opened[name] = self._openers[name]()
            return self._opened[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._openers)

    def __len__(self) -> int:
        return len(self._openers)


_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_TEXT = (T.StringType, T.VarcharType, T.CharType)
_DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)
_NUMBERS = (*_WHOLE, T.DecimalType, T.FloatType, T.DoubleType)


def _allowed(field: T.StructField) -> tuple[type, ...]:
    """Types that may stand for the one of the schema."""
    if field.name == "id" or field.name.endswith("_id"):
        return (*_WHOLE, T.DecimalType, *_TEXT)
    if isinstance(field.dataType, T.StringType):
        return _TEXT
    if isinstance(field.dataType, (T.DateType, T.TimestampType)):
        return _DATES
    if isinstance(field.dataType, T.BooleanType):
        return (T.BooleanType,)
    return _NUMBERS


def load_tables(spark: SparkSession, root: str) -> LazyTables:
    """The 21 tables in Parquet under ``<root>/<database>/<table>``."""

    def read(name: str) -> DataFrame:
        return checked(name, spark.read.parquet(f"{root}/{database_of(name)}/{name}"))

    return LazyTables({name: partial(read, name) for name in SCHEMAS})


def tables_from_catalog(spark: SparkSession, catalog: str | None = None) -> LazyTables:
    """The 21 tables in the metastore as ``[catalog.]database.table``."""
    prefix = f"{catalog}." if catalog else ""

    def read(name: str) -> DataFrame:
        return checked(name, spark.table(f"{prefix}{database_of(name)}.{name}"))

    return LazyTables({name: partial(read, name) for name in SCHEMAS})


def checked(name: str, df: DataFrame) -> DataFrame:
    """Project to the columns that are read; fail early if one is missing or of a wrong type.

    Types are checked by family and left as found: ids may be whole numbers or
    text, money a decimal of any precision or a double. Columns that hold the range
    of a key, as :func:`quotelens.sources.layout.write_ranges` makes them, are kept.
    """
    missing = [c for c in SCHEMAS[name].names if c not in df.columns]
    if missing:
        raise ValueError(f"{name} has no column {', '.join(missing)}")
    wrong = [
        f"{field.name} is {found.simpleString()}"
        for field in SCHEMAS[name]
        if not isinstance(found := df.schema[field.name].dataType, _allowed(field))
    ]
    if wrong:
        raise ValueError(f"{name}: {', '.join(wrong)}")
    ranges = [found[0] for c in SCHEMAS[name].names if (found := range_column(df, c)) is not None]
    return df.select(*SCHEMAS[name].names, *ranges)
