"""Collects the queries; importing the query modules fills it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelens.session import configure
from quotelens.sources.staging import Staging, own_folder
from quotelens.sources.tables import LazyTables

TABLE_NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
MODULES = ("quotelens.queries.operators", "quotelens.queries.mart")

Given = LazyTables
_queries: dict[str, Callable[[Given], DataFrame]] = {}
_oracles: dict[str, str] = {}


def query(name: str, sql: str):
    """Register a function of the given tables under ``name`` with its SQL."""

    def add(build: Callable[[Given], DataFrame]):
        _queries[name] = build
        _oracles[name] = sql
        return build

    return add


def read_given(spark: SparkSession, sf_dir: str) -> Given:
    return LazyTables(
        {t: partial(spark.read.parquet, f"{sf_dir}/{t}.parquet") for t in TABLE_NAMES}
    )


def working(spark: SparkSession) -> Staging:
    """Staging for a query, in a folder of its own where a local session has none.

    Its tables go when the JVM ends: the caller reads the result after the query returns.
    """
    own_folder(spark)
    return Staging(spark)


def plain(df: DataFrame) -> DataFrame:
    """Dates and timestamps as text, so that any client compares them alike."""
    texts = [name for name, kind in df.dtypes if kind.startswith(("date", "timestamp"))]
    return df.withColumns({c: F.col(c).cast("string") for c in texts}) if texts else df


def _runner(build: Callable[[Given], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(build(read_given(configure(spark), sf_dir)))

    return run


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    for module in MODULES:
        import_module(module)
    return {name: _runner(build) for name, build in _queries.items()}


def all_oracles() -> dict[str, str]:
    for module in MODULES:
        import_module(module)
    return dict(_oracles)
