"""Whether ids that tables are looked up by are unique, checked as the tables are read."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from threading import Lock

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from quotelens.operators.ranking import free_names

#: Tables that are joined by their ``id``: a repeated one would multiply rows.
LOOKUPS = (
    "profile_rating_data",
    "profiles",
    "rating_requests",
    "policy_term_revisions",
    "policy_terms",
    "rates",
    "rerates",
    "rerate_rates",
)


class Contracts(Mapping[str, DataFrame]):
    """Tables whose ids are checked in the pass that reads them.

    ::

        contracts = Contracts(tables, repeated="report")
        build_mart(contracts, params, staging).write.parquet(...)
        contracts.report()

    Where such a table is first read, its rows are numbered within their id, on the
    partitioning and order that the join by id needs anyway, so no table is read a
    second time; the count is exact. Rows without an id, which no lookup finds, are
    left out there. ``repeated="raise"`` fails the job at the first repeated id;
    ``"report"`` leaves the rows as they are and counts them.
    """

    def __init__(self, tables: Mapping[str, DataFrame], repeated: str = "raise", lookups=LOOKUPS, key: str = "id"):
        if repeated not in ("raise", "report"):
            raise ValueError("repeated is 'raise' or 'report'")
        self._tables = tables
        self._repeated = repeated
        self._lookups = tuple(lookups)
        self._key = key
        self._seen: dict[str, Observation] = {}
        self._lock = Lock()

    def __getitem__(self, name: str) -> DataFrame:
        df = self._tables[name]
        with self._lock:
            if name not in self._lookups or name in self._seen:
                return df
            self._seen[name] = Observation(f"ids of {name}")
        return self._checked(df, name)

    def __iter__(self) -> Iterator[str]:
        return iter(self._tables)

    def __len__(self) -> int:
        return len(self._tables)

    def _checked(self, df: DataFrame, name: str) -> DataFrame:
        (place,) = free_names(df.columns, "place")
        key = F.col(self._key)
        numbered = df.filter(key.isNotNull()).withColumn(
            place, F.row_number().over(Window.partitionBy(key).orderBy(key))
        )
        again = F.col(place) > 1
        seen = numbered.observe(
            self._seen[name], F.count(F.lit(1)).alias("rows"), F.count_if(again).alias("repeats")
        )
        if self._repeated == "raise":
            told = F.concat(F.lit(f"{name}.{self._key} is not unique: "), key.cast("string"))
            seen = seen.filter(F.when(again, F.raise_error(told).cast("boolean")).otherwise(True))
        return seen.drop(place)

    def report(self) -> dict[str, dict[str, int]]:
        """Rows and repeats by table, of those that a finished job has read."""
        return {name: dict(o.get) for name, o in self._seen.items() if o._jo.future().isCompleted()}
