"""Coverage limits and deductibles per quote."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelens.operators.joins import KeyFilter
from quotelens.operators.rollup import Measure, label_extremes, rollup_extremes
from quotelens.plans.quotes import Tables

# Coverage symbols and the limit each output column reads.
VEHICLE_MEASURES = (
    Measure("bi_limit_per_person", "bi", "per_person"),
    Measure("bi_limit_per_occurrence", "bi", "per_occurrence"),
    Measure("pd_limit_per_occurrence", "pd", "per_occurrence"),
    Measure("coll_deductible", "coll", "deductible"),
    Measure("comp_deductible", "comp", "deductible"),
    Measure("med_pay_limit_per_person", "med_pay", "per_person"),
    Measure("pip_limit_per_person", "pip", "per_person"),
    Measure("pip_limit_per_occurrence", "pip", "per_occurrence"),
    Measure("rental_limit_per_occurrence", "rental", "per_occurrence"),
    Measure("rental_limit_per_day", "rental", "per_day"),
)
QUOTE_MEASURES = (
    Measure("um_limit_per_person", "um", "per_person"),
    Measure("um_limit_per_occurrence", "um", "per_occurrence"),
    Measure("uim_limit_per_person", "uim", "per_person"),
    Measure("uim_limit_per_occurrence", "uim", "per_occurrence"),
    Measure("umuim_limit_per_person", "umuim", "per_person"),
    Measure("umuim_limit_per_occurrence", "umuim", "per_occurrence"),
    Measure("umpd_limit_per_occurrence", "umpd", "per_occurrence"),
    Measure("uimpd_limit_per_occurrence", "uimpd", "per_occurrence"),
)


def _labelled(t: Tables, bridge: DataFrame, measures: Sequence[Measure]) -> DataFrame:
    """Bridge rows with the limits of the coverages that some measure reads.

    The coverage table is left to Spark to broadcast by its size; past the
    threshold the join shuffles and its few, hot coverage ids are split.
    """
    limits = (
        t["coverages"]
        .filter(F.col("symbol").isin(*{m.label for m in measures}))
        .select(F.col("id").alias("coverage_id"), "symbol", *sorted({m.value for m in measures}))
    )
    return bridge.join(limits, "coverage_id").drop("coverage_id")


def vehicle_limits(
    t: Tables,
    stats: Sequence[str] = ("max",),
    keep: KeyFilter | None = None,
    vehicles: DataFrame | None = None,
) -> DataFrame:
    """Statistics of the vehicle-level limits, per quote that has any.

    ``vehicles``: the vehicle quotes, where they are written already.
    """
    given = t["vehicle_quotes"] if vehicles is None else vehicles
    bridge = t["coverages_vehicle_quotes"]
    if keep is not None:
        given = keep.apply(given, "quote_id")
    held = given.select(F.col("id").alias("vehicle_quote_id"), "quote_id")
    if keep is not None:
        held, below = keep.through(held, "vehicles")
        if "avg" in stats:
            bridge = below.apply(bridge, "vehicle_quote_id")
    if keep is not None and "avg" not in stats:
        # Rows go on without the vehicle, as extremes are those of all rows of a quote.
        of_quotes = below.joined(bridge, "vehicle_quote_id").select("quote_id", "coverage_id")
        return label_extremes(_labelled(t, of_quotes, VEHICLE_MEASURES), "quote_id", "symbol", VEHICLE_MEASURES, stats)
    rows = _labelled(t, bridge, VEHICLE_MEASURES)
    per_vehicle = label_extremes(rows, "vehicle_quote_id", "symbol", VEHICLE_MEASURES, stats)
    return rollup_extremes(
        per_vehicle.join(held, "vehicle_quote_id"), "quote_id", VEHICLE_MEASURES, stats
    )


def quote_limits(t: Tables, keep: KeyFilter | None = None) -> DataFrame:
    """Highest quote-level limits, per quote that has any."""
    bridge = t["coverages_quotes"]
    if keep is not None:
        bridge = keep.apply(bridge, "quote_id")
    rows = _labelled(t, bridge, QUOTE_MEASURES)
    limits = label_extremes(rows, "quote_id", "symbol", QUOTE_MEASURES)
    return limits.withColumnsRenamed({f"{m.name}_max": m.name for m in QUOTE_MEASURES})


def coverage_limits(t: Tables, stats: Sequence[str] = ("max",)) -> DataFrame:
    """Limits and deductibles of every quote, null where it has none.

    Vehicle-level columns are ``<limit>_<stat>`` for ``min``, ``avg``, ``max`` as
    asked; quote-level columns hold the maximum.
    """
    return (
        t["quotes"]
        .select(F.col("id").alias("quote_id"))
        .join(vehicle_limits(t, stats), "quote_id", "left")
        .join(quote_limits(t), "quote_id", "left")
    )
