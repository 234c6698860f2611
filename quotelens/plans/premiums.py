"""Quoted, hypothetical and re-rated premiums per quote."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens.operators.joins import KeyFilter, key_set
from quotelens.operators.ranking import latest_per_key, nth_per_key
from quotelens.operators.rollup import child_totals, from_units, shared_scale, to_units
from quotelens.plans.params import MartParams
from quotelens.plans.quotes import Tables
from quotelens.sources.schemas import VEHICLE_COVERAGES

PAYMENT_PLANS = ("paid_in_full", "monthly")
HYPOTHETICAL_COVERAGES = ("coll", "comp")
OPTION_PREMIUMS = {
    "monthly": "all_full_coverage_premium_dollars",
    "paid_in_full": "all_full_coverage_premium_dollars_with_paid_in_full_discount",
}


def premium(plan: str, coverage: str) -> str:
    return f"{plan}_{coverage}_premium_in_dollars"


def _vehicle_premiums(plan: str) -> list[str]:
    return [premium(plan, c) for c in VEHICLE_COVERAGES]


def _scale(df: DataFrame, columns: Sequence[str], other: DataFrame | None = None) -> int | None:
    """Scale of amounts of one table, and of the umuim premiums of another."""
    kinds = [df.schema[c].dataType for c in columns]
    if other is not None:
        kinds += [f.dataType for f in other.schema if "_umuim_" in f.name]
    return shared_scale(*kinds)


def _in_units(df: DataFrame, columns: Sequence[str], scale: int | None) -> DataFrame:
    return df.withColumns({c: to_units(c, scale) for c in columns})


def _with_total(plan: str, scale: int | None, suffix: str = "") -> list[Column]:
    """The plan's premiums and their total as doubles, added while still exact.

    One missing part makes the total null.
    """
    parts = [*_vehicle_premiums(plan), premium(plan, "umuim")]
    total = reduce(lambda a, b: a + b, [F.col(c) for c in parts])
    return [from_units(c, scale).alias(c + suffix) for c in parts] + [
        from_units(total, scale).alias(premium(plan, "total") + suffix)
    ]


def premium_totals(
    t: Tables,
    keep: KeyFilter | None = None,
    keep_cols: Sequence[str] = (),
    vehicles: DataFrame | None = None,
) -> DataFrame:
    """Premium per coverage under both payment plans, and the vehicle count, per quote.

    ``vehicles``: the vehicle quotes, where they are cut already.
    """
    umuim = [premium(plan, "umuim") for plan in PAYMENT_PLANS]
    quotes = t["quotes"]
    if keep is not None:
        quotes = keep.apply(quotes, "id", keep_cols or ["quote_id"])
    quotes = quotes.select(F.col("id").alias("quote_id"), *umuim)
    if vehicles is None:
        vehicles = t["vehicle_quotes"]
        if keep is not None:
            vehicles = keep.apply(vehicles, "quote_id", keep_cols)
    sums = [c for plan in PAYMENT_PLANS for c in _vehicle_premiums(plan)]
    scale = _scale(vehicles, sums, quotes)
    totals = child_totals(
        _in_units(quotes, umuim, scale),
        "quote_id",
        _in_units(vehicles, sums, scale),
        "quote_id",
        sums=sums,
        counts={"vin": "vehicle_count"},
    )
    return totals.select(
        "quote_id",
        *[c for plan in PAYMENT_PLANS for c in _with_total(plan, scale)],
        F.col("vehicle_count").cast("double").alias("vehicle_count"),
    )


def hypothetical_by_rate(
    t: Tables,
    p: MartParams,
    coverages: Sequence[str] = HYPOTHETICAL_COVERAGES,
    keep: KeyFilter | None = None,
) -> DataFrame:
    """All-vehicles-covered premium at the n-th highest deductible, per rate and coverage.

    It depends on the rate alone, so the quotes of a rate share one computation,
    and both coverages come out of one pass over the option premiums.
    """
    vehicles = t["vehicle_rates"]
    options = t["vehicle_rate_coverages"]
    if keep is not None:
        vehicles = keep.apply(vehicles, "rate_id")
    vehicles = vehicles.select(F.col("id").alias("vehicle_rate_id"), "rate_id")
    if keep is not None:
        vehicles, keep = keep.through(vehicles, "rated_vehicles")
        options = keep.joined(options, "vehicle_rate_id")
    deductibles = (
        t["coverages"]
        .filter(F.col("symbol").isin(*coverages) & F.col("deductible").isNotNull())
        .select(F.col("id").alias("coverage_id"), "symbol", "deductible")
    )
    scale = _scale(options, list(OPTION_PREMIUMS.values()))
    if keep is not None:
        # Options go on as rows of rates, without the vehicle, and are summed per rate in
        # the stage that joins the deductibles.
        amounts = [to_units(c, scale).alias(plan) for plan, c in OPTION_PREMIUMS.items()]
        of_rates = options.select("rate_id", "coverage_id", *amounts)
        summands = of_rates.join(deductibles, "coverage_id")
    else:
        # Summed per vehicle first: the big option table is combined in the scan
        # stage and meets the vehicles with one row per deductible.
        per_vehicle = (
            options.join(deductibles, "coverage_id")
            .groupBy("vehicle_rate_id", "symbol", "deductible")
            .agg(*[F.sum(to_units(c, scale)).alias(plan) for plan, c in OPTION_PREMIUMS.items()])
        )
        summands = per_vehicle.join(vehicles, "vehicle_rate_id")
    per_rate = (
        summands.groupBy("rate_id", "symbol", "deductible")
        .agg(*[from_units(F.sum(plan), scale).alias(plan) for plan in OPTION_PREMIUMS])
    )
    return nth_per_key(per_rate, ["rate_id", "symbol"], "deductible", p.hypothetical_rank)


def _hypothetical_columns(coverage: str) -> dict[str, str]:
    return {
        "deductible": f"{coverage}_deductible_hypothetical",
        **{plan: f"{premium(plan, coverage)}_hypothetical" for plan in OPTION_PREMIUMS},
    }


def hypothetical_premium(t: Tables, p: MartParams, coverage: str) -> DataFrame:
    """Hypothetical premium of one coverage for every quote that has one."""
    rates = key_set(t["rates"], "id", "rate_id")
    quotes = t["quotes"].select(F.col("id").alias("quote_id"), "rate_id")
    names = _hypothetical_columns(coverage)
    by_rate = hypothetical_by_rate(t, p, [coverage]).withColumnsRenamed(names)
    return (
        quotes.join(rates, "rate_id", "left_semi")
        .join(by_rate, "rate_id")
        .select("quote_id", *names.values())
    )


def hypothetical_wide(t: Tables, p: MartParams, keep: KeyFilter | None = None) -> DataFrame:
    """Both hypothetical premiums side by side, one row per rate."""
    by_rate = hypothetical_by_rate(t, p, keep=keep)
    return by_rate.groupBy("rate_id").agg(
        *[
            F.max(F.when(F.col("symbol") == coverage, F.col(source))).alias(name)
            for coverage in HYPOTHETICAL_COVERAGES
            for source, name in _hypothetical_columns(coverage).items()
        ]
    )


def latest_rerate_quotes(t: Tables, p: MartParams, keep: KeyFilter | None = None) -> DataFrame:
    """Quote of the newest version of each re-rate made for the price comparison."""
    rerates = t["rerates"].filter(
        (F.col("reason") == p.rerate_reason) & (F.col("analysis_version") == p.rerate_analysis_version)
    )
    if keep is not None:
        rerates = keep.apply(rerates, "quote_id")
    rerates = rerates.select(F.col("id").alias("rerate_id"), "quote_id")
    versions = t["rerate_rates"].select(F.col("id").alias("rerate_rate_id"), "version")
    quotes = t["rerate_quotes"]
    if keep is not None:
        rerates, keep = keep.through(rerates, "rerates")
        quotes = keep.apply(quotes, "rerate_id")
    quotes = quotes.join(rerates, "rerate_id").join(versions, "rerate_rate_id")
    return latest_per_key(quotes, ["rerate_id"], F.col("version").cast("int"), ["id"]).select(
        "id", "rerate_id", "quote_id", premium("monthly", "umuim")
    )


def competitor_premiums(
    t: Tables, p: MartParams, keep: KeyFilter | None = None, check_quotes: bool = True
) -> DataFrame:
    """Re-rated monthly premiums, the stand-in for a competitor's price.

    One row per quote and re-rated umuim premium: a quote re-rated several times
    has several rows unless those premiums are equal. ``check_quotes=False``
    skips the proof that the quote exists.
    """
    newest = latest_rerate_quotes(t, p, keep)
    if check_quotes:
        newest = newest.join(key_set(t["quotes"], "id", "quote_id"), "quote_id", "left_semi")
    newest = newest.withColumnRenamed("id", "rerate_quote_id")
    vehicles = t["rerate_vehicle_quotes"]
    if keep is not None:
        newest, keep = keep.through(newest, "rerate_quotes")
        vehicles = keep.apply(vehicles, "rerate_quote_id")
    sums, umuim = _vehicle_premiums("monthly"), premium("monthly", "umuim")
    scale = _scale(vehicles, sums, newest)
    per_rerate = vehicles.groupBy("rerate_quote_id").agg(
        *[F.sum(to_units(c, scale)).alias(c) for c in sums]
    )
    totals = (
        _in_units(newest, [umuim], scale)
        .join(per_rerate, "rerate_quote_id")
        .groupBy("quote_id", umuim)
        .agg(*[F.sum(c).alias(c) for c in sums])
    )
    return totals.select("quote_id", *_with_total("monthly", scale, "_nonubi"))
