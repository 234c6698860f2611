"""The wide table: representative quotes joined to everything known about them."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelens.functions.exprs import (
    exposure,
    guarded_ratio,
    plan_blend,
    presence_flag,
    rate_change,
)
from quotelens.operators.joins import KeyFilter, heavy_keys, spread_join
from quotelens.operators.sets import union_disjoint
from quotelens.plans.coverage import QUOTE_MEASURES, quote_limits, vehicle_limits
from quotelens.plans.params import MartParams
from quotelens.plans.people import ACCOUNT_FACTS, latest_account_facts, rated_people
from quotelens.plans.premiums import (
    competitor_premiums,
    hypothetical_wide,
    premium,
    premium_totals,
)
from quotelens.plans.quotes import Tables, representative_quotes
from quotelens.session import check_session, fit_filters
from quotelens.sources.sink import commit, run_key
from quotelens.sources.staging import Staging

#: Reported coverage groups and the coverages each one adds up.
GROUPS = {
    "bi_pd": ("bi", "pd"),
    "coll_comp": ("coll", "comp"),
    "med_pay": ("med_pay",),
    "pip": ("pip",),
    "rental": ("rental",),
    "umuim": ("umuim",),
    "total": ("total",),
}
#: Groups whose rate change is taken per vehicle.
PER_VEHICLE = ("bi_pd", "coll_comp")

VEHICLE_LIMIT_COLUMNS = (
    "bi_limit_per_person",
    "bi_limit_per_occurrence",
    "pd_limit_per_occurrence",
    "coll_deductible",
    "comp_deductible",
    "med_pay_limit_per_person",
    "pip_limit_per_person",
    "pip_limit_per_occurrence",
    "rental_limit_per_day",
    "rental_limit_per_occurrence",
)


def _sum(parts: tuple[str, ...], plan: str, prefix: str = "", suffix: str = "") -> Column:
    columns = [F.col(prefix + premium(plan, c) + suffix) for c in parts]
    return columns[0] if len(columns) == 1 else columns[0] + columns[1]


def _output(p: MartParams, base_columns: list[str]) -> list[Column]:
    def quoted(group: str, plan: str) -> Column:
        return _sum(GROUPS[group], plan)

    def hypothetical(plan: str) -> Column:
        return _sum(GROUPS["coll_comp"], plan, suffix="_hypothetical")

    def current(group: str) -> Column:
        return _sum(GROUPS[group], "monthly", prefix="current_")

    def competitor(group: str) -> Column:
        return _sum(GROUPS[group], "monthly", suffix="_nonubi")

    def blend(monthly: Column, full: Column) -> Column:
        return plan_blend(
            "invoice_period",
            monthly,
            full,
            p.full_payment_weight,
            p.monthly_plan,
            p.full_plan,
        )

    def car_years(group: str) -> Column:
        declinable = () if group == "bi_pd" else GROUPS[group]
        premiums = [premium("paid_in_full", c) for c in declinable]
        return exposure("vehicle_count", *premiums, years=p.term_years)

    def change(group: str) -> Column:
        units = ("vehicle_count", "current_vehicle_count") if group in PER_VEHICLE else ()
        return rate_change(quoted(group, "monthly"), current(group), *units)

    return [
        *[F.col(c) for c in base_columns],
        F.col("vehicle_count"),
        *[F.col(f"{c}_max").alias(c) for c in VEHICLE_LIMIT_COLUMNS],
        *[F.col(m.name) for m in QUOTE_MEASURES],
        F.col("coll_deductible_hypothetical"),
        F.col("comp_deductible_hypothetical"),
        presence_flag(current("coll_comp")).alias("coll_comp_on_current_policy"),
        *[
            blend(quoted(g, "monthly"), quoted(g, "paid_in_full")).alias(f"{g}_quoted_premium")
            for g in GROUPS
        ],
        blend(hypothetical("monthly"), hypothetical("paid_in_full")).alias(
            "coll_comp_quoted_premium_hypothetical"
        ),
        *[car_years(g).alias(f"{g}_quoted_car_years") for g in GROUPS if g != "total"],
        *[
            guarded_ratio(quoted(g, "monthly"), competitor(g)).alias(f"{g}_{p.ratio_label}_ratio")
            for g in GROUPS
        ],
        *[change(g).alias(f"{g}_renewal_rate_change") for g in GROUPS],
        rate_change(
            hypothetical("monthly"),
            current("coll_comp"),
            "vehicle_count",
            "current_vehicle_count",
        ).alias("coll_comp_renewal_rate_change_hypothetical"),
        *[F.col(c) for c in ACCOUNT_FACTS],
        F.col("fico_insurance_score_status"),
        F.col("fico_insurance_score"),
        F.col("homeowner"),
        F.col("months_continuous_insurance_status"),
        F.col("months_continuous_insurance"),
        F.col("months_with_previous_carrier_status"),
        F.col("months_with_previous_carrier"),
        F.col("prior_insurance_class"),
        F.col("rating_reason"),
        F.col("mean_daveability_score"),
        F.col("mean_distracted_driving_score"),
    ]


def _with_current_policy(base: DataFrame, totals: DataFrame) -> DataFrame:
    """Add the monthly premiums of the policy being renewed.

    Only renewals have one. New business takes nulls without joining, so its null
    keys never gather in one shuffle partition.
    """
    current = totals.select(
        F.col("quote_id").alias("current_policy_term_revision_quote_id"),
        F.col("vehicle_count").alias("current_vehicle_count"),
        *[
            F.col(premium("monthly", c)).alias(f"current_{premium('monthly', c)}")
            for parts in GROUPS.values()
            for c in parts
        ],
    )
    key = "current_policy_term_revision_quote_id"
    renewals = base.filter(F.col("renewal") & F.col(key).isNotNull()).join(current, key, "left")
    rest = base.filter(~F.col("renewal") | F.col(key).isNull()).withColumns(
        {c: F.lit(None).cast("double") for c in current.columns if c != key}
    )
    return union_disjoint(renewals.select(*base.columns, *current.columns[1:]), rest)


def _side_by_side(
    spark: SparkSession, builders: dict[str, Callable[[], Any]]
) -> dict[str, Any]:
    """Run the builders, two at once: while one stages a table the other leaves no core idle.

    More at once keep the plans and filters of more queries in the driver's memory.
    """
    with ThreadPoolExecutor(2) as pool:
        started = {
            name: pool.submit(inheritable_thread_target(spark)(build))
            for name, build in builders.items()
        }
        return {name: future.result() for name, future in started.items()}


def build_mart(
    tables: Tables, params: MartParams | None = None, staging: Staging | None = None
) -> DataFrame:
    """One row per representative quote decided in the study period, 85 columns.

    A quote with several competitor prices, or on a rate with several requests,
    has a row for each combination.

    With ``staging`` the representative quotes, which everything else is driven by,
    are written first, every child table is cut down to their keys, and the vehicle
    quotes, read for totals and for limits, are cut and written once. What belongs to
    a quote is written in buckets of quotes, as are the representative quotes with
    what they have by other keys, so the last joins shuffle nothing. Requests of a
    rate that very many share are dealt over tasks. Delete the tables when the result
    is written. Without it, or where no shared folder is named, the plan is one lazy
    query without those cuts. The session must be set up as
    :func:`quotelens.session.configure` does.
    """
    t, p = tables, params or MartParams()
    spark = t["quotes"].sparkSession
    check_session(spark)
    if staging is None or not staging.enabled:
        return _lazy(t, p)
    fit_filters(spark)
    base = representative_quotes(t, p, in_study=True, staging=staging)
    base_columns = base.columns
    base = staging.table(base, "representative_quotes", by="quote_id")
    fit_filters(spark, base.count())
    keep = KeyFilter(base, staging, "representative_quotes")
    both = ["quote_id", "current_policy_term_revision_quote_id"]

    def by_quote(build: Callable[[], DataFrame], name: str) -> Callable[[], DataFrame]:
        return lambda: staging.table(build(), name, by="quote_id")

    def of_vehicles() -> dict[str, DataFrame]:
        cut = keep.apply(t["vehicle_quotes"], "quote_id", both)
        vehicles = staging.table(cut, "vehicle_quotes", by="quote_id")
        return _side_by_side(
            spark,
            {
                "totals": by_quote(lambda: premium_totals(t, keep, both, vehicles), "premium_totals"),
                "vehicle_limits": by_quote(lambda: vehicle_limits(t, keep=keep, vehicles=vehicles), "vehicle_limits"),
            },
        )

    parts = _side_by_side(
        spark,
        {
            "of_vehicles": of_vehicles,
            "quote_limits": by_quote(lambda: quote_limits(t, keep), "quote_limits"),
            "competitor": by_quote(
                lambda: competitor_premiums(t, p, keep, check_quotes=False), "competitor_premiums"
            ),
            "people": lambda: rated_people(t, p, keep),
            "hypothetical": lambda: staging.table(hypothetical_wide(t, p, keep), "hypothetical_premiums", by="rate_id"),
            "heavy": lambda: heavy_keys(base, "rate_id"),
        },
    )
    parts |= parts.pop("of_vehicles")
    # Joins on the other keys come first, while rows are narrow.
    customer = ["profile_id", "account_id"]
    # Customers are fewer than quotes and get what is known of them before they meet those.
    customers = (
        base.select(*customer)
        .distinct()
        .join(latest_account_facts(t, keep), "account_id", "left")
        .join(parts["people"], "profile_id", "left")
    )
    keyed = _with_current_policy(base, parts["totals"])
    keyed = spread_join(keyed, parts["hypothetical"], "rate_id", parts["heavy"], "left", _reasons(t, keep))
    keyed = keyed.join(customers, customer, "left")
    wide = staging.table(keyed, "by_other_keys", by="quote_id")
    for name in ("totals", "vehicle_limits", "quote_limits", "competitor"):
        wide = wide.join(parts[name], "quote_id", "left")
    return wide.select(*_output(p, base_columns))


def write_mart(
    tables: Tables,
    target: str,
    params: MartParams | None = None,
    folder: str | None = None,
    version: str | None = None,
) -> bool:
    """Write the mart to ``target``, ordered by decision date, whole or not at all.

    Tables are staged in ``folder``, or the one the session names, and dropped at the
    end. See :func:`quotelens.sources.sink.commit` for runs that are cut off or
    repeated; ``version`` names the inputs instead of their files.
    """
    p = params or MartParams()
    key = run_key(tables, p, version=version)
    spark = tables["quotes"].sparkSession
    return commit(
        spark, lambda staging: build_mart(tables, p, staging), target, key, folder, ("decision_date", "quote_id")
    )


def _reasons(t: Tables, keep: KeyFilter | None = None) -> DataFrame:
    requests = t["rating_requests"]
    if keep is not None:
        requests = keep.apply(requests, "rate_id")
    return requests.select("rate_id", F.col("reason").alias("rating_reason"))


def _lazy(t: Tables, p: MartParams) -> DataFrame:
    base = representative_quotes(t, p, in_study=True)
    totals = premium_totals(t)
    # Those on the quote share one shuffle.
    wide = (
        _with_current_policy(base, totals)
        .join(latest_account_facts(t), "account_id", "left")
        .join(rated_people(t, p), "profile_id", "left")
        .join(hypothetical_wide(t, p), "rate_id", "left")
        .join(_reasons(t), "rate_id", "left")
        .join(totals, "quote_id", "left")
        .join(vehicle_limits(t), "quote_id", "left")
        .join(quote_limits(t), "quote_id", "left")
        .join(competitor_premiums(t, p, check_quotes=False), "quote_id", "left")
    )
    return wide.select(*_output(p, base.columns))
