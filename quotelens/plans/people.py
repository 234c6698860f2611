"""What is known of the customer: account facts, rating data, driving scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelens.functions.exprs import decode, sentinel_status, sentinel_value
from quotelens.operators.joins import KeyFilter, key_set
from quotelens.operators.ranking import latest_per_key
from quotelens.plans.params import MartParams
from quotelens.plans.quotes import Tables

ACCOUNT_FACTS = (
    "day_zero",
    "hybrid",
    "referred",
    "mobile_platform",
    "pni_age",
    "pni_gender",
    "pni_marital_status",
)


def latest_account_facts(t: Tables, keep: KeyFilter | None = None) -> DataFrame:
    """Newest facts per account."""
    facts = t["account_facts"]
    if keep is not None:
        facts = keep.apply(facts, "account_id")
    newest = latest_per_key(facts, ["account_id"], "rate_timestamp", ACCOUNT_FACTS)
    return newest.select("account_id", *ACCOUNT_FACTS)


def latest_rating_data(t: Tables, p: MartParams, keep: KeyFilter | None = None) -> DataFrame:
    """Newest rating data per profile, with marker words split from numbers."""
    data = t["profile_rating_data"]
    if keep is not None:
        data = keep.apply(data, "profile_id")
    newest = latest_per_key(data, ["profile_id"], "updated_at", ["id"])

    def with_status(name: str, markers: tuple[str, ...]) -> list:
        return [
            sentinel_status(name, markers).alias(f"{name}_status"),
            sentinel_value(name, markers, p.strict_casts).alias(name),
        ]

    return newest.select(
        F.col("id").alias("profile_rating_data_id"),
        "profile_id",
        *with_status("fico_insurance_score", p.fico_markers),
        "homeowner",
        *with_status("months_continuous_insurance", p.months_markers),
        *with_status("months_with_previous_carrier", p.months_markers),
        decode("prior_insurance_class", p.prior_insurance_classes).alias("prior_insurance_class"),
    )


def driver_scores(
    t: Tables, p: MartParams, keep: KeyFilter | None = None, check_data: bool = True
) -> DataFrame:
    """Mean driving scores over the drivers of each version of the rating data.

    ``check_data=False`` skips the proof that the version exists.
    """
    drivers = t["driver_rating_data"]
    if keep is not None:
        drivers = keep.apply(drivers, "profile_rating_data_id")

    def mean(name: str):
        score = sentinel_value(name, p.driving_score_markers, p.strict_casts)
        return F.avg(score).alias(f"mean_{name}")

    scores = drivers.groupBy("profile_rating_data_id").agg(
        mean("daveability_score"), mean("distracted_driving_score")
    )
    if check_data:
        versions = key_set(t["profile_rating_data"], "id", "profile_rating_data_id")
        scores = scores.join(versions, "profile_rating_data_id", "left_semi")
    return scores


def rated_people(t: Tables, p: MartParams, keep: KeyFilter | None = None) -> DataFrame:
    """Newest rating data per profile together with its drivers' mean scores."""
    data = latest_rating_data(t, p, keep)
    if keep is not None:
        data, keep = keep.through(data, "rating_data")
    scores = driver_scores(t, p, keep, check_data=False)
    return data.join(scores, "profile_rating_data_id", "left")
