"""Representative quotes: one bought and one unbought per pricing request."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelens.functions.exprs import matured_flag, rank_from_list
from quotelens.operators.joins import KeyFilter, heavy_keys, key_set, spread_join
from quotelens.operators.ranking import first_by_rank, latest_per_key, sequence_index
from quotelens.operators.sets import union_disjoint, with_constants
from quotelens.plans.params import MartParams
from quotelens.sources.staging import Staging

Tables = Mapping[str, DataFrame]

#: (renewal, bound) of the four sets of representative quotes.
KINDS = {
    "bound_nb": (False, True),
    "unbound_nb": (False, False),
    "bound_renewal": (True, True),
    "unbound_renewal": (True, False),
}


def latest_nb_requests(t: Tables, p: MartParams) -> DataFrame:
    """Newest request per account among those made for a new-business reason."""
    requests = t["rating_requests"].filter(F.col("reason").isin(*p.new_business_reasons))
    data = t["profile_rating_data"].select(
        F.col("id").alias("profile_rating_data_id"), "profile_id"
    )
    profiles = t["profiles"].select(F.col("id").alias("profile_id"), "account_id")
    return latest_per_key(
        requests.join(data, "profile_rating_data_id").join(profiles, "profile_id"),
        ["account_id"],
        "created_at",
        ["id"],
    ).select("id", "rate_id", "profile_rating_data_id", "reason", "created_at")


def latest_renewal_requests(t: Tables) -> DataFrame:
    """Newest renewal request per expiring term, with what is known of that term."""
    requests = t["rating_requests"].select("id", "rate_id")
    renewals = t["renewal_requests"].select(
        F.col("renewal_rating_request_id").alias("id"),
        F.col("policy_term_revision_id").alias("current_policy_term_revision_id"),
        F.col("created_at").alias("renewal_created_at"),
    )
    revisions = t["policy_term_revisions"].select(
        F.col("id").alias("current_policy_term_revision_id"),
        F.col("policy_term_id").alias("current_policy_term_id"),
        F.col("quote_id").alias("current_policy_term_revision_quote_id"),
        F.col("term_expiration_date").cast("date").alias("current_policy_term_expiration_date"),
    )
    # Whether the term exists depends on the ranking key alone, so that join may
    # come after the pick and meets one row per term.
    terms = t["policy_terms"].select(F.col("id").alias("current_policy_term_id"), "invoice_period")
    newest = latest_per_key(
        renewals.join(revisions, "current_policy_term_revision_id").join(requests, "id"),
        ["current_policy_term_id"],
        "renewal_created_at",
        ["id", "current_policy_term_revision_id"],
    )
    return newest.join(terms, "current_policy_term_id").select(
        "id",
        "rate_id",
        "current_policy_term_id",
        "current_policy_term_revision_id",
        "current_policy_term_revision_quote_id",
        "current_policy_term_expiration_date",
        "invoice_period",
    )


def term_tenure(t: Tables, staging: Staging | None = None) -> DataFrame:
    """Each term with the number of earlier terms of its policy."""
    terms = t["policy_terms"].select("id", "policy_id", "created_at")
    return sequence_index(
        terms,
        ["policy_id"],
        "created_at",
        out="prior_policy_term_count",
        tie_breakers=["id"],
        staging=staging,
    )


def quote_choices(
    t: Tables, p: MartParams, keep: KeyFilter | None = None, bound: bool | None = None
) -> DataFrame:
    """The best-ranked bought and the best-ranked unbought quote of each rate.

    Every request on a rate sees the same quotes, so choosing per rate gives each
    request the quote it would choose itself, and requests meet one row per set
    where they would meet every quote of the rate. ``keep``: the filter that the
    requests make; most quotes of other rates go before anything is shuffled. ``bound``
    leaves one of the two.
    """
    markers = (
        t["initial_policy_term_revisions"]
        .filter(F.col("id").isNotNull() & F.col("quote_id").isNotNull())
        .groupBy("quote_id")
        .agg(F.min_by("policy_term_id", "id").alias("policy_term_id"))
    )
    terms = t["policy_terms"].select(
        F.col("id").alias("policy_term_id"), F.col("invoice_period").alias("bought_invoice_period")
    )
    bought = markers.join(terms, "policy_term_id", "left").select(
        "quote_id", "bought_invoice_period", F.lit(True).alias("bought")
    )
    offered = t["quotes"].filter(F.col("rate_id").isNotNull())
    if keep is not None:
        offered = keep.apply(offered, "rate_id")
    quotes = (
        offered.select(
            F.col("id").alias("quote_id"),
            "rate_id",
            F.to_date("created_at").alias("created_on"),
            "tier",
            rank_from_list("tier", p.tier_order).alias("tier_rank"),
        )
        .join(bought, "quote_id", "left")
        .withColumn("bound", F.coalesce("bought", F.lit(False)))
        .drop("bought")
    )
    if bound is not None:
        quotes = quotes.filter(F.col("bound") == bound)
    return first_by_rank(quotes, ["rate_id", "bound"], "tier_rank", ["quote_id"])


def _new_requests(t: Tables, p: MartParams) -> DataFrame:
    key_type = t["quotes"].schema["id"].dataType.simpleString()
    return with_constants(
        latest_nb_requests(t, p).select("rate_id", F.col("id").alias("rating_request_id")),
        {
            "renewal": (False, "boolean"),
            "current_policy_term_revision_quote_id": (None, key_type),
            "expires_on": (None, "date"),
            "prior_policy_term_count": (0, "long"),
            "current_invoice_period": (None, "string"),
        },
    )


def _renewal_requests(t: Tables, p: MartParams, in_study: bool, staging: Staging | None) -> DataFrame:
    # One request may renew several terms; its quotes are the same for each.
    expiring = first_by_rank(
        latest_renewal_requests(t), ["id"], "current_policy_term_id"
    ).withColumnsRenamed(
        {
            "id": "rating_request_id",
            "current_policy_term_expiration_date": "expires_on",
            "invoice_period": "current_invoice_period",
        }
    )
    if in_study:
        expiring = expiring.filter(F.col("expires_on").between(p.study_start, p.study_end))
    tenure = term_tenure(t, staging).select(
        F.col("id").alias("current_policy_term_id"),
        (F.col("prior_policy_term_count") + 1).alias("prior_policy_term_count"),
    )
    return (
        expiring.withColumn("renewal", F.lit(True))
        .join(tenure, "current_policy_term_id")
        .drop("current_policy_term_id", "current_policy_term_revision_id")
    )


def _requests(
    t: Tables,
    p: MartParams,
    in_study: bool,
    staging: Staging | None = None,
    renewal: bool | None = None,
) -> DataFrame:
    """New-business and renewal requests, or one of them, one row per request and kind.

    They say which quotes are looked at and are then joined to them, so they are
    staged where they can be.
    """
    kinds = []
    if renewal is not True:
        kinds.append(_new_requests(t, p))
    if renewal is not False:
        kinds.append(_renewal_requests(t, p, in_study, staging))
    found = union_disjoint(*kinds)
    return staging.table(found, "requests") if staging is not None else found


def _with_customer(quotes: DataFrame, t: Tables) -> DataFrame:
    """Add profile, account and market; drop accounts without facts.

    Joined outward from the chosen quotes, so the rates shuffle once, on the key
    the quotes are already partitioned by, and the rest meets chosen rows only. There
    are two of a rate at most here, however many requests it has.
    """
    rates = t["rates"].select(F.col("id").alias("rate_id"), "profile_id", "market")
    profiles = t["profiles"].select(F.col("id").alias("profile_id"), "account_id")
    accounts = key_set(t["account_facts"], "account_id")
    return (
        quotes.join(rates, "rate_id")
        .join(profiles, "profile_id")
        .join(accounts, "account_id", "left_semi")
    )


def representative_quotes(
    t: Tables,
    p: MartParams,
    in_study: bool = False,
    staging: Staging | None = None,
    renewal: bool | None = None,
    bound: bool | None = None,
) -> DataFrame:
    """All four sets of representative quotes; ``in_study`` keeps the study dates only.

    A request with both a bought and an unbought quote gives one row for each.
    ``renewal`` and ``bound`` leave some of the sets, and the work for the others.
    With ``staging`` the requests are worked out once, and those of a rate that very
    many share are dealt over tasks.
    """
    decided_on = F.when(F.col("renewal"), F.col("expires_on")).otherwise(F.col("created_on"))
    plan = (
        F.when(F.col("renewal"), F.col("current_invoice_period"))
        .when(F.col("bound"), F.col("bought_invoice_period"))
        .otherwise(F.lit(p.unknown_plan))
    )
    requests = _requests(t, p, in_study, staging, renewal)
    choices = _with_customer(quote_choices(t, p, KeyFilter(requests, staging, "requests"), bound), t)
    if staging is not None and staging.enabled:
        quotes = spread_join(requests, choices, "rate_id", heavy_keys(requests, "rate_id"))
    else:
        quotes = choices.join(requests, "rate_id")
    quotes = quotes.withColumn("decision_date", decided_on)
    if in_study:
        quotes = quotes.filter(F.col("decision_date").between(p.study_start, p.study_end))
    labels = [
        F.when(F.col("bound"), matured_flag("decision_date", p.as_of, n, True))
        .otherwise(matured_flag("decision_date", p.as_of, n, False))
        .alias(f"bound_within_{n}_days")
        for n in p.maturity_days
    ]
    return quotes.select(
        "quote_id",
        "current_policy_term_revision_quote_id",
        "rate_id",
        "rating_request_id",
        "profile_id",
        "account_id",
        "decision_date",
        "tier",
        "tier_rank",
        "market",
        "renewal",
        "prior_policy_term_count",
        plan.alias("invoice_period"),
        "bound",
        *labels,
    )


def quotes_of_kind(
    t: Tables, p: MartParams, kind: str, staging: Staging | None = None
) -> DataFrame:
    """One of the four sets named in :data:`KINDS`."""
    renewal, bound = KINDS[kind]
    return representative_quotes(t, p, staging=staging, renewal=renewal, bound=bound)
