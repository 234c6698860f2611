"""The 21 source tables: where they live and the columns that are read."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)

VEHICLE_COVERAGES = ("bi", "pd", "coll", "comp", "med_pay", "pip", "rental")


def _money(prefix: str) -> dict[str, object]:
    return {f"{prefix}_{c}_premium_in_dollars": MONEY for c in VEHICLE_COVERAGES}


_TYPES = {
    "long": T.LongType(),
    "int": T.IntegerType(),
    "string": T.StringType(),
    "timestamp": T.TimestampType(),
    "date": T.DateType(),
}


def _schema(text: str, extra: dict[str, object] | None = None) -> T.StructType:
    fields = [pair.split(":") for pair in text.split()]
    columns = {name: _TYPES[kind] for name, kind in fields} | (extra or {})
    return T.StructType([T.StructField(n, t, True) for n, t in columns.items()])


# Table names, the database each lives in, and column names and types.
DATABASES = {
    "public": ("account_facts",),
    "rerating_public": ("rerates", "rerate_quotes", "rerate_rates", "rerate_vehicle_quotes"),
}
DEFAULT_DATABASE = "server_public"

SCHEMAS: dict[str, T.StructType] = {
    "rating_requests": _schema(
        "id:long rate_id:long profile_rating_data_id:long reason:string created_at:timestamp"
    ),
    "profile_rating_data": _schema(
        "id:long profile_id:long updated_at:timestamp fico_insurance_score:string "
        "homeowner:string months_continuous_insurance:string "
        "months_with_previous_carrier:string prior_insurance_class:string"
    ),
    "profiles": _schema("id:long account_id:long"),
    "renewal_requests": _schema(
        "renewal_rating_request_id:long policy_term_revision_id:long created_at:timestamp"
    ),
    "policy_term_revisions": _schema(
        "id:long policy_term_id:long quote_id:long term_expiration_date:date"
    ),
    "policy_terms": _schema(
        "id:long policy_id:long created_at:timestamp invoice_period:string"
    ),
    "quotes": _schema(
        "id:long rate_id:long created_at:timestamp tier:string",
        {
            "paid_in_full_umuim_premium_in_dollars": MONEY,
            "monthly_umuim_premium_in_dollars": MONEY,
        },
    ),
    "rates": _schema("id:long profile_id:long market:string"),
    "initial_policy_term_revisions": _schema("id:long quote_id:long policy_term_id:long"),
    "vehicle_quotes": _schema(
        "id:long quote_id:long vin:string", _money("paid_in_full") | _money("monthly")
    ),
    "coverages_vehicle_quotes": _schema("vehicle_quote_id:long coverage_id:long"),
    "coverages_quotes": _schema("quote_id:long coverage_id:long"),
    "coverages": _schema(
        "id:long symbol:string per_person:int per_occurrence:int per_day:int deductible:int"
    ),
    "vehicle_rates": _schema("id:long rate_id:long"),
    "vehicle_rate_coverages": _schema(
        "vehicle_rate_id:long coverage_id:long",
        {
            "all_full_coverage_premium_dollars": MONEY,
            "all_full_coverage_premium_dollars_with_paid_in_full_discount": MONEY,
        },
    ),
    "driver_rating_data": _schema(
        "profile_rating_data_id:long daveability_score:string distracted_driving_score:string"
    ),
    "account_facts": _schema(
        "account_id:long rate_timestamp:timestamp day_zero:string hybrid:string "
        "referred:string mobile_platform:string pni_age:int pni_gender:string "
        "pni_marital_status:string"
    ),
    "rerates": _schema("id:long quote_id:long reason:string analysis_version:int"),
    "rerate_quotes": _schema(
        "id:long rerate_id:long rerate_rate_id:long", {"monthly_umuim_premium_in_dollars": MONEY}
    ),
    "rerate_rates": _schema("id:long version:string"),
    "rerate_vehicle_quotes": _schema("rerate_quote_id:long", _money("monthly")),
}


def database_of(table: str) -> str:
    for database, tables in DATABASES.items():
        if table in tables:
            return database
    return DEFAULT_DATABASE
