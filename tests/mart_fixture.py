"""A small mart written by hand; the comments say which rule a row is there for."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from quotelens.sources.schemas import SCHEMAS, VEHICLE_COVERAGES

D = Decimal


def at(text):
    return dt.datetime.fromisoformat(text) if text else None


def day(text):
    return dt.date.fromisoformat(text)


def premiums(plan, *amounts):
    names = [f"{plan}_{c}_premium_in_dollars" for c in VEHICLE_COVERAGES]
    return dict(zip(names, [None if a is None else D(str(a)) for a in amounts]))


def vehicle(id, quote_id, vin, full, monthly):
    return {"id": id, "quote_id": quote_id, "vin": vin} | premiums("paid_in_full", *full) | premiums(
        "monthly", *monthly
    )


def quote(id, rate_id, created_at, tier, full=None, monthly=None):
    return {
        "id": id,
        "rate_id": rate_id,
        "created_at": at(created_at),
        "tier": tier,
        "paid_in_full_umuim_premium_in_dollars": None if full is None else D(full),
        "monthly_umuim_premium_in_dollars": None if monthly is None else D(monthly),
    }


FULL = (100, 50, 40, 20, 5, 0, 0)
MONTHLY = (110, 55, 44, 22, "5.5", 0, 0)
NONE = (None,) * 7

# One new-business account per decision date: (account, date of its only quote).
DATED = {
    20: "2018-08-27",
    21: "2018-08-28",
    22: "2018-10-22",  # 70 days before the as-of date
    23: "2018-10-23",  # 69
    24: "2018-11-26",  # 35
    25: "2018-11-27",  # 34
    26: "2018-12-31T23:30:00",
    27: "2019-01-01",
}

ACCOUNTS = [1, 2, 3, 5, 6, 7, 8, *DATED]
# Account 4 exists but has no facts.
PROFILES = [*ACCOUNTS, 4]

ROWS = {
    # Profile n belongs to account n.
    "profiles": [{"id": 10 + a, "account_id": a} for a in PROFILES],
    "account_facts": [
        {"account_id": a, "rate_timestamp": at("2018-01-01"), "pni_age": 30, "hybrid": "old"}
        for a in ACCOUNTS
    ]
    # Account 1 has newer facts; those of account 2 with no time count as newest.
    + [
        {"account_id": 1, "rate_timestamp": at("2018-02-01"), "pni_age": 31, "hybrid": "new"},
        {"account_id": 2, "rate_timestamp": None, "pni_age": 99, "hybrid": "undated"},
    ],
    "profile_rating_data": [
        {"id": 1000 + a, "profile_id": 10 + a, "updated_at": at("2018-01-01")} for a in PROFILES
    ]
    + [
        {
            "id": 2001, "profile_id": 11, "updated_at": at("2018-03-01"),
            "fico_insurance_score": "no_score", "homeowner": "yes",
            "months_continuous_insurance": "no_use", "months_with_previous_carrier": "12",
            "prior_insurance_class": "B",
        },
        {
            "id": 2002, "profile_id": 12, "updated_at": None, "fico_insurance_score": "712",
            "months_continuous_insurance": "24", "prior_insurance_class": "Q",
        },
    ],
    "driver_rating_data": [
        {"profile_rating_data_id": 2001, "daveability_score": "80", "distracted_driving_score": "no_use"},
        {"profile_rating_data_id": 2001, "daveability_score": "91", "distracted_driving_score": "test_drive"},
        {"profile_rating_data_id": 2001, "daveability_score": "no_use", "distracted_driving_score": None},
        {"profile_rating_data_id": 1002, "daveability_score": "1", "distracted_driving_score": "1"},
    ],
    "rating_requests": [
        {"id": 101, "rate_id": 201, "profile_rating_data_id": 1001, "reason": "new-business", "created_at": at("2018-09-01")},
        # Older, and newer but for another reason: neither is account 1's request.
        {"id": 91, "rate_id": 291, "profile_rating_data_id": 1001, "reason": "rerate", "created_at": at("2018-08-01")},
        {"id": 92, "rate_id": 291, "profile_rating_data_id": 1001, "reason": "audit", "created_at": at("2018-10-01")},
        {"id": 102, "rate_id": 202, "profile_rating_data_id": 1002, "reason": "override", "created_at": None},
        {"id": 93, "rate_id": 291, "profile_rating_data_id": 1002, "reason": "override", "created_at": at("2018-12-01")},
        # Two requests on one rate: rows of that rate double.
        {"id": 103, "rate_id": 203, "profile_rating_data_id": 1003, "reason": "new-business", "created_at": at("2018-09-01")},
        {"id": 104, "rate_id": 203, "profile_rating_data_id": 1003, "reason": "audit", "created_at": at("2018-09-02")},
        {"id": 105, "rate_id": 204, "profile_rating_data_id": 1004, "reason": "new-business", "created_at": at("2018-09-01")},
        # The best tier is out of the study period: the request is lost.
        {"id": 108, "rate_id": 208, "profile_rating_data_id": 1008, "reason": "rerate", "created_at": at("2018-09-01")},
        # The latest request of account 7 is on a rate without quotes.
        {"id": 107, "rate_id": 207, "profile_rating_data_id": 1007, "reason": "rerate", "created_at": at("2018-10-01")},
        {"id": 106, "rate_id": 206, "profile_rating_data_id": 1007, "reason": "rerate", "created_at": at("2018-09-01")},
        # Renewals: 112 is older than 111 for the same term.
        {"id": 111, "rate_id": 211, "profile_rating_data_id": 1005, "reason": "renewal", "created_at": at("2018-09-01")},
        {"id": 112, "rate_id": 212, "profile_rating_data_id": 1005, "reason": "renewal", "created_at": at("2018-08-01")},
        {"id": 113, "rate_id": 213, "profile_rating_data_id": 1006, "reason": "renewal", "created_at": at("2018-10-01")},
    ]
    + [
        {"id": 300 + a, "rate_id": 400 + a, "profile_rating_data_id": 1000 + a, "reason": "new-business", "created_at": at(d)}
        for a, d in DATED.items()
    ],
    "rates": [
        {"id": 200 + n, "profile_id": 10 + a, "market": "OH"}
        for n, a in {1: 1, 2: 2, 3: 3, 4: 4, 6: 7, 7: 7, 8: 8, 11: 5, 12: 5, 13: 6, 91: 1}.items()
    ]
    + [{"id": 400 + a, "profile_id": 10 + a, "market": "AZ"} for a in DATED],
    "quotes": [
        # One request with a bought and unbought quotes is in both sets.
        quote(301, 201, "2018-09-01T10:00:00", "low", "10", "11"),
        quote(302, 201, "2018-09-01T11:00:00", "recommended"),
        quote(303, 201, "2018-09-01T12:00:00", "high"),
        # Only the custom quote was bought; the unbought one has an unknown tier.
        quote(310, 202, "2018-09-02", "custom", "0", "0"),
        quote(311, 202, "2018-09-02", "mystery"),
        quote(320, 203, "2018-09-03", "recommended"),
        quote(321, 203, "2018-09-03", None),
        quote(330, 204, "2018-09-03", "recommended"),
        quote(340, 206, "2018-09-03", "recommended"),
        quote(380, 208, "2018-08-27", "recommended"),
        quote(381, 208, "2018-09-27", "low"),
        quote(351, 999, "2018-03-01", "recommended", "0", "0"),
        quote(352, 999, "2018-03-01", "recommended", "0", "0"),
        quote(361, 211, "2018-09-05", "recommended", "1", "2"),
        quote(362, 212, "2018-09-05", "recommended"),
        quote(363, 213, "2018-10-05", "low", "1", "2"),
    ]
    + [quote(500 + a, 400 + a, d, "recommended") for a, d in DATED.items()],
    "initial_policy_term_revisions": [
        {"id": 602, "quote_id": 301, "policy_term_id": 999},
        # Bought twice: the first purchase gives the invoice period.
        {"id": 601, "quote_id": 301, "policy_term_id": 512},
        {"id": 603, "quote_id": 310, "policy_term_id": None},
        {"id": 604, "quote_id": 361, "policy_term_id": 512},
    ],
    "policy_terms": [
        {"id": 511, "policy_id": 61, "created_at": at("2018-04-01"), "invoice_period": "full_term"},
        {"id": 512, "policy_id": 61, "created_at": at("2018-10-01"), "invoice_period": "monthly"},
        {"id": 521, "policy_id": 62, "created_at": at("2017-01-01"), "invoice_period": "monthly"},
        {"id": 522, "policy_id": 62, "created_at": at("2017-07-01"), "invoice_period": "monthly"},
        {"id": 523, "policy_id": 62, "created_at": at("2018-01-01"), "invoice_period": "quarterly"},
        # No time: sorts after every dated term.
        {"id": 520, "policy_id": 62, "created_at": None, "invoice_period": "monthly"},
    ],
    "policy_term_revisions": [
        {"id": 801, "policy_term_id": 511, "quote_id": 351, "term_expiration_date": day("2018-10-01")},
        {"id": 802, "policy_term_id": 523, "quote_id": 352, "term_expiration_date": day("2018-11-01")},
    ],
    "renewal_requests": [
        {"renewal_rating_request_id": 111, "policy_term_revision_id": 801, "created_at": at("2018-09-01")},
        {"renewal_rating_request_id": 112, "policy_term_revision_id": 801, "created_at": at("2018-08-01")},
        {"renewal_rating_request_id": 113, "policy_term_revision_id": 802, "created_at": at("2018-10-01")},
    ],
    "vehicle_quotes": [
        vehicle(1, 301, "A", FULL, MONTHLY),
        vehicle(2, 301, "B", FULL, MONTHLY),
        vehicle(3, 302, "C", FULL, MONTHLY),
        # No vin and no premium: adds nothing, counts as no vehicle.
        vehicle(4, 302, None, NONE, NONE),
        vehicle(5, 351, "D", (90, 45, 0, 0, 0, 0, 0), (100, 50, 0, 0, 0, 0, 0)),
        vehicle(6, 352, "E", (90, 45, 36, 18, 0, 0, 0), (100, 50, 40, 20, 4, 0, 0)),
        vehicle(7, 361, "F", FULL, MONTHLY),
        vehicle(8, 361, "G", FULL, MONTHLY),
        vehicle(9, 363, "H", FULL, MONTHLY),
    ],
    "coverages": [
        {"id": 1, "symbol": "bi", "per_person": 50, "per_occurrence": 100},
        {"id": 2, "symbol": "bi", "per_person": 100, "per_occurrence": None},
        {"id": 3, "symbol": "pd", "per_occurrence": 25},
        {"id": 4, "symbol": "coll", "deductible": 250},
        {"id": 5, "symbol": "coll", "deductible": 500},
        {"id": 6, "symbol": "coll", "deductible": 1000},
        {"id": 7, "symbol": "comp", "deductible": 500},
        {"id": 8, "symbol": "comp", "deductible": 1000},
        {"id": 9, "symbol": "comp", "deductible": None},
        {"id": 10, "symbol": "rental", "per_occurrence": 900, "per_day": 30},
        {"id": 11, "symbol": "um", "per_person": 7, "per_occurrence": 8},
        {"id": 12, "symbol": "uimpd", "per_person": 7, "per_occurrence": 9},
        {"id": 13, "symbol": "bi", "per_person": 999, "per_occurrence": 999},
    ],
    "coverages_vehicle_quotes": [
        {"vehicle_quote_id": v, "coverage_id": c}
        for v, c in [(1, 1), (2, 2), (1, 3), (1, 3), (2, 6), (1, 5), (2, 10), (1, 11)]
    ],
    # A vehicle-level symbol given at quote level is not read, nor the reverse.
    "coverages_quotes": [
        {"quote_id": q, "coverage_id": c} for q, c in [(301, 11), (301, 12), (301, 13)]
    ],
    "vehicle_rates": [
        {"id": 71, "rate_id": 213},
        {"id": 72, "rate_id": 213},
        {"id": 73, "rate_id": 201},
    ],
    "vehicle_rate_coverages": [
        {
            "vehicle_rate_id": v, "coverage_id": c, "all_full_coverage_premium_dollars": D(m),
            "all_full_coverage_premium_dollars_with_paid_in_full_discount": D(f),
        }
        for v, c, m, f in [
            # Second-highest collision deductible of rate 213 is 500, comprehensive too.
            (71, 4, "50", "45"), (71, 5, "20", "18"), (71, 6, "9", "8"), (72, 5, "10", "9"),
            (71, 7, "24", "20"), (72, 8, "11", "10"), (71, 9, "99", "99"),
            # Rate 201 has a single deductible: no hypothetical premium.
            (73, 5, "20", "18"),
        ]
    ],
    "rerates": [
        {"id": 701, "quote_id": 301, "reason": "non_ubi_premium_analysis", "analysis_version": 1},
        {"id": 702, "quote_id": 302, "reason": "non_ubi_premium_analysis", "analysis_version": 1},
        {"id": 703, "quote_id": 302, "reason": "non_ubi_premium_analysis", "analysis_version": 1},
        {"id": 704, "quote_id": 310, "reason": "non_ubi_premium_analysis", "analysis_version": 2},
        {"id": 705, "quote_id": 310, "reason": "audit", "analysis_version": 1},
        {"id": 706, "quote_id": 361, "reason": "non_ubi_premium_analysis", "analysis_version": 1},
        {"id": 707, "quote_id": 361, "reason": "non_ubi_premium_analysis", "analysis_version": 1},
    ],
    "rerate_rates": [{"id": 9, "version": "9"}, {"id": 10, "version": "10"}],
    "rerate_quotes": [
        {"id": i, "rerate_id": r, "rerate_rate_id": v, "monthly_umuim_premium_in_dollars": u and D(u)}
        for i, r, v, u in [
            # Version 10 beats 9.
            (7010, 701, 10, "11"), (7019, 701, 9, "99"),
            # Two re-rates of one quote: different umuim give two rows ...
            (7020, 702, 9, "5"), (7030, 703, 9, "6"),
            (7040, 704, 9, "5"), (7050, 705, 9, "5"),
            # ... equal ones, nulls too, are added up.
            (7060, 706, 9, None), (7070, 707, 9, None),
        ]
    ],
    "rerate_vehicle_quotes": [
        {"rerate_quote_id": i} | premiums("monthly", *amounts)
        for i, amounts in [
            (7010, (100, 100, 0, 0, 0, 1, 1)),
            (7019, (1, 1, 1, 1, 1, 1, 1)),
            (7020, (10, 10, 10, 10, 10, 10, 10)),
            (7030, (20, 20, 20, 20, 20, 20, 20)),
            (7040, (1, 1, 1, 1, 1, 1, 1)),
            (7050, (1, 1, 1, 1, 1, 1, 1)),
            (7060, (30, 30, 1, 1, 1, 1, 1)),
            (7070, (30, 30, 1, 1, 1, 1, 1)),
        ]
    ],
}


def fixture_tables(spark, **replaced):
    """The fixture as DataFrames; keyword arguments replace the rows of a table."""
    out = {}
    for name, schema in SCHEMAS.items():
        found = replaced.get(name, ROWS[name])
        out[name] = spark.createDataFrame(
            [tuple(r.get(c) for c in schema.names) for r in found], schema
        )
    return out
