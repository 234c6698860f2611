"""Random marts against the plain SQL: broken keys, nulls, repeats and hot keys.

The SQL joins first and groups or ranks after; the plans pre-aggregate, choose per
rate and cut tables by broadcast keys. Both must agree on any data.
"""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import duckdb
import pyarrow as pa
import pytest

from quotelens import MartParams, build_mart
from quotelens.sources.staging import Staging
from quotelens.queries.mart import mart_sql
from quotelens.sources.schemas import SCHEMAS, VEHICLE_COVERAGES

WORDS = {
    "reason": ["new-business", "rerate", "override", "renewal", "non_ubi_premium_analysis"],
    "tier": ["recommended", "low", "high", "custom", "other", None],
    "invoice_period": ["monthly", "full_term", "quarterly", None],
    "symbol": [*VEHICLE_COVERAGES, "coll", "comp", "um", "uim", "umuim", "umpd", "uimpd", "zz"],
    "fico_insurance_score": ["no_score", "thin_file", "0", "640", None],
    "months_continuous_insurance": ["no_use", "7", None],
    "months_with_previous_carrier": ["no_use", "9", None],
    "prior_insurance_class": ["A", "B", "C", "N", "Z", None],
    "daveability_score": ["no_use", "test_drive", "55", "70", None],
    "distracted_driving_score": ["no_use", "test_drive", "11", None],
    "version": ["1", "2", "9", "10", "11", None],
}
SIZES = {"quotes": 160, "rates": 50, "profiles": 20, "account_facts": 25, "coverages": 60,
         "policy_terms": 40, "rating_requests": 70, "vehicle_rates": 90, "rerates": 90}
PARENTS = {
    "rate_id": "rates", "profile_rating_data_id": "profile_rating_data", "profile_id": "profiles",
    "renewal_rating_request_id": "rating_requests", "quote_id": "quotes",
    "policy_term_revision_id": "policy_term_revisions", "policy_term_id": "policy_terms",
    "vehicle_quote_id": "vehicle_quotes", "coverage_id": "coverages",
    "vehicle_rate_id": "vehicle_rates", "rerate_id": "rerates", "rerate_rate_id": "rerate_rates",
    "rerate_quote_id": "rerate_quotes", "account_id": 15, "policy_id": 12,
}


def size(table):
    return SIZES.get(table, 120)


def make(seed, hot):
    """Rows of all tables; ``hot`` sends a third of every reference to one key."""
    rnd = random.Random(seed)

    def reference(name):
        if hot and rnd.random() < 1 / 3:
            return 1
        parent = PARENTS[name]
        top = parent if isinstance(parent, int) else size(parent)
        # Some keys are null, some have no parent.
        return None if rnd.random() < 0.05 else rnd.randrange(int(top * 1.1) + 1)

    def cell(table, name, kind, i):
        if name == "id":
            return i
        if name in PARENTS:
            return reference(name)
        if name in WORDS:
            return rnd.choice(WORDS[name])
        if kind == "timestamp":
            day = dt.datetime(2018, 8, 1) + dt.timedelta(days=rnd.randrange(170))
            return None if rnd.random() < 0.05 else day
        if kind == "date":
            return dt.date(2018, 8, 1) + dt.timedelta(days=rnd.randrange(170))
        if kind.startswith("decimal"):
            return rnd.choice([None, Decimal("0.00"), Decimal(rnd.randrange(1, 90000)) / 100])
        if kind == "int":
            return rnd.choice([None, 1, 1, 2, 5, 10, 250, 500])
        return rnd.choice(["a", "b", None])

    data = {
        table: [
            {f.name: cell(table, f.name, f.dataType.simpleString(), i) for f in schema}
            for i in range(size(table))
        ]
        for table, schema in SCHEMAS.items()
    }
    # Every quote has a counted vehicle: a rate change per vehicle is an error without.
    for i in range(size("quotes") + 20):
        row = {f.name: None for f in SCHEMAS["vehicle_quotes"]}
        data["vehicle_quotes"].append(row | {"id": 1000 + i, "quote_id": i, "vin": "V"})
    for row in data["rerates"]:
        row["reason"] = rnd.choice(["non_ubi_premium_analysis"] * 4 + ["audit"])
        row["analysis_version"] = rnd.choice([1, 1, 1, 2])
    for row in data["rating_requests"]:
        row["reason"] = rnd.choice(WORDS["reason"][:4])
    # A hot coverage would multiply the plain SQL's product of joins beyond reach.
    for bridge in ("coverages_vehicle_quotes", "coverages_quotes"):
        for row in data[bridge]:
            row["coverage_id"] = rnd.randrange(size("coverages"))
    return data


@pytest.fixture(scope="module", autouse=True)
def without_codegen(spark):
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    yield
    spark.conf.unset("spark.sql.codegen.wholeStage")


def rounded(rows):
    return sorted(
        repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in rows
    )


@pytest.mark.parametrize(("seed", "hot", "staged"), [(1, False, True), (2, True, True), (3, True, False)])
def test_mart_equals_plain_sql(spark, seed, hot, staged):
    data = make(seed, hot)
    tables, duck = {}, duckdb.connect()
    for name, schema in SCHEMAS.items():
        rows = [tuple(r[c] for c in schema.names) for r in data[name]]
        tables[name] = spark.createDataFrame(rows, schema)
        duck.register(f"{name}_rows", pa.table(
            {c: pa.array([r[i] for r in rows], arrow_type(schema[c].dataType))
             for i, c in enumerate(schema.names)}
        ))
    definitions = "WITH " + ", ".join(f"{n} AS (FROM {n}_rows)" for n in SCHEMAS)
    ours = build_mart(tables, MartParams(), Staging(spark) if staged else None)
    expected = duck.sql(mart_sql(definitions))
    assert ours.columns == expected.columns
    found = [
        tuple(str(v) if isinstance(v, dt.date) else v for v in r) for r in ours.collect()
    ]
    assert len(found) >= 10
    assert rounded(found) == rounded(expected.fetchall())


def arrow_type(kind):
    return {
        "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(),
        "timestamp": pa.timestamp("us"), "date": pa.date32(),
        "decimal(12,2)": pa.decimal128(12, 2),
    }[kind.simpleString()]
