"""Null and edge rules of the scalar expressions."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quotelens.functions import (
    decode,
    exposure,
    guarded_ratio,
    matured_flag,
    plan_blend,
    presence_flag,
    rank_from_list,
    rate_change,
    sentinel_status,
    sentinel_value,
)

AS_OF = dt.date(2018, 12, 31)


def values(spark, kind, items, *exprs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, x {kind}")
    found = df.select("i", *[e.alias(f"e{n}") for n, e in enumerate(exprs)]).orderBy("i").collect()
    out = [tuple(r)[1:] for r in found]
    return [r[0] for r in out] if len(exprs) == 1 else out


def test_rank_and_decode_leave_unknown_and_null_as_null(spark):
    items = ["low", "recommended", "mystery", None]
    assert values(spark, "string", items, rank_from_list("x", ["recommended", "low"])) == [
        2, 1, None, None,
    ]
    assert values(spark, "string", ["A", "Z", None], decode("x", {"A": "a"})) == ["a", None, None]
    with_default = decode("x", {"A": "a"}, "other")
    assert values(spark, "string", ["A", "Z", None], with_default) == ["a", "other", "other"]


def test_matured_flag_counts_days_to_the_as_of_date(spark):
    dates = [AS_OF - dt.timedelta(days=n) for n in (34, 35, 69, 70, -5)] + [None]
    found = values(
        spark, "date", dates,
        matured_flag("x", AS_OF, 35, True), matured_flag("x", AS_OF, 70, False),
    )
    assert found == [
        (None, None), (True, None), (True, None), (True, False), (None, None), (True, False),
    ]


def test_matured_flag_counts_date_boundaries_of_timestamps(spark):
    late = dt.datetime(2018, 11, 26, 23, 59)
    assert values(spark, "timestamp", [late], matured_flag("x", AS_OF, 35, True)) == [True]


def test_sentinels_split_words_from_numbers(spark):
    items = ["no_score", "0", "712", None]
    markers = ("no_score", "0")
    found = values(
        spark, "string", items, sentinel_status("x", markers), sentinel_value("x", markers)
    )
    assert found == [
        ("no_score", None), ("0", None), ("populated", 712.0), ("populated", None),
    ]


def test_unlisted_word_raises_unless_lenient(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        values(spark, "string", ["junk"], sentinel_value("x", ("no_use",)))
    assert values(
        spark, "string", ["junk", "7"], sentinel_value("x", ("no_use",), strict=False)
    ) == [None, 7.0]


def test_plan_blend_mixes_every_unknown_plan(spark):
    plans = ["monthly", "full_term", "quarterly", None]
    found = values(spark, "string", plans, plan_blend("x", F.lit(10.0), F.lit(20.0)))
    assert found == [10.0, 20.0, 0.3 * 20.0 + 0.7 * 10.0, 0.3 * 20.0 + 0.7 * 10.0]


def test_ratio_and_change_guard_the_denominator_only(spark):
    n, d = F.lit(30.0), F.col("x")
    none = F.lit(None).cast("double")
    found = values(
        spark, "double", [20.0, 0.0, None],
        guarded_ratio(n, d), rate_change(n, d), guarded_ratio(none, d),
    )
    assert found == [(1.5, 0.5, None), (None, None, None), (None, None, None)]


def test_change_per_unit(spark):
    found = values(spark, "double", [50.0], rate_change(F.lit(30.0), "x", F.lit(1.0), F.lit(2.0)))
    assert found == [pytest.approx(30.0 / 25.0 - 1)]


def test_zero_units_raise_under_an_amount_but_not_under_null(spark):
    none = F.lit(None).cast("double")
    assert values(spark, "double", [0.0], rate_change(none, F.lit(1.0), "x", F.lit(1.0))) == [None]
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        values(spark, "double", [0.0], rate_change(F.lit(5.0), F.lit(1.0), "x", F.lit(1.0)))


def test_exposure_is_zero_only_when_every_premium_is_zero(spark):
    found = values(
        spark, "double", [0.0, 3.0, None],
        exposure(F.lit(2.0), "x"), exposure(F.lit(2.0), "x", F.lit(0.0)), exposure(F.lit(2.0)),
    )
    assert found == [(0.0, 0.0, 1.0), (1.0, 1.0, 1.0), (1.0, 1.0, 1.0)]


def test_presence_flag(spark):
    assert values(spark, "double", [2.0, 0.0, -1.0, None], presence_flag("x")) == [
        1, 0, None, None,
    ]
