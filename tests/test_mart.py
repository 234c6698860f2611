"""The whole mart on the hand-written fixture, values worked out by hand."""

from __future__ import annotations

import datetime as dt
import os

import pytest

from helpers import plan
from mart_fixture import DATED, ROWS, fixture_tables
from quotelens import MartParams, build_mart
from quotelens.plans.premiums import premium_totals
from quotelens.plans.quotes import KINDS, quotes_of_kind, representative_quotes, term_tenure
from quotelens.sources.staging import Staging

PARAMS = MartParams()

# The output columns in order.
COLUMNS = """
quote_id current_policy_term_revision_quote_id rate_id rating_request_id profile_id account_id
decision_date tier tier_rank market renewal prior_policy_term_count invoice_period bound
bound_within_35_days bound_within_70_days vehicle_count bi_limit_per_person
bi_limit_per_occurrence pd_limit_per_occurrence coll_deductible comp_deductible
med_pay_limit_per_person pip_limit_per_person pip_limit_per_occurrence rental_limit_per_day
rental_limit_per_occurrence um_limit_per_person um_limit_per_occurrence uim_limit_per_person
uim_limit_per_occurrence umuim_limit_per_person umuim_limit_per_occurrence
umpd_limit_per_occurrence uimpd_limit_per_occurrence coll_deductible_hypothetical
comp_deductible_hypothetical coll_comp_on_current_policy bi_pd_quoted_premium
coll_comp_quoted_premium med_pay_quoted_premium pip_quoted_premium rental_quoted_premium
umuim_quoted_premium total_quoted_premium coll_comp_quoted_premium_hypothetical
bi_pd_quoted_car_years coll_comp_quoted_car_years med_pay_quoted_car_years pip_quoted_car_years
rental_quoted_car_years umuim_quoted_car_years bi_pd_own_to_competitor_ratio
coll_comp_own_to_competitor_ratio med_pay_own_to_competitor_ratio pip_own_to_competitor_ratio
rental_own_to_competitor_ratio umuim_own_to_competitor_ratio total_own_to_competitor_ratio
bi_pd_renewal_rate_change coll_comp_renewal_rate_change med_pay_renewal_rate_change
pip_renewal_rate_change rental_renewal_rate_change umuim_renewal_rate_change
total_renewal_rate_change coll_comp_renewal_rate_change_hypothetical day_zero hybrid referred
mobile_platform pni_age pni_gender pni_marital_status fico_insurance_score_status
fico_insurance_score homeowner months_continuous_insurance_status months_continuous_insurance
months_with_previous_carrier_status months_with_previous_carrier prior_insurance_class
rating_reason mean_daveability_score mean_distracted_driving_score
""".split()


@pytest.fixture(scope="module", autouse=True)
def without_codegen(spark):
    """Compiling takes longer than running on a dozen rows; the SQL checks compile."""
    names = ("spark.sql.codegen.wholeStage", "spark.sql.adaptive.enabled")
    for name in names:
        spark.conf.set(name, "false")
    yield
    for name in names:
        spark.conf.unset(name)


@pytest.fixture(scope="module")
def tables(spark):
    return fixture_tables(spark)


@pytest.fixture(scope="module")
def mart(tables):
    found = {}
    for r in build_mart(tables, PARAMS).collect():
        found.setdefault((r.quote_id, r.rating_request_id), []).append(r)
    return found


def one(mart, quote_id):
    (found,) = [r for (q, _), r in mart.items() if q == quote_id]
    assert len(found) == 1
    return found[0]


def test_columns_and_types(tables):
    out = build_mart(tables, PARAMS)
    assert out.columns == COLUMNS and len(COLUMNS) == 85
    kinds = dict(out.dtypes)
    assert kinds["decision_date"] == "date"
    assert kinds["bound_within_35_days"] == "boolean"
    for c in COLUMNS:
        if c.endswith(("premium", "_years", "_ratio", "_change", "_hypothetical")):
            assert kinds[c] in ("double", "int"), c


def test_quotes_in_the_mart(mart):
    dated = [500 + a for a in DATED if a not in (20, 27)]
    assert sorted(q for q, _ in mart) == sorted([301, 302, 310, 311, 320, 361, 363, *dated])
    assert {q: len(r) for (q, _), r in mart.items() if len(r) > 1} == {302: 2, 320: 2}


def test_bound_and_unbound_of_one_request(mart):
    bought, other = one(mart, 301), mart[(302, 101)][0]
    assert (bought.bound, bought.tier, bought.tier_rank, bought.renewal) == (True, "low", 2, False)
    assert (other.bound, other.tier, other.tier_rank) == (False, "recommended", 1)
    assert (bought.bound_within_70_days, other.bound_within_70_days) == (True, False)
    assert (bought.invoice_period, other.invoice_period) == ("monthly", "unknown")
    assert bought.prior_policy_term_count == 0
    assert bought.current_policy_term_revision_quote_id is None
    assert bought.decision_date == dt.date(2018, 9, 1)


def test_tier_choices(mart):
    assert one(mart, 310).tier == "custom" and one(mart, 310).bound
    assert one(mart, 310).invoice_period is None
    assert one(mart, 311).tier_rank is None


def test_maturity_at_its_bounds(mart):
    labels = {
        a: (r.bound_within_35_days, r.bound_within_70_days)
        for a in DATED
        for r in mart.get((500 + a, 300 + a), [])
    }
    assert labels == {
        21: (False, False),
        22: (False, False),
        23: (False, None),
        24: (False, None),
        25: (None, None),
        26: (None, None),
    }


def test_premiums_of_a_monthly_quote(mart):
    r = one(mart, 301)
    assert r.vehicle_count == 2.0
    assert (r.bi_pd_quoted_premium, r.coll_comp_quoted_premium) == (330.0, 132.0)
    assert (r.med_pay_quoted_premium, r.umuim_quoted_premium) == (11.0, 11.0)
    assert r.total_quoted_premium == 484.0
    assert (r.bi_pd_quoted_car_years, r.coll_comp_quoted_car_years) == (1.0, 1.0)
    assert (r.pip_quoted_car_years, r.rental_quoted_car_years) == (0.0, 0.0)


def test_premiums_of_an_unknown_plan_are_blended(mart):
    r = mart[(302, 101)][0]
    assert r.vehicle_count == 1.0
    assert r.bi_pd_quoted_premium == pytest.approx(0.3 * 150 + 0.7 * 165)
    assert r.umuim_quoted_premium is None and r.total_quoted_premium is None
    assert r.umuim_quoted_car_years == 0.5


def test_quote_without_vehicles(mart):
    r = one(mart, 311)
    assert r.vehicle_count == 0.0 and r.bi_pd_quoted_premium is None
    assert r.bi_pd_quoted_car_years == 0.0 and r.pip_quoted_car_years == 0.0
    assert one(mart, 310).umuim_quoted_car_years == 0.0


def test_coverage_limits(mart):
    r = one(mart, 301)
    assert (r.bi_limit_per_person, r.bi_limit_per_occurrence) == (100, 100)
    assert (r.pd_limit_per_occurrence, r.coll_deductible, r.comp_deductible) == (25, 1000, None)
    assert (r.rental_limit_per_day, r.rental_limit_per_occurrence) == (30, 900)
    assert (r.um_limit_per_person, r.um_limit_per_occurrence) == (7, 8)
    assert (r.uimpd_limit_per_occurrence, r.umpd_limit_per_occurrence) == (9, None)


def test_competitor_ratios(mart):
    r = one(mart, 301)
    assert r.bi_pd_own_to_competitor_ratio == 330 / 200
    assert r.coll_comp_own_to_competitor_ratio is None
    assert r.pip_own_to_competitor_ratio == 0.0
    assert r.umuim_own_to_competitor_ratio == 1.0
    assert r.total_own_to_competitor_ratio == pytest.approx(484 / 213)
    assert one(mart, 310).bi_pd_own_to_competitor_ratio is None


def test_competitor_rows_multiply_or_merge(mart):
    ratios = sorted(r.bi_pd_own_to_competitor_ratio for r in mart[(302, 101)])
    assert ratios == [165 / 40, 165 / 20]
    merged = one(mart, 361)
    assert merged.bi_pd_own_to_competitor_ratio == 330 / 120
    assert merged.total_own_to_competitor_ratio is None


def test_first_renewal(mart):
    r = one(mart, 361)
    assert (r.renewal, r.bound, r.prior_policy_term_count) == (True, True, 1)
    assert (r.decision_date, r.invoice_period) == (dt.date(2018, 10, 1), "full_term")
    assert r.current_policy_term_revision_quote_id == 351
    assert r.bi_pd_quoted_premium == 300.0
    assert r.bi_pd_renewal_rate_change == pytest.approx(0.1)
    assert r.coll_comp_on_current_policy == 0
    assert r.coll_comp_renewal_rate_change is None
    assert r.total_renewal_rate_change == pytest.approx((330 + 132 + 11 + 2) / 150 - 1)
    assert r.rating_reason == "renewal"


def test_third_renewal_and_hypothetical_premium(mart):
    r = one(mart, 363)
    assert (r.bound, r.prior_policy_term_count, r.invoice_period) == (False, 3, "quarterly")
    assert r.coll_comp_on_current_policy == 1
    assert r.coll_comp_renewal_rate_change == pytest.approx(0.1)
    assert r.med_pay_renewal_rate_change == pytest.approx(5.5 / 4 - 1)
    assert (r.coll_deductible_hypothetical, r.comp_deductible_hypothetical) == (500, 500)
    assert r.coll_comp_quoted_premium_hypothetical == pytest.approx(0.3 * 47 + 0.7 * 54)
    assert r.coll_comp_renewal_rate_change_hypothetical == pytest.approx(54 / 60 - 1)
    assert r.bi_pd_own_to_competitor_ratio is None


def test_new_business_has_no_current_policy(mart):
    r = one(mart, 301)
    assert r.coll_comp_on_current_policy is None and r.bi_pd_renewal_rate_change is None
    assert r.coll_deductible_hypothetical is None
    assert r.coll_comp_quoted_premium_hypothetical is None


def test_customer_columns(mart):
    r = one(mart, 301)
    assert (r.pni_age, r.hybrid) == (31, "new")
    assert (r.fico_insurance_score_status, r.fico_insurance_score) == ("no_score", None)
    assert (r.months_continuous_insurance_status, r.months_continuous_insurance) == ("no_use", None)
    assert (r.months_with_previous_carrier_status, r.months_with_previous_carrier) == (
        "populated", 12.0,
    )
    assert (r.homeowner, r.prior_insurance_class) == ("yes", "1-31 days without")
    assert (r.mean_daveability_score, r.mean_distracted_driving_score) == (85.5, None)


def test_undated_facts_and_data_count_as_newest(mart):
    r = one(mart, 310)
    assert (r.pni_age, r.hybrid) == (99, "undated")
    assert (r.fico_insurance_score_status, r.fico_insurance_score) == ("populated", 712.0)
    assert r.prior_insurance_class is None and r.mean_daveability_score is None


def test_reasons_come_from_every_request_on_the_rate(mart):
    assert sorted(r.rating_reason for r in mart[(320, 103)]) == ["audit", "new-business"]


def test_sets_are_disjoint_and_complete(tables):
    every = representative_quotes(tables, PARAMS).collect()
    parts = [r for kind in KINDS for r in quotes_of_kind(tables, PARAMS, kind).collect()]
    assert sorted(map(repr, every)) == sorted(map(repr, parts))
    assert len(set(map(repr, every))) == len(every)


def test_tenure_sorts_undated_terms_last(tables):
    found = {r.id: r.prior_policy_term_count for r in term_tenure(tables).collect()}
    assert found == {511: 0, 512: 1, 521: 0, 522: 1, 523: 2, 520: 3}


@pytest.fixture(params=["-1", "10m"], ids=["shuffled", "broadcast"])
def threshold(spark, request):
    name = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(name, request.param)
    yield request.param
    spark.conf.unset(name)


def test_staged_mart_equals_lazy_at_any_threshold(spark, tables, threshold):
    lazy = sorted(map(repr, build_mart(tables, PARAMS).collect()))
    with Staging(spark) as staging:
        assert sorted(map(repr, build_mart(tables, PARAMS, staging).collect())) == lazy


def test_staged_plans_cut_every_child_table(spark, tables, threshold, monkeypatch):
    """And no table of the vehicles is read twice."""
    plans = {}
    write = Staging.table

    def noted(self, df, name, by=None):
        # Not plan(): parts are built side by side, and they share one standard output.
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(self, df, name, by)

    monkeypatch.setattr(Staging, "table", noted)
    with Staging(spark) as staging:
        plans["mart"] = plan(build_mart(tables, PARAMS, staging))
        kept = staging.table(premium_totals(tables), "all").count()
        written = next(f for f in staging._paths if "premium_totals" in f)
        cut = spark.read.parquet(written)
        assert cut.count() < kept
    for text in plans.values():
        for word in ("EvalPython", "CartesianProduct", "NestedLoop"):
            assert word not in text
    for name in ("premium_totals", "vehicle_quotes", "quote_limits", "rated_vehicles", "rerate_quotes", "rating_data"):
        assert "LeftSemi" in plans[name], name
    assert plans["by_other_keys"].count("LeftSemi") >= 2


def test_last_joins_shuffle_nothing(spark, tables):
    """What belongs to a quote lies in buckets of quotes."""
    from helpers import final_plan

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", None)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with Staging(spark) as staging:
            out = build_mart(tables, PARAMS, staging)
            text = plan(out)
            assert "Exchange" not in text and text.count("SortMergeJoin") >= 4
            assert "Exchange" not in final_plan(out)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        if before is not None:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_vehicle_quotes_are_scanned_once(spark, tables, tmp_path):
    rows_of = tables["vehicle_quotes"]
    rows_of.write.parquet(str(tmp_path / "vehicle_quotes"))
    read = spark.read.parquet(str(tmp_path / "vehicle_quotes"))
    scans = []
    with Staging(spark) as staging:
        write = staging.table

        def noted(df, name, by=None):
            scans.append(df._jdf.queryExecution().executedPlan().toString().count(str(tmp_path)))
            return write(df, name, by)

        staging.table = noted
        out = build_mart({**tables, "vehicle_quotes": read}, PARAMS, staging)
        scans.append(plan(out).count(str(tmp_path)))
    assert sum(scans) == 1


def test_requests_are_planned_once_and_by_kind(spark, tables):
    def windows(kind):
        with Staging(spark) as staging:
            names = []
            write = staging.table
            staging.table = lambda df, name, by=None: (names.append(name), write(df, name, by))[1]
            out = quotes_of_kind(tables, PARAMS, kind, staging)
            return out._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit"), names

    for kind in KINDS:
        found, names = windows(kind)
        # The pick of quotes alone is left, in its two steps.
        assert found <= 2 and names.count("requests") == 1


def test_staged_tables_are_deleted(spark, tables):
    with Staging(spark) as staging:
        build_mart(tables, PARAMS, staging).collect()
        paths = [p.removeprefix("file:") for p in staging._paths]
        assert len(paths) >= 6 and all(os.path.exists(p) for p in paths)
    assert not any(os.path.exists(p) for p in paths)


def test_no_shared_folder_leaves_one_lazy_plan(spark, tables, monkeypatch):
    monkeypatch.setattr("quotelens.sources.staging.shared_folder", lambda *_: None)
    staging = Staging(spark)
    assert not staging.enabled
    assert build_mart(tables, PARAMS, staging).inputFiles() == []
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        Staging(spark, required=True)


def test_other_zones_and_lenient_casts_are_refused(spark, tables):
    for name, value in (("spark.sql.session.timeZone", "Asia/Tokyo"), ("spark.sql.ansi.enabled", "false")):
        before = spark.conf.get(name)
        spark.conf.set(name, value)
        try:
            with pytest.raises(ValueError, match=name):
                build_mart(tables, PARAMS)
        finally:
            spark.conf.set(name, before)


def test_parameters_move_the_study_and_rename_ratios(tables):
    moved = MartParams(
        study_start=dt.date(2019, 1, 1), study_end=dt.date(2019, 1, 31), ratio_label="price"
    )
    out = build_mart(tables, moved)
    assert "total_price_ratio" in out.columns
    assert [r.quote_id for r in out.collect()] == [527]


def test_bad_marker_word_fails_unless_lenient(spark):
    data = [dict(r) for r in ROWS["profile_rating_data"]]
    data[-1]["fico_insurance_score"] = "junk"
    tables = fixture_tables(spark, profile_rating_data=data)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        build_mart(tables, PARAMS).collect()
    lenient = build_mart(tables, MartParams(strict_casts=False)).collect()
    assert {r.fico_insurance_score for r in lenient if r.quote_id == 310} == {None}


def test_premium_without_counted_vehicles_fails(spark):
    vehicles = [dict(r) for r in ROWS["vehicle_quotes"]]
    for r in vehicles:
        if r["quote_id"] == 363:
            r["vin"] = None
    tables = fixture_tables(spark, vehicle_quotes=vehicles)
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        build_mart(tables, PARAMS).collect()


def test_amounts_held_as_doubles_give_the_same(spark, tables, mart):
    def as_double(df):
        names = [f.name for f in df.schema if "premium" in f.name]
        return df.withColumns({c: df[c].cast("double") for c in names})

    doubled = {name: as_double(df) for name, df in tables.items()}
    found = build_mart(doubled, PARAMS).collect()
    expected = [r for group in mart.values() for r in group]
    assert len(found) == len(expected)
    by_key = lambda r: (r.quote_id, str(r.rating_reason), r.total_own_to_competitor_ratio or 0, r.bi_pd_own_to_competitor_ratio or 0)
    for a, b in zip(sorted(found, key=by_key), sorted(expected, key=by_key)):
        for x, y in zip(a, b):
            assert x == (pytest.approx(y) if isinstance(y, float) else y)


def test_no_python_worker_and_no_cartesian_product(tables):
    text = plan(build_mart(tables, PARAMS))
    for word in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoop"):
        assert word not in text
    assert "WindowGroupLimit" in text and "LeftSemi" in text
